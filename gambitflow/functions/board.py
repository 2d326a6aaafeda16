"""Rules of chess in plain Python: positions, legal moves, SAN, FEN and game scores.

Written from the public rules. Squares are 0..63 (a1 = 0); a piece is its FEN letter. Used
inside Arrow functions, one position per row; nothing here knows Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
DIRECTIONS = {"N": 8, "S": -8, "E": 1, "W": -1, "NE": 9, "NW": 7, "SE": -7, "SW": -9}
_STRAIGHT, _DIAGONAL = ("N", "S", "E", "W"), ("NE", "NW", "SE", "SW")
SLIDES = {"b": _DIAGONAL, "r": _STRAIGHT, "q": _STRAIGHT + _DIAGONAL}
NAMES = {"p": "Pawn", "n": "Knight", "b": "Bishop", "r": "Rook", "q": "Queen", "k": "King"}


def square_name(s: int) -> str:
    return "abcdefgh"[s % 8] + str(s // 8 + 1)


def square_of(name: str) -> int:
    return ord(name[0]) - 97 + 8 * (int(name[1]) - 1)


def _offsets(s: int, steps: list[tuple[int, int]]) -> list[int]:
    f, r = s % 8, s // 8
    return [8 * (r + b) + f + a for a, b in steps if 0 <= f + a < 8 and 0 <= r + b < 8]


def _ray(s: int, d: str) -> list[int]:
    a = ("E" in d) - ("W" in d)
    b = ("N" in d) - ("S" in d)
    return [8 * (s // 8 + b * k) + s % 8 + a * k for k in range(1, 8) if 0 <= s % 8 + a * k < 8 and 0 <= s // 8 + b * k < 8]


RAYS = {d: [_ray(s, d) for s in range(64)] for d in DIRECTIONS}
KNIGHT = [_offsets(s, [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]) for s in range(64)]
KING = [_offsets(s, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]) for s in range(64)]
#: Squares that a pawn on s attacks: white, black.
PAWN = {True: [_offsets(s, [(-1, 1), (1, 1)]) for s in range(64)], False: [_offsets(s, [(-1, -1), (1, -1)]) for s in range(64)]}


def between(a: int, b: int) -> list[int]:
    """Squares strictly between two squares on one line; none if they share no line."""
    for d in DIRECTIONS:
        ray = RAYS[d][a]
        if b in ray:
            return ray[: ray.index(b)]
    return []


@dataclass
class Position:
    board: list[str] = field(default_factory=lambda: [""] * 64)
    white: bool = True
    castling: str = "-"
    ep: int = -1
    halfmove: int = 0
    fullmove: int = 1

    # reading and writing -------------------------------------------------------------
    @classmethod
    def from_fen(cls, fen: str) -> Position:
        """Raises ValueError for text that is no position; counters may be missing."""
        parts = fen.split()
        if not 1 <= len(parts) <= 6:
            raise ValueError(fen)
        rows = parts[0].split("/")
        if len(rows) != 8:
            raise ValueError(fen)
        p = cls()
        for r, row in enumerate(rows):
            f, digit = 0, False
            for c in row:
                if c in "12345678":
                    if digit:
                        raise ValueError(fen)
                    f, digit = f + int(c), True
                elif c in "pnbrqkPNBRQK" and f < 8:
                    p.board[8 * (7 - r) + f] = c
                    f, digit = f + 1, False
                else:
                    raise ValueError(fen)
            if f != 8:
                raise ValueError(fen)
        if len(parts) > 1 and parts[1] not in "wb":
            raise ValueError(fen)
        p.white = len(parts) < 2 or parts[1] == "w"
        if len(parts) > 2:
            if not re.fullmatch(r"-|[KQkq]{1,4}", parts[2]):
                raise ValueError(fen)
            p.castling = parts[2]
        if len(parts) > 3 and parts[3] != "-":
            if not re.fullmatch("[a-h][36]", parts[3]):
                raise ValueError(fen)
            p.ep = square_of(parts[3])
        try:
            p.halfmove = int(parts[4]) if len(parts) > 4 else 0
            p.fullmove = max(1, int(parts[5])) if len(parts) > 5 else 1
        except ValueError:
            raise ValueError(fen) from None
        return p

    def rights(self) -> str:
        """Castling rights that the places of kings and rooks still allow."""
        b = self.board
        good = [c for c, king, rook, k, r in (("K", 4, 7, "K", "R"), ("Q", 4, 0, "K", "R"), ("k", 60, 63, "k", "r"), ("q", 60, 56, "k", "r")) if c in self.castling and b[king] == k and b[rook] == r]
        return "".join(good) or "-"

    def placement(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            row = "".join(x or "1" for x in self.board[8 * r : 8 * r + 8])
            rows.append(re.sub("1+", lambda m: str(len(m.group())), row))
        return "/".join(rows)

    def fen(self) -> str:
        """The en passant square is written only where such a capture is legal."""
        ep = "-"
        if self.ep >= 0 and any(m[1] == self.ep and self.board[m[0]].lower() == "p" and m[0] % 8 != self.ep % 8 for m in self.legal()):
            ep = square_name(self.ep)
        return f"{self.placement()} {'w' if self.white else 'b'} {self.rights()} {ep} {self.halfmove} {self.fullmove}"

    # attacks -------------------------------------------------------------------------
    def attacks(self, s: int) -> list[int]:
        """Squares that the piece on s attacks; a slider reaches the first piece of either side."""
        piece = self.board[s]
        kind = piece.lower()
        if kind == "p":
            return PAWN[piece == "P"][s]
        if kind == "n":
            return KNIGHT[s]
        if kind == "k":
            return KING[s]
        out = []
        for d in SLIDES.get(kind, ()):
            for t in RAYS[d][s]:
                out.append(t)
                if self.board[t]:
                    break
        return out

    def attackers(self, white: bool, s: int) -> list[int]:
        b = self.board
        own = (lambda c: c.upper()) if white else (lambda c: c)
        out = [t for t in KNIGHT[s] if b[t] == own("n")] + [t for t in KING[s] if b[t] == own("k")] + [t for t in PAWN[not white][s] if b[t] == own("p")]
        for d in DIRECTIONS:
            line = "rq" if d in _STRAIGHT else "bq"
            for t in RAYS[d][s]:
                if b[t]:
                    if b[t] in (own(line[0]), own(line[1])):
                        out.append(t)
                    break
        return sorted(out)

    def king(self, white: bool) -> int:
        k = "K" if white else "k"
        return self.board.index(k) if k in self.board else -1

    def checkers(self) -> list[int]:
        k = self.king(self.white)
        return self.attackers(not self.white, k) if k >= 0 else []

    # moves ---------------------------------------------------------------------------
    def pseudo(self):
        b, white = self.board, self.white
        mine = str.isupper if white else str.islower
        for s in range(64):
            piece = b[s]
            if not piece or not mine(piece):
                continue
            if piece.lower() == "p":
                step = 8 if white else -8
                last = 7 if white else 0
                to = []
                if 0 <= s + step < 64 and not b[s + step]:
                    to.append(s + step)
                    if s // 8 == (1 if white else 6) and not b[s + 2 * step]:
                        to.append(s + 2 * step)
                for t in PAWN[white][s]:
                    if (b[t] and not mine(b[t])) or (t == self.ep and t // 8 == (5 if white else 2) and b[t] == "" and b[t - step] == ("p" if white else "P")):
                        to.append(t)
                for t in to:
                    if t // 8 == last:
                        for q in "qrbn":
                            yield s, t, q
                    else:
                        yield s, t, ""
            else:
                for t in self.attacks(s):
                    if not b[t] or not mine(b[t]):
                        yield s, t, ""
        rights, home = self.rights(), 4 if white else 60
        for side, empty, path in (("K", (1, 2), (1, 2)), ("Q", (-1, -2, -3), (-1, -2))):
            if (side if white else side.lower()) in rights and not any(b[home + x] for x in empty) and not any(self.attackers(not white, home + x) for x in (0, *path)):
                yield home, home + path[1], ""

    def push(self, move: tuple[int, int, str]) -> Position:
        """The position after a move; the move is not checked."""
        s, t, q = move
        b = self.board[:]
        piece = b[s]
        n = Position(b, not self.white, self.castling, -1, self.halfmove + 1, self.fullmove + (not self.white))
        if b[t] or piece.lower() == "p":
            n.halfmove = 0
        if piece.lower() == "p":
            if t == self.ep and s % 8 != t % 8 and not b[t]:
                b[t + (-8 if self.white else 8)] = ""
            if abs(t - s) == 16:
                n.ep = (s + t) // 2
        if piece.lower() == "k" and abs(t - s) == 2 and s in (4, 60):
            rook_from, rook_to = (s + 3, s + 1) if t > s else (s - 4, s - 1)
            b[rook_to], b[rook_from] = b[rook_from], ""
        b[t] = (q.upper() if self.white else q) if q else piece
        b[s] = ""
        gone = {4: "KQ", 60: "kq", 7: "K", 0: "Q", 63: "k", 56: "q"}
        lost = gone.get(s, "") + gone.get(t, "")
        n.castling = "".join(c for c in self.castling if c not in lost) or "-"
        return n

    def legal(self) -> list[tuple[int, int, str]]:
        out = []
        for m in self.pseudo():
            n = self.push(m)
            k = n.king(self.white)
            if k < 0 or not n.attackers(n.white, k):
                out.append(m)
        return out

    # notation ------------------------------------------------------------------------
    @staticmethod
    def uci(m: tuple[int, int, str]) -> str:
        return square_name(m[0]) + square_name(m[1]) + m[2]

    @staticmethod
    def parse_uci(text: str) -> tuple[int, int, str]:
        if not re.fullmatch("[a-h][1-8][a-h][1-8][qrbn]?", text):
            raise ValueError(text)
        return square_of(text[:2]), square_of(text[2:4]), text[4:]

    def san(self, m: tuple[int, int, str], legal: list | None = None) -> str:
        legal = self.legal() if legal is None else legal
        s, t, q = m
        kind = self.board[s].lower()
        takes = bool(self.board[t]) or (kind == "p" and s % 8 != t % 8)
        if kind == "k" and abs(t - s) == 2 and s in (4, 60):
            text = "O-O" if t > s else "O-O-O"
        elif kind == "p":
            text = (square_name(s)[0] + "x" if takes else "") + square_name(t) + ("=" + q.upper() if q else "")
        else:
            rivals = [x[0] for x in legal if x[1] == t and x[0] != s and self.board[x[0]] == self.board[s]]
            text = kind.upper()
            if rivals:
                if all(r % 8 != s % 8 for r in rivals):
                    text += square_name(s)[0]
                elif all(r // 8 != s // 8 for r in rivals):
                    text += square_name(s)[1]
                else:
                    text += square_name(s)
            text += ("x" if takes else "") + square_name(t)
        n = self.push(m)
        if n.checkers():
            text += "+" if n.legal() else "#"
        return text

    def parse_san(self, text: str) -> tuple[int, int, str]:
        t = re.sub(r"[+#!?]+$", "", text.strip()).replace("0", "O")
        legal = self.legal()
        if t in ("O-O", "O-O-O"):
            found = [m for m in legal if self.board[m[0]].lower() == "k" and m[1] - m[0] == (2 if t == "O-O" else -2) and m[0] in (4, 60)]
        else:
            p = re.fullmatch(r"([KQRBN]?)([a-h]?)([1-8]?)x?([a-h][1-8])(?:=?([QRBN]))?", t)
            if not p:
                raise ValueError(text)
            kind, f, r, to, q = p.groups()
            found = [
                m for m in legal
                if self.board[m[0]].upper() == (kind or "P") and m[1] == square_of(to) and m[2] == (q or "").lower() and (not f or square_name(m[0])[0] == f) and (not r or square_name(m[0])[1] == r)
            ]
        if len(found) != 1:
            raise ValueError(text)
        return found[0]


def perft(p: Position, depth: int) -> int:
    """Leaves of the tree of legal moves."""
    moves = p.legal()
    return len(moves) if depth == 1 else sum(perft(p.push(m), depth - 1) for m in moves)


def apply_moves(fen: str, moves: list[str]) -> tuple[str, list[str]]:
    """The final FEN and the SAN of UCI moves played from a position."""
    p, out = Position.from_fen(fen), []
    for u in moves:
        m = p.parse_uci(u)
        out.append(p.san(m))
        p = p.push(m)
    return p.fen(), out


def legality(fen: str | None, answer: str | None) -> str | None:
    """legal, illegal or unparseable; None where there is nothing to check."""
    if not answer or not answer.strip() or not fen:
        return None
    text = answer.strip().lower()
    try:
        move = Position.parse_uci(text)
    except ValueError:
        return "unparseable"
    try:
        return "legal" if move in Position.from_fen(fen).legal() else "illegal"
    except ValueError:
        return None


# motifs that need moves --------------------------------------------------------------------
def checking_moves(p: Position) -> list[str]:
    return sorted(p.uci(m) for m in p.legal() if p.push(m).checkers())


def double_checks(p: Position) -> list[str]:
    """Moves after which two pieces or more give check, without promotion letters."""
    return sorted({p.uci(m)[:4] for m in p.legal() if len(p.push(m).checkers()) > 1})


def discovered_checks(p: Position) -> list[str]:
    """Moves that open a line of an own slider to the enemy king: the slider gives check
    after the move, and the moved piece alone stood between before it."""
    out = set()
    for m in p.legal():
        n = p.push(m)
        king = n.king(n.white)
        for c in n.checkers():
            if c == m[1] or n.board[c].lower() not in SLIDES:
                continue
            line = between(c, king)
            if m[0] in line and not any(p.board[x] for x in line if x != m[0]):
                out.add(p.uci(m)[:4])
    return sorted(out)


# game scores -----------------------------------------------------------------------------
_PGN_TOKEN = re.compile(r"\{([^}]*)\}|;([^\n]*)|\(|\)|\$\d+|\d+\.+|(?:1-0|0-1|1/2-1/2|\*)|[^\s(){};]+")


def read_game(text: str) -> tuple[dict[str, str], list[dict]]:
    """Headers and main line of one game: ply, san, uci, fen_before, fen_after, comment.
    Variations are skipped but must be balanced; reading stops at the first unreadable move."""
    headers = dict(re.findall(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]', text, re.MULTILINE))
    body = re.sub(r"^\[\w+\s+\".*\"\]\s*$", "", text, flags=re.MULTILINE)
    p = Position.from_fen(headers.get("FEN", START))
    plies: list[dict] = []
    depth = 0
    for m in _PGN_TOKEN.finditer(body):
        t = m.group()
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth or t[0] == "$" or re.fullmatch(r"\d+\.+", t):
            continue
        elif m.group(1) is not None or m.group(2) is not None:
            if plies:
                comment = " ".join((m.group(1) or m.group(2)).split())
                plies[-1]["comment"] = f"{plies[-1]['comment']} {comment}".strip()
        elif t in ("1-0", "0-1", "1/2-1/2", "*"):
            break
        else:
            t = re.sub(r"^\d+\.+", "", t)
            if not t:
                continue
            try:
                move = p.parse_san(t)
            except ValueError:
                break
            n = p.push(move)
            plies.append({"ply": len(plies) + 1, "san": p.san(move), "uci": p.uci(move), "fen_before": p.fen(), "fen_after": n.fen(), "comment": "", "move_number": p.fullmove, "side": "white" if p.white else "black"})
            p = n
    return headers, plies
