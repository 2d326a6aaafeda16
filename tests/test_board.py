"""The rules kernel by published counts, and the relational geometry against it."""

import random

import pytest

from gambitflow.functions import board
from gambitflow.functions.board import START, Position, perft
from gambitflow.operators import geometry, moves

KIWI = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"
FENS = [
    START, KIWI, "8/1P4R1/7p/4B1pk/3P4/1r2q3/6PP/2R4K w - - 1 43", "r2qr1k1/1b1p1ppp/p2Q1n2/1p6/8/1BN2n2/PPP2PPP/R1B1R1K1 w - - 1 15", "r4r2/pb2ppkp/1p4p1/2pq4/8/1P1P4/P1PN1PPP/R2Q1RK1 w - - 0 15",
    "5rk1/4bppp/P2p4/8/1P1rp3/N7/P4PPP/1R3RK1 b - - 2 22", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1",
]


@pytest.mark.parametrize(("fen", "counts"), [(START, [20, 400, 8902]), (KIWI, [48, 2039]), (FENS[6], [14, 191, 2812]), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]), ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264])])
def test_perft(fen, counts):
    assert [perft(Position.from_fen(fen), d + 1) for d in range(len(counts))] == counts


def test_fen_round_trip_and_en_passant():
    p = Position.from_fen(START)
    n = p.push(p.parse_uci("e2e4"))
    assert n.fen().split()[3] == "-"  # no capture is possible
    fen, san = board.apply_moves(START, ["e2e4", "a7a6", "e4e5", "d7d5"])
    assert fen.split()[3] == "d6" and san == ["e4", "a6", "e5", "d5"]
    assert Position.from_fen("4k3/8/8/8/8/8/8/4K3 w KQkq - 0 1").fen().split()[2] == "-"
    for bad in ("", "8/8", "9/8/8/8/8/8/8/8 w", "x", START + " 1", START.replace("w", "z")):
        with pytest.raises(ValueError):
            Position.from_fen(bad)


def test_legality_cases():
    assert [board.legality(START, a) for a in ("e2e4", "e2e5", "Qh5", "e7e8q", None, "  E2E4 ", "", " ")] == ["legal", "illegal", "unparseable", "illegal", None, "legal", None, None]


def test_san_round_trip_on_playouts():
    rng = random.Random(5)
    for _ in range(6):
        p = Position.from_fen(START)
        for _ in range(60):
            legal = p.legal()
            if not legal:
                break
            m = rng.choice(legal)
            assert p.parse_san(p.san(m, legal)) == m
            p = p.push(m)
            assert Position.from_fen(p.fen()).placement() == p.placement()


def test_read_game():
    head, plies = board.read_game('[Event "x"]\n[White "A, B"]\n\n1. e4 {best by test} e5 (1... c5 2. Nf3) 2. Nf3 $1 Nc6 3. O-O 1-0')
    assert head["White"] == "A, B" and [p["san"] for p in plies] == ["e4", "e5", "Nf3", "Nc6"]  # castling is illegal here
    assert plies[0]["comment"] == "best by test" and plies[1]["fen_before"].split()[1] == "b"


@pytest.fixture(scope="module")
def places():
    rng = random.Random(11)
    out = list(FENS)
    for _ in range(20):
        p = Position.from_fen(START)
        for _ in range(rng.randint(5, 70)):
            legal = p.legal()
            if not legal:
                break
            p = p.push(rng.choice(legal))
        out.append(p.fen())
    return out


def _frame(spark, places):
    return geometry.positions(spark.createDataFrame([(str(i), f) for i, f in enumerate(places)] + [("n", None), ("e", ""), ("b", "8/8")], "id string, fen string"), "id", "fen")


def test_geometry_against_the_kernel(spark, places):
    pos = _frame(spark, places)
    ls = geometry.lines(pos)
    checkers, forks, reach, pins = {}, {}, {}, set()
    for r in geometry.checkers(ls).collect():
        checkers.setdefault(r.pos_id, set()).add(r.checker[-2:])
    for r in geometry.forks(ls).collect():
        forks[r.pos_id, r.forker] = r.victims
    for r in geometry.reach(ls).collect():
        reach[r.pos_id, r.square, r.kind] = r.squares
    pins = {(r.pos_id, r.pinned) for r in geometry.structural_pins(ls).collect()}
    for i, fen in enumerate(places):
        p, i = Position.from_fen(fen), str(i)
        assert checkers.get(i, set()) == {board.square_name(s) for s in p.checkers()}
        for s in range(64):
            if not p.board[s]:
                continue
            own, at = p.board[s].isupper(), board.square_name(s)
            hit = sorted(board.square_name(t) for t in p.attacks(s) if p.board[t] and p.board[t].isupper() != own)
            assert forks.get((i, at)) == ("-".join(hit) if len(hit) > 1 else None)
            king = p.king(own)
            # pinned: alone between the king and an enemy slider of the right kind, not next to the king
            pinned = False
            for d, ray in ((d, board.RAYS[d][king]) for d in board.DIRECTIONS):
                met = [t for t in ray if p.board[t]]
                if len(met) > 1 and met[0] == s and ray.index(s) > 0 and p.board[met[1]].isupper() != own and d in board.SLIDES.get(p.board[met[1]].lower(), ()):
                    pinned = True
            assert ((i, at) in pins) == pinned
            want = {"capture": [], "control": [], "protect": []}
            if not pinned:
                for t in p.attacks(s):
                    q = p.board[t]
                    kind = "control" if not q else "capture" if q.isupper() != own else "protect" if q.lower() != "k" else ""
                    if kind:
                        want[kind].append(board.square_name(t))
            for kind, v in want.items():
                assert reach.get((i, at, kind)) == (", ".join(sorted(v)) or None)


def test_batteries_and_arrangement(spark, places):
    pos = _frame(spark, places)
    got = {(r.pos_id, r.battery) for r in geometry.batteries(pos).collect()}
    want = set()
    by_line: dict = {}
    for no, k, sq in geometry.board_lines():
        by_line.setdefault(no, []).append(sq)
    for i, fen in enumerate(places):
        b = Position.from_fen(fen).board
        for no, squares in by_line.items():
            uses, run = "rq" if no >= 0 and (squares[1] - squares[0]) in (1, 8) else "bq", []
            for s in [x for x in squares if b[x]] + [None]:
                fits = s is not None and b[s].lower() in uses
                if run and not (fits and b[s].isupper() == b[run[-1]].isupper()):
                    if len(run) > 1:
                        want.add((str(i), ">".join(map(board.square_name, run))))
                    run = []
                if fits:
                    run.append(s)
    assert got == want and len(by_line) == 42
    text = {r.pos_id: r.text for r in geometry.arrangement(pos).collect()}
    assert text["2"].startswith("White King: ['h1'], White Rook: ['c1', 'g7'], White Bishop: ['e5']")


def test_move_operators(spark):
    df = spark.createDataFrame([("a", START, ["e2e4", "e7e5"]), ("b", None, None), ("c", "junk", ["e2e4"]), ("d", "4k3/8/8/8/8/8/4B3/4R1K1 w - - 0 1 | e2d3", [])], "id string, fen string, moves array<string>")
    legal = {r.id: r.moves for r in moves.legal_moves(df).collect()}
    assert len(legal["a"]) == 20 and legal["b"] is None and legal["c"] is None
    motifs = {r.id: r for r in moves.check_motifs(df).collect()}
    assert set(motifs["d"].discovered) == {"e2" + x for x in ("d1", "f1", "d3", "c4", "a6", "b5", "f3", "g4", "h5")} and "e2b5" in motifs["d"].double_checks and "e2h5" in motifs["d"].double_checks
    played = {r.id: r for r in moves.played(df).collect()}
    assert played["a"].san == ["e4", "e5"] and played["c"].final_fen is None
    assert moves.legal_moves(df.limit(0)).count() == 0
