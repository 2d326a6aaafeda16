"""Prompt texts of the question kinds, and how a question is put together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: example answers of each answer syntax, two for the two prompt variants
MOVE_EXAMPLES = ["e2e4, c2b1q", "g1f3, a2a1q"]
SAME_START_EXAMPLES = ["e2e3, e2e4", "d7d5, d7d6"]
LINE_EXAMPLES = ["d1>d7>d8, a2>e2>h2", "a5>e5>h5, h1>h4>h7"]
FORK_EXAMPLES = ["e5>e7-f6, f3>e1-g1", "e4>b1-g2, c4>b2-d6"]
BATTERY_EXAMPLES = ["b2>e5>h8, h1>h7", "h1>h4, a1>a4>a8"]
FEN_EXAMPLES = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "r2qr1k1/1b1p1ppp/p2Q1n2/1p6/8/1BN2n2/PPP2PPP/R1B1R1K1 w - - 1 15"]
CENTIPAWN_EXAMPLES = ["400", "-200"]
SQUARE_EXAMPLES = ["e4, f5", "a1, b2, c3"]
PIECE_EXAMPLES = ["White Queen at e5", "Black Rook at d5"]
ARRANGEMENT_EXAMPLES = [
    "White King: ['e1'], White Queen: ['d1'], White Rook: ['a1', 'h1'], White Bishop: ['c1', 'f1'], White Knight: ['b1', 'g1'], White Pawn: ['a2', 'b2', 'c2', 'd2', 'e2', 'f2', 'g2', 'h2'], Black King: ['e8'], Black Queen: ['d8'], Black Rook: ['a8', 'h8'], Black Bishop: ['c8', 'f8'], Black Knight: ['b8', 'g8'], Black Pawn: ['a7', 'b7', 'c7', 'd7', 'e7', 'f7', 'g7', 'h7']",
    "White King: ['g1'], White Queen: ['d6'], White Rook: ['a1', 'e1'], White Bishop: ['b3', 'c1'], White Knight: ['c3'], White Pawn: ['a2', 'b2', 'c2', 'f2', 'g2', 'h2'], Black King: ['g8'], Black Queen: ['d8'], Black Rook: ['a8', 'e8'], Black Bishop: ['b7'], Black Knight: ['f3', 'f6'], Black Pawn: ['a6', 'b5', 'd7', 'f7', 'g7', 'h7']",
]
CHOICE_EXAMPLES = ["A", "D"]


@dataclass(frozen=True)
class Kind:
    """A question kind. {fen}, {piece}, {square}, {moves}, {options} stand for the values of a
    position; `counted` is the name of the number of answers in the metadata."""

    name: str
    category: str
    task: str
    suffix: str
    examples: list[str] = field(hash=False)
    answer_type: str = "multi"
    prefix: str = "You are given a chess position in FEN: {fen}.\n"
    counted: str = ""
    context: bool = True


# fixed values: the wording of every kind, which is part of the answers' contract
_EXAMPLE = "Example final answer: FORMAT_EXAMPLE_PLACEHOLDER"
_MORE = "If more than one, separate with a comma and a space."
STRUCTURAL = [
    Kind(
        "structural_piece_arrangement", "Structural",
        "Provide the complete piece arrangement of this position. List all pieces with their colors, types, and squares.\nFormat: 'Color PieceType: [square1, square2, ...]', separated by commas and spaces for different piece types.\n"
        "List the pieces in the order of White pieces first (King, Queen, Rook, Bishop, Knight, Pawn) followed by Black pieces (King, Queen, Rook, Bishop, Knight, Pawn).\nIf a piece type has no pieces on the board, skip it in the listing.\nList the squares for each piece type in alphabetical order.\n",
        _EXAMPLE, ARRANGEMENT_EXAMPLES, "single",
    ),
    Kind("structural_legal_move_piece", "Structural", "Find all legal moves for the piece on square {square}. List the moves in UCI format, separated by commas and spaces.\n", _EXAMPLE, SAME_START_EXAMPLES, counted="n_moves"),
    Kind("structural_legal_move_all", "Structural", "Find all legal moves in this position. List the moves in UCI format, separated by commas and spaces.\n", _EXAMPLE, MOVE_EXAMPLES, counted="n_moves"),
    Kind(
        "structural_check_detection", "Structural", "In this position, the side to move is in check. Identify the piece(s) that is delivering the check.\n",
        "List each checking piece with its color, type, and square (e.g., FORMAT_EXAMPLE_PLACEHOLDER). Separate multiple pieces with commas and spaces if applicable.", PIECE_EXAMPLES, counted="n_checkers",
    ),
    Kind("structural_check_in_1", "Structural", "Find all moves that put the opponent in check. List the moves in UCI format, separated by commas and spaces.\n", _EXAMPLE, MOVE_EXAMPLES, counted="n_checking_moves"),
    Kind(
        "structural_capture_squares", "Structural",
        "Find all squares that the {piece} on {square} can capture (i.e. every square that has an opponent piece such that the {piece} on {square} could legally move to that square and capture the piece).\nExclude captures if the {piece} on {square} is pinned to its king and thus cannot move.\n",
        _EXAMPLE, SQUARE_EXAMPLES, counted="n_captures",
    ),
    Kind(
        "structural_protect_squares", "Structural",
        "Find all squares that contain pieces that the {piece} on {square} protects (i.e. every square that contains a piece such that the {piece} on {square} could legally recapture if an enemy piece captured it, excluding the king since it can't be captured).\nExclude protection if the {piece} on {square} is pinned to its king and thus cannot move.\n",
        _EXAMPLE, SQUARE_EXAMPLES, counted="n_protected",
    ),
    Kind(
        "structural_control_squares", "Structural",
        "Find all squares that the {piece} on {square} controls (i.e. every empty square that the {piece} on {square} could legally move to, excluding squares occupied by any piece).\nExclude control if the {piece} on {square} is pinned to its king and thus cannot move.\n",
        _EXAMPLE, SQUARE_EXAMPLES, counted="n_controlled",
    ),
]
MOTIFS = [
    Kind(
        "motifs_pin", "Motifs",
        "Identify all absolute pins in this position. An absolute pin occurs when a piece cannot move because it would expose its own king to check. For each pin, provide the key squares in the format: pinning_piece>pinned_piece>target_piece (e.g., FORMAT_EXAMPLE_PLACEHOLDER).\n",
        _MORE, LINE_EXAMPLES, counted="n_pins",
    ),
    Kind(
        "motifs_fork", "Motifs",
        "Identify all forks in this position. A fork occurs when one piece attacks two or more enemy pieces simultaneously. For each fork, provide the key squares in the format: forking_piece>attacked_piece1-attacked_piece2(-attacked_piece3 ...) (e.g., FORMAT_EXAMPLE_PLACEHOLDER).\n",
        "Order attacked pieces alphabetically (a>h, then 1>8). " + _MORE, FORK_EXAMPLES, counted="n_forks",
    ),
    Kind(
        "motifs_battery", "Motifs",
        "Identify every battery (2 or more aligned long-range pieces, e.g, RR/RQ/QQ on files or ranks, BQ/BB/QQ on diagonals, of the same color with no pieces between). Report each battery as the squares of the pieces in alphabetical order (a>h, 1>8), using '>' to separate squares in a battery and ',' to separate multiple batteries, e.g., FORMAT_EXAMPLE_PLACEHOLDER.\n",
        _MORE, BATTERY_EXAMPLES, counted="n_batteries",
    ),
    Kind(
        "motifs_skewer", "Motifs",
        "Identify all skewers in this position. A skewer occurs when a more valuable piece is attacked first and forced to move, exposing a less valuable piece behind it to be captured. For each skewer, provide the key squares in the format: skewering_piece>front_piece>back_piece (e.g., FORMAT_EXAMPLE_PLACEHOLDER).\n",
        _MORE, LINE_EXAMPLES, counted="n_skewers",
    ),
    Kind("motifs_discovered_check", "Motifs", "Identify all discovered-check moves (your move uncovers a check from a rook/bishop/queen on the enemy king). Report each as UCI move (e.g., FORMAT_EXAMPLE_PLACEHOLDER).\n", _MORE, MOVE_EXAMPLES, counted="n_discovered_checks"),
    Kind("motifs_double_check", "Motifs", "Identify all moves that deliver a double check (two pieces give check after the move). Report each as UCI move (e.g., FORMAT_EXAMPLE_PLACEHOLDER).\n", _MORE, MOVE_EXAMPLES, counted="n_double_checks"),
]
TRACKING = Kind(
    "structural_state_tracking", "Structural", "Initial FEN: {fen}\nMoves (UCI): {moves}\n", _EXAMPLE, FEN_EXAMPLES, "single",
    prefix="Given an initial FEN and a sequence of UCI moves, apply the moves in order and output the exact resulting FEN.\n", context=False,
)
TACTICS = Kind("short_tactics", "Short Tactics", "Find the best move for the side to play.\n", "Use UCI notation (e.g., FORMAT_EXAMPLE_PLACEHOLDER) for the final answer.", MOVE_EXAMPLES, "single")
JUDGEMENT = Kind(
    "position_judgement", "Position Judgement",
    "Estimate the Stockfish evaluation in centipawns (from White's perspective). Think deeper about this position: Don't just evaluate the current board state. Consider what the most likely moves are for both sides and how the centipawn evaluation would change as the position develops. Analyze a moves ahead - what does the future of this position look like? How would a strong engine assess this position after calculating many moves deep?Analyze step by step and explain your reasoning.\n",
    "Choose the closest evaluation from the following options: {options}.\nExample final answers: FORMAT_EXAMPLE_PLACEHOLDER", CENTIPAWN_EXAMPLES, "single", prefix="You are analyzing a chess position in FEN: {fen}.\n",
)
CHOICE = Kind(
    "semantic", "Semantic", "Select the commentary that best describes this position and move.\n\nOptions:\n{options}\n", "Example format: FORMAT_EXAMPLE_PLACEHOLDER", CHOICE_EXAMPLES, "single",
    prefix="You are given a chess position in FEN: {fen}\nA player makes the move: {moves}\n", context=False,
)
#: Fixed value: what stands between the task and its suffix.
STEPS = "Analyze step by step and explain your reasoning.\nFinish with a single line formatted EXACTLY as:\nFINAL ANSWER: <answer>\n"


def template(kind: Kind) -> str:
    """The whole question of a kind with its values still open. The place of the context
    stays open too, except in kinds that never show one."""
    return kind.prefix + ("CONTEXT_PLACEHOLDER" if kind.context else "") + kind.task + STEPS + kind.suffix


def question(kind: Kind | Column, **values: Column) -> Column:
    """A question with its values filled in, all at once: a value may hold braces."""
    parts, text = [], template(kind)
    while text:
        at = min(((text.find("{" + k + "}"), k) for k in values if "{" + k + "}" in text), default=None)
        if at is None:
            parts.append(F.lit(text))
            break
        parts += [F.lit(text[: at[0]]), values[at[1]]]
        text = text[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def context_block(arrangement: Column, moves: Column) -> Column:
    """What may stand in the place of the context; '' for a position that can't be read.
    moves: array of legal moves."""
    both = F.concat(F.lit("Piece arrangement: "), arrangement, F.lit("\nLegal moves: "), F.array_join(F.array_sort(moves), ", "), F.lit("\n\n"))
    return F.coalesce(both, F.lit(""))
