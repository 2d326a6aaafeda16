"""Answers as drawing primitives: one struct with nullable arms (type says which holds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gambitflow.functions.boards import board_difference, board_string
from gambitflow.functions.text import strip

_SQUARE = r"\A[a-h][1-8]\z"
_UCI = r"\A[a-h][1-8][a-h][1-8][qrbn]?\z"
# fixed values: task types by the form of their answers
MOVE_TYPES = ["structural_check_in_1", "structural_legal_move_all", "structural_legal_move_piece", "motifs_discovered_check", "motifs_double_check"]
SQUARE_TYPES = ["structural_capture_squares", "structural_control_squares", "structural_protect_squares"]
CHAIN_TYPES = ["motifs_pin", "motifs_skewer", "motifs_battery"]

_ARROWS = "array<struct<from:string,to:string,promotion:string>>"


def _items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def _arrow(a: Column, b: Column, p: Column | None = None) -> Column:
    return F.struct(a.alias("from"), b.alias("to"), (p if p is not None else F.lit(None).cast("string")).alias("promotion"))


def _whole(items: Column, good, build: Column) -> Column:
    """A list is parsed whole: any bad item fails all of it."""
    return F.when((F.size(items) > 0) & F.forall(items, good), build)


def moves(c: Column) -> Column:
    items = _items(F.lower(c))
    return _whole(items, lambda x: x.rlike(_UCI), F.transform(items, lambda x: _arrow(F.substring(x, 1, 2), F.substring(x, 3, 2), F.nullif(F.substring(x, 5, 1), F.lit("")))))


def squares(c: Column) -> Column:
    items = _items(c)
    return _whole(items, lambda x: x.rlike(_SQUARE), items)


def evaluation(c: Column) -> Column:
    return F.when(strip(c).rlike(r"\A[-+]?\d+\z"), strip(c).try_cast("long"))


def choice(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(strip(c), r"\A\(?([A-Da-d])\)?\.?\z", 1)), F.lit(""))


def _parts(x: Column, sep: str) -> Column:
    return F.transform(F.split(x, sep), strip)


def chain(c: Column) -> Column:
    items = _items(c)
    arrows = lambda x: F.transform(F.arrays_zip(F.slice(_parts(x, ">"), F.lit(1), F.size(F.split(x, ">")) - 1).alias("a"), F.slice(_parts(x, ">"), F.lit(2), F.size(F.split(x, ">"))).alias("b")), lambda p: _arrow(p["a"], p["b"]))
    return _whole(items, lambda x: (F.size(F.split(x, ">")) >= 2) & F.forall(_parts(x, ">"), lambda s: s.rlike(_SQUARE)), F.flatten(F.transform(items, arrows)))


def fork(c: Column) -> Column:
    items = _items(c)
    head = lambda x: strip(F.get(F.split(x, ">", 2), F.lit(0)))
    victims = lambda x: _parts(F.get(F.split(x, ">", 2), F.lit(1)), "-")
    good = lambda x: F.contains(x, F.lit(">")) & head(x).rlike(_SQUARE) & F.forall(victims(x), lambda v: v.rlike(_SQUARE))
    return _whole(items, good, F.flatten(F.transform(items, lambda x: F.transform(victims(x), lambda v: _arrow(head(x), v)))))


def pieces_at(c: Column) -> Column:
    """'Color Piece at square' in any text, as struct(color, piece, square)."""
    pattern = r"(?i)(?:White|Black)\s+(?:King|Queen|Rook|Bishop|Knight|Pawn)\s+at\s+[a-h][1-8]"
    found = F.regexp_extract_all(c, F.lit(pattern), 0)
    part = lambda x, k: F.get(F.split(x, r"\s+"), F.lit(k))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: F.struct(F.initcap(part(x, 0)).alias("color"), F.initcap(part(x, 1)).alias("piece"), F.lower(part(x, 3)).alias("square"))))


def arrangement(c: Column) -> Column:
    """'Color Piece: [..]' groups as struct(color, piece, square)."""
    groups = F.regexp_extract_all(c, F.lit(r"(?i)(?:White|Black)\s+(?:King|Queen|Rook|Bishop|Knight|Pawn):\s*\[[^\]]*\]"), 0)
    part = lambda x, k: F.initcap(F.get(F.split(x, r"[\s:]+"), F.lit(k)))
    items = F.flatten(F.transform(groups, lambda x: F.transform(F.regexp_extract_all(F.get(F.split(x, r"\["), F.lit(1)), F.lit("[a-h][1-8]"), 0), lambda s: F.struct(part(x, 0).alias("color"), part(x, 1).alias("piece"), s.alias("square")))))
    return F.when(F.size(items) > 0, items)


def primitive(task_type: Column, answer: Column, correct_fen: Column | None = None) -> Column:
    """struct(type, arrows, squares, value, letter, items, text). An answer that is a board
    keeps its text; with the correct board, `squares` holds those on which they differ."""
    t = strip(answer)
    starts = lambda p: task_type.startswith(p)
    arrows = (
        F.when(starts("short_tactics") | task_type.isin(*MOVE_TYPES), moves(t))
        .when(task_type.isin(*CHAIN_TYPES), chain(t))
        .when(task_type == "motifs_fork", fork(t))
    ).cast(_ARROWS)
    sq = F.when(task_type.isin(*SQUARE_TYPES), squares(t))
    value = F.when(starts("position_judgement"), evaluation(t))
    letter = F.when(starts("semantic"), choice(t))
    items = F.when(task_type == "structural_check_detection", pieces_at(t)).when(task_type == "structural_piece_arrangement", arrangement(t))
    none = t.isNull() | (t == "") | (F.lower(t) == "none")
    fen = starts("structural_state_tracking") & t.rlike(r"\A(?:[pnbrqkPNBRQK1-8]+/){7}[pnbrqkPNBRQK1-8]+ [wb] ")
    if correct_fen is not None:
        sq = F.when(fen, board_difference(board_string(t), board_string(correct_fen))).otherwise(sq)
    kind = (
        F.when(none, F.lit("none"))
        .when(arrows.isNotNull(), F.when(task_type.isin(*CHAIN_TYPES, "motifs_fork"), F.lit("chain")).otherwise(F.lit("moves")))
        .when(sq.isNotNull() & ~fen, F.lit("squares")).when(value.isNotNull(), F.lit("eval")).when(letter.isNotNull(), F.lit("choice"))
        .when(items.isNotNull(), F.lit("pieces")).when(fen, F.lit("fen")).otherwise(F.lit("text"))
    )
    keep = lambda c: F.when(~F.coalesce(none, F.lit(True)), c)
    return F.struct(kind.alias("type"), keep(arrows).alias("arrows"), keep(sq).alias("squares"), keep(value).alias("value"), keep(letter).alias("letter"), keep(items).alias("items"), F.when(kind.isin("text", "fen"), t).alias("text"))
