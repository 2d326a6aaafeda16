"""Question tasks from positions, games, puzzles and engine evaluations.

Every kind is a relation of candidates - position, answer, number of answers, target -
from the geometry or rules operators; quotas choose among them, one task a position; the
question is put together by column expressions.

Defined results: positions that can't be read give no task; a kind without an answer on a
position is no candidate there; list answers are sorted, as they are compared as sets;
choices that were random are drawn by a hash of the position, so any engine repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gambitflow.functions import prompts, text
from gambitflow.functions.prompts import Kind
from gambitflow.operators import geometry, moves, sampling
from gambitflow.session import materialise

TASK = ["task_id", "task_type", "task_category", "input", "question", "format_examples", "correct_answer", "answer_type", "metadata"]


def _listed(found: DataFrame, item: Column, sep: str = ", ") -> DataFrame:
    """pos_id, answer, n of the items of each position."""
    return found.groupBy("pos_id").agg(F.array_join(F.array_sort(F.collect_set(item)), sep).alias("answer"), F.count_distinct(item).alias("n"))


def _chain(*cols: str) -> Column:
    return F.concat_ws(">", *cols)


def _reach_of(kind: str, what: str) -> Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]:
    """What one piece, drawn among those that are no pawn and no king, reaches."""

    def candidates(pos: DataFrame, ls: DataFrame, rules: DataFrame | None) -> DataFrame:
        mine = geometry.pieces(pos).where("lower(piece) not in ('p', 'k')").groupBy("pos_id").agg(F.array_sort(F.collect_list(F.struct("sq", "piece"))).alias("c"))
        one = mine.withColumn("t", F.element_at("c", (sampling.drawn(F.col("pos_id"), kind, F.size("c")) + 1).cast("int")))
        one = one.select("pos_id", geometry.name(F.col("t.sq")).alias("square"), geometry.piece_name(F.col("t.piece")).alias("piece"))
        found = geometry.reach(ls).where(F.col("kind") == what).select("pos_id", "square", F.col("squares").alias("answer"))
        return one.join(found, ["pos_id", "square"]).withColumn("n", F.size(F.split("answer", ", ")).cast("long"))

    return candidates


def _legal(rules: DataFrame, of_one: bool) -> DataFrame:
    found = rules.where("size(moves) > 0")
    if of_one:
        starts = F.array_sort(F.array_distinct(F.transform("moves", lambda m: F.substring(m, 1, 2))))
        found = found.withColumn("s", starts).withColumn("square", F.element_at("s", (sampling.drawn(F.col("pos_id"), "structural_legal_move_piece", F.size("s")) + 1).cast("int")))
        found = found.withColumn("moves", F.filter("moves", lambda m: F.substring(m, 1, 2) == F.col("square")))
    rest = ["square"] if of_one else []
    return found.select("pos_id", *rest, F.array_join("moves", ", ").alias("answer"), F.size("moves").cast("long").alias("n"))


def _motif(rules: DataFrame, column: str) -> DataFrame:
    return rules.where(F.size(column) > 0).select("pos_id", F.array_join(F.array_sort(column), ", ").alias("answer"), F.size(column).cast("long").alias("n"))


#: Kinds that need the rules of the game.
RULES = {"structural_legal_move_piece", "structural_legal_move_all", "structural_check_in_1", "motifs_discovered_check", "motifs_double_check"}
#: kind -> (positions, their lines, what the rules tell) -> pos_id, answer, n and, where drawn, square and piece.
#: Further kinds can be entered here.
CANDIDATES: dict[str, Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]] = {
    "structural_piece_arrangement": lambda pos, ls, rules: geometry.arrangement(pos).select("pos_id", F.col("text").alias("answer"), F.lit(1).cast("long").alias("n")),
    "structural_legal_move_piece": lambda pos, ls, rules: _legal(rules, True),
    "structural_legal_move_all": lambda pos, ls, rules: _legal(rules, False),
    "structural_check_detection": lambda pos, ls, rules: _listed(geometry.checkers(ls), F.col("checker")),
    "structural_check_in_1": lambda pos, ls, rules: _motif(rules, "checks"),
    "structural_capture_squares": _reach_of("structural_capture_squares", "capture"),
    "structural_protect_squares": _reach_of("structural_protect_squares", "protect"),
    "structural_control_squares": _reach_of("structural_control_squares", "control"),
    "motifs_pin": lambda pos, ls, rules: _listed(geometry.pins(ls), _chain("pinning", "pinned", "king")),
    "motifs_fork": lambda pos, ls, rules: _listed(geometry.forks(ls), _chain("forker", "victims")),
    "motifs_battery": lambda pos, ls, rules: _listed(geometry.batteries(pos), F.col("battery")),
    "motifs_skewer": lambda pos, ls, rules: _listed(geometry.skewers(ls), _chain("attacker", "front", "back")),
    "motifs_discovered_check": lambda pos, ls, rules: _motif(rules, "discovered"),
    "motifs_double_check": lambda pos, ls, rules: _motif(rules, "double_checks"),
}


def _task(kind: Kind, name: Column, no: Column, input_: Column, asked: Column, answer: Column, metadata: Column) -> list[Column]:
    return [
        F.concat(name, F.lit("_"), F.format_string("%04d", no)).alias("task_id"), name.alias("task_type"), F.lit(kind.category).alias("task_category"), input_.alias("input"), asked.alias("question"),
        F.array(*[F.lit(e) for e in kind.examples]).alias("format_examples"), answer.alias("correct_answer"), F.lit(kind.answer_type).alias("answer_type"), F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"),
    ]


def position_tasks(rows: DataFrame, kinds: list[Kind], n: int = 100, id_col: str = "puzzle_id", fen: str = "fen", seed: int = 42, used: DataFrame | None = None) -> DataFrame:
    """Tasks of the given kinds, n of each and at most one a position. Positions are tried in
    shuffled order, and each goes to the first kind in order that has a place left."""
    src = rows if used is None else sampling.unused(rows, used, id_col)
    pos = geometry.positions(src, id_col, fen).join(src.select(F.col(id_col).alias("pos_id"), F.trim(F.get(F.split(F.col(fen), r"\|", 2), F.lit(0))).alias("fen")), "pos_id")
    ls = geometry.lines(pos)
    # the rules are asked once for all kinds, and kept for them
    rules = materialise(moves.analysed(pos.select("pos_id", "fen")).withColumnRenamed("id", "pos_id"), "position-rules") if RULES & {k.name for k in kinds} else None
    found = None
    for kind in kinds:
        c = CANDIDATES[kind.name](pos, ls, rules).where("answer != ''")
        c = c.select(F.lit(kind.name).alias("kind"), "pos_id", "answer", "n", *[F.col(x) if x in c.columns else F.lit(None).cast("string").alias(x) for x in ("square", "piece")])
        found = c if found is None else found.unionByName(c)
    found = materialise(found.withColumn("o", sampling.shuffled(F.col("pos_id"), seed)), "task-candidates")
    chosen = sampling.quotas(found, [k.name for k in kinds], n, "pos_id", "o").join(found.drop("o"), ["kind", "pos_id"]).join(pos.select("pos_id", "fen"), "pos_id")
    of = lambda part: F.coalesce(*[F.when(F.col("kind") == k.name, part(k)) for k in kinds])
    metadata = lambda k: F.to_json(F.struct(*[F.col(c).alias(a) for c, a in (("pos_id", "puzzle_id"), ("square", "target_square"), ("piece", "piece"), *([("n", k.counted)] if k.counted else []))]))
    return chosen.select(
        F.concat("kind", F.lit("_"), F.format_string("%04d", "no")).alias("task_id"), F.col("kind").alias("task_type"), of(lambda k: F.lit(k.category)).alias("task_category"), F.col("fen").alias("input"),
        of(lambda k: prompts.question(k, fen=F.col("fen"), piece=F.coalesce("piece", F.lit("")), square=F.coalesce("square", F.lit("")))).alias("question"),
        of(lambda k: F.array(*[F.lit(e) for e in k.examples])).alias("format_examples"), F.col("answer").alias("correct_answer"), of(lambda k: F.lit(k.answer_type)).alias("answer_type"), of(metadata).alias("metadata"),
    )


def structural_tasks(rows: DataFrame, n: int = 100, **options) -> DataFrame:
    return position_tasks(rows, prompts.STRUCTURAL, n, **options)


def motif_tasks(rows: DataFrame, n: int = 100, **options) -> DataFrame:
    return position_tasks(rows, prompts.MOTIFS, n, **options)


#: How many plies the parts of a game have that are tracked.
TRACKED = {"short": (1, 5), "mid": (6, 10), "long": (11, 15)}


def tracking_tasks(games: DataFrame, n: int = 100, skip: int = 30, seed: int = 42) -> DataFrame:
    """The position after some moves of a game. A game gives one task at most, to the first
    length with a place left that it is long enough for; each draws its own number of plies.
    games: game_id, plies (with uci and fen_after)."""
    plies = F.size("plies")
    lengths = F.array(*[F.struct(F.lit(k).alias("kind"), (sampling.drawn(F.col("game_id"), k, F.lit(b - a + 1), seed) + a).cast("int").alias("k")) for k, (a, b) in TRACKED.items()])
    c = games.withColumn("x", F.explode(lengths)).where(plies >= skip + F.col("x.k")).select("game_id", "x.kind", "x.k", sampling.shuffled(F.col("game_id"), seed).alias("o"), F.element_at("plies", skip)["fen_after"].alias("fen"), F.transform(F.slice("plies", F.lit(skip + 1), F.col("x.k")), lambda p: p["uci"]).alias("moves"))
    chosen = sampling.quotas(c, list(TRACKED), n, "game_id", "o").join(c.drop("o"), ["kind", "game_id"])
    played = moves.played(chosen.select(F.concat("kind", F.lit("\u0001"), "game_id").alias("id"), "fen", "moves"))
    done = chosen.withColumn("id", F.concat("kind", F.lit("\u0001"), "game_id")).join(played, "id").where("final_fen is not null")
    text_ = F.array_join("moves", " ")
    k = prompts.TRACKING
    meta = F.struct("game_id", F.col("moves").alias("moves_uci"), F.col("san").alias("moves_san"), F.size("moves").alias("track_length"))
    return done.select(*_task(k, F.concat(F.lit(k.name + "_"), "kind"), F.col("no"), F.concat("fen", F.lit(" | "), text_), prompts.question(k, fen=F.col("fen"), moves=text_), F.col("final_fen"), meta))


def pre_moved(puzzles: DataFrame) -> DataFrame:
    """Adds `start` and `solution`: the position after the first move of a puzzle, and its
    second move. Puzzles without both, or whose position can't be read, are left out."""
    parts = F.split(F.trim("Moves"), r"\s+")
    first = moves.played(puzzles.select("PuzzleId", F.col("FEN").alias("fen"), F.slice(parts, 1, 1).alias("moves")))
    return puzzles.join(first.select(F.col("id").alias("PuzzleId"), F.col("final_fen").alias("start")), "PuzzleId").withColumn("solution", F.try_element_at(parts, F.lit(2))).where("start is not null and solution is not null")


def _tactics(chosen: DataFrame, name: Column, extra: list[str]) -> DataFrame:
    k = prompts.TACTICS
    meta = F.struct(
        F.col("PuzzleId").alias("puzzle_id"), F.col("Rating").alias("rating"), F.split("Themes", " ").alias("themes"), *[F.col("kind").alias(e) for e in extra], F.col("RatingDeviation").alias("rating_deviation"),
        F.col("Popularity").alias("popularity"), F.size(F.split("Moves", " ")).alias("pv_length"), F.col("Moves").alias("pv"),
    )
    return pre_moved(chosen).select(*_task(k, name, F.col("no"), F.col("start"), prompts.question(k, fen=F.col("start")), F.col("solution"), meta))


def rating_tasks(puzzles: DataFrame, n: int = 100) -> DataFrame:
    """Best-move tasks, n of each rating level, in the shuffled order `o` of the puzzles."""
    level = puzzles.withColumn("kind", text.rating_level(F.col("Rating"))).where("kind is not null")
    chosen = sampling.quotas(level.select("kind", "PuzzleId", "o"), ["beginner", "intermediate", "advanced", "expert"], n, "PuzzleId", "o").join(level.drop("kind"), "PuzzleId")
    return _tactics(chosen, F.concat(F.lit("short_tactics_rating_"), "kind"), [])


def theme_tasks(puzzles: DataFrame, themes: list[str], n: int = 25, used: DataFrame | None = None) -> DataFrame:
    """Best-move tasks, n of each theme; a puzzle goes to its first theme, by name, that has
    a place left. used: puzzles of an earlier pass (PuzzleId)."""
    rows = puzzles if used is None else sampling.unused(puzzles, used, "PuzzleId")
    each = rows.select("PuzzleId", "o", F.explode(F.array_distinct(F.split("Themes", " "))).alias("kind"))
    chosen = sampling.quotas(each, sorted(set(themes)), n, "PuzzleId", "o").join(rows, "PuzzleId")
    return _tactics(chosen, F.concat(F.lit("short_tactics_theme_"), "kind"), ["primary_theme"])


def judgement_tasks(evals: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Centipawn tasks, n of each band, from fen, depth, knodes, cp, line. Positions are told
    apart by their hash, the first one by depth and text of each counts."""
    rows = evals.withColumn("position_id", text.position_hash(F.col("fen")))
    one = sampling.first_of(rows.withColumn("_o", F.struct((-F.col("depth")).alias("d"), "fen")), ["position_id"], "_o").drop("_o")
    banded = one.withColumn("band", text.eval_band(F.col("cp"))).where("band is not null")
    few = sampling.per_group(banded, ["band"], n, "position_id", seed).withColumn("no", F.col("rank") - 1)
    options = list(text.EVAL_BANDS.values())
    k = prompts.JUDGEMENT
    best = text.nearest_option(F.col("cp"), F.array(*[F.lit(o) for o in options])).cast("string")
    meta = F.struct("position_id", F.col("cp").alias("actual_evaluation"), "depth", "knodes", F.col("line").alias("best_line"), F.col("band").alias("category"), F.array(*[F.lit(o) for o in options]).alias("options"))
    return few.select(*_task(k, F.concat(F.lit(k.name + "_"), "band"), F.col("no"), F.col("fen"), prompts.question(k, fen=F.col("fen"), options=F.lit(", ".join(map(str, options)))), best, meta))


def with_context(tasks: DataFrame, group: int = 1) -> DataFrame:
    """task_id, prompt: the questions of tasks with their context filled in: pieces and legal
    moves of the position before any bar, nothing where it can't be read."""
    fen = F.trim(F.get(F.split("input", r"\|", 2), F.lit(0)))
    pos = geometry.positions(tasks, "task_id", "input")
    pieces = geometry.arrangement(pos).select(F.col("pos_id").alias("task_id"), F.col("text").alias("arrangement"))
    legal = moves.legal_moves(tasks.select("task_id", fen.alias("fen"))).select(F.col("id").alias("task_id"), "moves")
    rows = tasks.join(pieces, "task_id", "left").join(legal, "task_id", "left")
    context = prompts.context_block(F.col("arrangement"), F.col("moves"))
    return rows.select("task_id", text.resolve_prompt(F.col("question"), F.col("format_examples"), group, context).alias("prompt"))
