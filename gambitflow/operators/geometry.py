"""Board geometry as relations: attacks, pins, skewers, forks, batteries.

A position is one 64-character string (a1 first, '.' for an empty square). Each piece is
joined with a broadcast table of its lines - rays of sliders, single squares of leapers;
768 rows, whatever the data - and the first two pieces on each line are read from the
string. Every finding is then a filter; positions are never joined with positions.

Texts that are no placement give no pieces. The side to move defaults to white.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gambitflow.functions.board import KING, KNIGHT, NAMES, PAWN, RAYS, SLIDES
from gambitflow.functions.boards import board_difference, board_string  # noqa: F401
from gambitflow.functions.text import strip


def positions(df: DataFrame, id_col: str, fen: str) -> DataFrame:
    """pos_id, board, white (side to move)."""
    f = F.get(F.split(F.col(fen), r"\|", 2), F.lit(0))
    return df.select(F.col(id_col).alias("pos_id"), board_string(f).alias("board"), (F.coalesce(F.get(F.split(strip(f), r"\s+"), F.lit(1)), F.lit("w")) != "b").alias("white")).where("board is not null")


def pieces(pos: DataFrame) -> DataFrame:
    """pos_id, board, white, sq, piece, own (is it white's)."""
    at = F.filter(F.transform(F.split(F.col("board"), ""), lambda c, i: F.struct(i.alias("sq"), c.alias("piece"))), lambda x: ~x["piece"].isin(".", ""))
    return pos.select("pos_id", "board", "white", F.explode(at).alias("p")).select("pos_id", "board", "white", "p.sq", "p.piece", (F.col("p.piece") == F.upper("p.piece")).alias("own"))


def line_table(spark: SparkSession) -> DataFrame:
    """piece, sq, dir, squares: the lines that each piece on each square attacks along."""
    rows = []
    for sq in range(64):
        for kind, dirs in SLIDES.items():
            rows += [(x, sq, d, RAYS[d][sq]) for x in (kind, kind.upper()) for d in dirs if RAYS[d][sq]]
        for piece, targets in (("n", KNIGHT[sq]), ("N", KNIGHT[sq]), ("k", KING[sq]), ("K", KING[sq]), ("p", PAWN[False][sq]), ("P", PAWN[True][sq])):
            rows += [(piece, sq, "", [t]) for t in targets]
    return spark.createDataFrame(rows, "piece string, sq int, dir string, squares array<int>")


def name(c: Column) -> Column:
    """Square number -> name."""
    return F.concat(F.substring(F.lit("abcdefgh"), c % 8 + 1, F.lit(1)), (F.floor(c / 8) + 1).cast("string"))


def _piece(sq: Column) -> Column:
    return F.substring(F.col("board"), sq + 1, F.lit(1))


def lines(pos: DataFrame) -> DataFrame:
    """Each piece with each of its lines: the first and second piece met, with their places
    on the line (from 0), and the squares reached."""
    # the board goes into the lambda as an argument: Spark may push a filter on a lambda to one
    # side of the join although the lambda uses a column of the other one
    letters = F.zip_with("squares", F.array_repeat("board", F.size("squares")), lambda s, b: F.struct(s.alias("sq"), F.substring(b, s + 1, F.lit(1)).alias("piece")))
    occ = F.filter(F.transform(letters, lambda x, i: F.struct(i.alias("step"), x["sq"].alias("sq"), x["piece"].alias("piece"))), lambda x: x["piece"] != ".")
    joined = pieces(pos).join(F.broadcast(line_table(pos.sparkSession)), ["piece", "sq"])
    met = joined.withColumn("occ", occ).withColumn("first", F.get("occ", F.lit(0))).withColumn("second", F.get("occ", F.lit(1)))
    reached = F.when(F.col("first").isNull(), F.col("squares")).otherwise(F.slice("squares", F.lit(1), F.col("first.step") + 1))
    return met.select("pos_id", "board", "white", "sq", "piece", "own", "dir", "first", "second", reached.alias("reached"))


def _enemy(c: Column) -> Column:
    """Is a piece letter of the other side than the row's piece?"""
    return (c == F.upper(c)) != F.col("own")


def _sliders(ls: DataFrame) -> DataFrame:
    return ls.where(F.lower("piece").isin("b", "r", "q") & F.col("second").isNotNull())


def pins(ls: DataFrame) -> DataFrame:
    """pos_id, pinning, pinned, king, gap: absolute pins of either side. gap is the
    distance of the pinned piece from its king."""
    hit = _enemy(F.col("first.piece")) & _enemy(F.col("second.piece")) & (F.lower("second.piece") == "k")
    return _sliders(ls).where(hit).select("pos_id", name(F.col("sq")).alias("pinning"), name(F.col("first.sq")).alias("pinned"), name(F.col("second.sq")).alias("king"), (F.col("second.step") - F.col("first.step")).alias("gap"))


def structural_pins(ls: DataFrame) -> DataFrame:
    """pos_id, pinned: the stricter sense, in which a piece next to its king is never pinned."""
    return pins(ls).where("gap >= 2").select("pos_id", "pinned").distinct()


def skewers(ls: DataFrame) -> DataFrame:
    """pos_id, attacker, front, back: two enemy pieces on a line, the nearer of more value."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9, "k": 100}.items() for x in kv]), F.lower(c))
    hit = _enemy(F.col("first.piece")) & _enemy(F.col("second.piece")) & (value(F.col("first.piece")) > value(F.col("second.piece")))
    return _sliders(ls).where(hit).select("pos_id", name(F.col("sq")).alias("attacker"), name(F.col("first.sq")).alias("front"), name(F.col("second.sq")).alias("back"))


def forks(ls: DataFrame) -> DataFrame:
    """pos_id, forker, victims: a piece that attacks two enemy pieces or more."""
    hit = ls.where(_enemy(F.col("first.piece")))
    return hit.groupBy("pos_id", "sq").agg(F.array_join(F.array_sort(F.collect_list(name(F.col("first.sq")))), "-").alias("victims"), F.count("*").alias("n")).where("n >= 2").select("pos_id", name(F.col("sq")).alias("forker"), "victims")


def checkers(ls: DataFrame) -> DataFrame:
    """pos_id, checker: pieces that attack the king of the side to move, as 'Color Piece at sq'."""
    king = F.when(F.col("white"), F.lit("K")).otherwise(F.lit("k"))
    return ls.where((F.col("first.piece") == king) & (F.col("own") != F.col("white"))).select("pos_id", F.concat(piece_name(F.col("piece")), F.lit(" at "), name(F.col("sq"))).alias("checker")).distinct()


def piece_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.concat(F.when(c == F.upper(c), F.lit("White ")).otherwise(F.lit("Black ")), F.element_at(names, F.lower(c)))


def reach(ls: DataFrame) -> DataFrame:
    """pos_id, square, kind, squares: what each piece captures, controls and protects. A
    pinned piece (in the stricter sense) does none; the enemy king counts as capturable,
    the own king not as protected."""
    t = F.explode("reached").alias("t")
    free = ls.select("pos_id", "board", name(F.col("sq")).alias("square"), "own", t).join(structural_pins(ls).withColumnRenamed("pinned", "square"), ["pos_id", "square"], "left_anti")
    on = _piece(F.col("t"))
    kind = F.when(on == ".", F.lit("control")).when(_enemy(on), F.lit("capture")).when(F.lower(on) != "k", F.lit("protect"))
    return free.withColumn("kind", kind).where("kind is not null").groupBy("pos_id", "square", "kind").agg(F.array_join(F.array_sort(F.collect_list(name(F.col("t")))), ", ").alias("squares"))


def board_lines() -> list[tuple[int, int, int]]:
    """(line, place, square) of the 42 ranks, files and diagonals of two squares or more."""
    out, no = [], 0
    seeds = [(d, s) for d in ("E", "N", "NE", "NW") for s in range(64)]
    back = {"E": "W", "N": "S", "NE": "SW", "NW": "SE"}
    for d, s in seeds:
        if not RAYS[back[d]][s] and RAYS[d][s]:
            out += [(no, k, t) for k, t in enumerate([s, *RAYS[d][s]])]
            no += 1
    return out


def batteries(pos: DataFrame) -> DataFrame:
    """pos_id, battery: maximal runs of two or more sliders of one side on a line that they
    all can use, with nothing but empty squares between, in line order."""
    spark = pos.sparkSession
    kinds = {0: "rq", 1: "bq"}
    dims = [(no, k, sq, kinds[int(no >= 16)]) for no, k, sq in board_lines()]
    on = pieces(pos).join(F.broadcast(spark.createDataFrame(dims, "line int, place int, sq int, uses string")), "sq")
    fits = F.contains(F.col("uses"), F.lower("piece"))
    w = Window.partitionBy("pos_id", "line").orderBy("place")
    joined = on.select("pos_id", "line", "place", "sq", "own", fits.alias("fits"))
    joined = joined.withColumn("starts", (~(F.col("fits") & F.coalesce(F.lag("fits").over(w), F.lit(False)) & (F.lag("own").over(w) == F.col("own")))).cast("int"))
    runs = joined.withColumn("run", F.sum(F.coalesce("starts", F.lit(1))).over(w)).where("fits")
    chain = F.transform(F.array_sort(F.collect_list(F.struct("place", "sq"))), lambda x: name(x["sq"]))
    return runs.groupBy("pos_id", "line", "run").agg(F.array_join(chain, ">").alias("battery"), F.count("*").alias("n")).where("n >= 2").select("pos_id", "battery")


def arrangement(pos: DataFrame) -> DataFrame:
    """pos_id, text: pieces by color and kind with their sorted squares."""
    order = {p: k for k, p in enumerate("KQRBNPkqrbnp")}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("piece"))
    per = pieces(pos).groupBy("pos_id", "piece").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), name(F.col("sq")), F.lit("'")))), ", ").alias("at"))
    part = F.struct(rank.alias("k"), F.concat(piece_name(F.col("piece")), F.lit(": ["), F.col("at"), F.lit("]")).alias("t"))
    return per.groupBy("pos_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ", ").alias("text"))
