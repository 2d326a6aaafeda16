"""Queries over the positions of tasks, with the geometry worked out again in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import text
from gambitflow.operators import geometry, moves
from gambitflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return geometry.positions(table(spark, d, "tasks"), "task_id", "input")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return geometry.lines(_positions(spark, d))


_DOTS = "split_part(trim(split_part(input, '|', 1)), ' ', 1)"
for _n in range(8, 0, -1):
    _DOTS = f"replace({_DOTS}, '{_n}', '{'.' * _n}')"
_P = f"""f AS (SELECT task_id AS pos_id, {_DOTS} AS p, split_part(trim(split_part(input, '|', 1)), ' ', 2) <> 'b' AS white FROM tasks),
b AS (SELECT pos_id, white, array_to_string(list_reverse(string_split(p, '/')), '') AS board FROM f WHERE regexp_full_match(p, '([pnbrqkPNBRQK.]{{8}}/){{7}}[pnbrqkPNBRQK.]{{8}}')),
pc AS (SELECT * FROM (SELECT pos_id, white, board, sq::INTEGER AS sq, board[sq + 1] AS piece FROM b, range(64) r(sq)) WHERE piece <> '.'),
sn AS (SELECT s::INTEGER AS s, chr((97 + s % 8)::INTEGER) || (s // 8 + 1) AS nm FROM range(64) r(s))""".replace("{{", "{").replace("}}", "}")
_OWN = "(pc.piece = upper(pc.piece))"
_RAYS = """dirs(df, dr, uses) AS (VALUES (0, 1, 'rq'), (0, -1, 'rq'), (1, 0, 'rq'), (-1, 0, 'rq'), (1, 1, 'bq'), (1, -1, 'bq'), (-1, 1, 'bq'), (-1, -1, 'bq')),
occ AS (SELECT pc.*, d.df, d.dr, k.k, pc.sq + d.df * k.k + 8 * d.dr * k.k AS t FROM pc JOIN dirs d ON contains(d.uses, lower(pc.piece)), range(1, 8) k(k)
  WHERE pc.sq % 8 + d.df * k.k BETWEEN 0 AND 7 AND pc.sq // 8 + d.dr * k.k BETWEEN 0 AND 7),
hit AS (SELECT *, board[t + 1] AS q, row_number() OVER (PARTITION BY pos_id, sq, df, dr ORDER BY k) AS n FROM occ WHERE board[t + 1] <> '.'),
two AS (SELECT a.*, z.t AS t2, z.q AS q2, z.k AS k2 FROM hit a JOIN hit z ON z.pos_id = a.pos_id AND z.sq = a.sq AND z.df = a.df AND z.dr = a.dr AND a.n = 1 AND z.n = 2)"""
_ENEMY = "((two.{0} = upper(two.{0})) <> (two.piece = upper(two.piece)))"
_BOTH = f"{_ENEMY.format('q')} AND {_ENEMY.format('q2')}"
_VALUE = "(CASE lower({0}) WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 100 END)"
_ATTACK = f"""{_RAYS},
leap(kind, df, dr) AS (SELECT 'n', * FROM (VALUES (1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)) UNION ALL SELECT 'k', * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))
  UNION ALL SELECT 'P', * FROM (VALUES (1, 1), (-1, 1)) UNION ALL SELECT 'p', * FROM (VALUES (1, -1), (-1, -1))),
att AS (SELECT occ.pos_id, occ.white, occ.board, occ.sq, occ.piece, occ.t FROM occ LEFT JOIN hit ON hit.pos_id = occ.pos_id AND hit.sq = occ.sq AND hit.df = occ.df AND hit.dr = occ.dr AND hit.n = 1 WHERE hit.k IS NULL OR occ.k <= hit.k
  UNION ALL SELECT pc.pos_id, pc.white, pc.board, pc.sq, pc.piece, pc.sq + l.df + 8 * l.dr FROM pc JOIN leap l ON l.kind = pc.piece OR (l.kind IN ('n', 'k') AND l.kind = lower(pc.piece))
  WHERE pc.sq % 8 + l.df BETWEEN 0 AND 7 AND pc.sq // 8 + l.dr BETWEEN 0 AND 7)"""
_NAME = "CASE WHEN {0} = upper({0}) THEN 'White ' ELSE 'Black ' END || CASE lower({0}) WHEN 'p' THEN 'Pawn' WHEN 'n' THEN 'Knight' WHEN 'b' THEN 'Bishop' WHEN 'r' THEN 'Rook' WHEN 'q' THEN 'Queen' ELSE 'King' END"


@query(f"WITH {_P} SELECT pos_id, nm AS square, {_NAME.format('piece')} AS piece FROM pc JOIN sn ON sn.s = pc.sq")
def board_pieces(spark: SparkSession, d: str) -> DataFrame:
    return geometry.pieces(_positions(spark, d)).select("pos_id", geometry.name(F.col("sq")).alias("square"), geometry.piece_name(F.col("piece")).alias("piece"))


@query(f"""WITH {_P}, g AS (SELECT pos_id, piece, string_agg('''' || nm || '''', ', ' ORDER BY nm) AS l FROM pc JOIN sn ON sn.s = pc.sq GROUP BY 1, 2)
SELECT pos_id, string_agg({_NAME.format('piece')} || ': [' || l || ']', ', ' ORDER BY strpos('KQRBNPkqrbnp', piece)) AS text FROM g GROUP BY 1""")
def board_arrangements(spark: SparkSession, d: str) -> DataFrame:
    return geometry.arrangement(_positions(spark, d))


@query(f"WITH {_P}, {_RAYS} SELECT pos_id, a.nm AS pinning, z.nm AS pinned, y.nm AS king, (k2 - k)::INTEGER AS gap FROM two JOIN sn a ON a.s = sq JOIN sn z ON z.s = t JOIN sn y ON y.s = t2 WHERE {_BOTH} AND lower(q2) = 'k'")
def board_pins(spark: SparkSession, d: str) -> DataFrame:
    return geometry.pins(_lines(spark, d))


@query(f"WITH {_P}, {_RAYS} SELECT DISTINCT pos_id, z.nm AS pinned FROM two JOIN sn z ON z.s = t WHERE {_BOTH} AND lower(q2) = 'k' AND k2 - k >= 2")
def board_structural_pins(spark: SparkSession, d: str) -> DataFrame:
    return geometry.structural_pins(_lines(spark, d))


@query(f"WITH {_P}, {_RAYS} SELECT pos_id, a.nm AS attacker, z.nm AS front, y.nm AS back FROM two JOIN sn a ON a.s = sq JOIN sn z ON z.s = t JOIN sn y ON y.s = t2 WHERE {_BOTH} AND {_VALUE.format('q')} > {_VALUE.format('q2')}")
def board_skewers(spark: SparkSession, d: str) -> DataFrame:
    return geometry.skewers(_lines(spark, d))


@query(f"""WITH {_P}, {_ATTACK} SELECT att.pos_id, a.nm AS forker, string_agg(z.nm, '-' ORDER BY z.nm) AS victims FROM att JOIN sn a ON a.s = sq JOIN sn z ON z.s = t
WHERE board[t + 1] <> '.' AND (board[t + 1] = upper(board[t + 1])) <> (piece = upper(piece)) GROUP BY att.pos_id, a.nm HAVING count(*) >= 2""")
def board_forks(spark: SparkSession, d: str) -> DataFrame:
    return geometry.forks(_lines(spark, d))


@query(f"""WITH {_P}, {_ATTACK} SELECT DISTINCT att.pos_id, {_NAME.format('piece')} || ' at ' || a.nm AS checker FROM att JOIN sn a ON a.s = sq
WHERE board[t + 1] = CASE WHEN white THEN 'K' ELSE 'k' END AND (piece = upper(piece)) <> white""")
def board_checkers(spark: SparkSession, d: str) -> DataFrame:
    return geometry.checkers(_lines(spark, d))


@query(f"""WITH {_P}, {_ATTACK}, pin AS (SELECT DISTINCT pos_id, t AS sq FROM two WHERE {_BOTH} AND lower(q2) = 'k' AND k2 - k >= 2),
r AS (SELECT att.pos_id, sq, t, CASE WHEN board[t + 1] = '.' THEN 'control' WHEN (board[t + 1] = upper(board[t + 1])) <> (piece = upper(piece)) THEN 'capture' WHEN lower(board[t + 1]) <> 'k' THEN 'protect' END AS kind
  FROM att WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.pos_id = att.pos_id AND pin.sq = att.sq))
SELECT pos_id, a.nm AS square, kind, string_agg(z.nm, ', ' ORDER BY z.nm) AS squares FROM r JOIN sn a ON a.s = sq JOIN sn z ON z.s = t WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def board_reach(spark: SparkSession, d: str) -> DataFrame:
    return geometry.reach(_lines(spark, d))


@query(f"""WITH {_P}, l AS (SELECT *, 'r' || sq // 8 AS line, sq % 8 AS place, lower(piece) IN ('r', 'q') AS fits FROM pc UNION ALL SELECT *, 'f' || sq % 8, sq // 8, lower(piece) IN ('r', 'q') FROM pc
  UNION ALL SELECT *, 'd' || (sq % 8 - sq // 8), sq % 8, lower(piece) IN ('b', 'q') FROM pc UNION ALL SELECT *, 'a' || (sq % 8 + sq // 8), 7 - sq % 8, lower(piece) IN ('b', 'q') FROM pc),
w AS (SELECT *, CASE WHEN fits AND coalesce(lag(fits) OVER o, false) AND (lag(piece) OVER o = upper(lag(piece) OVER o)) = (piece = upper(piece)) THEN 0 ELSE 1 END AS st FROM l WINDOW o AS (PARTITION BY pos_id, line ORDER BY place)),
g AS (SELECT *, sum(st) OVER (PARTITION BY pos_id, line ORDER BY place) AS run FROM w)
SELECT pos_id, string_agg(nm, '>' ORDER BY place) AS battery FROM g JOIN sn ON sn.s = sq WHERE fits GROUP BY pos_id, line, run HAVING count(*) >= 2""")
def board_batteries(spark: SparkSession, d: str) -> DataFrame:
    return geometry.batteries(_positions(spark, d))


@query()
def board_legal_moves(spark: SparkSession, d: str) -> DataFrame:
    """Legal moves need the rules; tested by published perft counts."""
    return moves.legal_moves(table(spark, d, "tasks").select("task_id", F.col("input").alias("fen"))).select(F.col("id").alias("task_id"), F.size("moves").alias("n"), F.array_join("moves", " ").alias("moves"))


@query()
def board_check_motifs(spark: SparkSession, d: str) -> DataFrame:
    m = moves.check_motifs(table(spark, d, "tasks").select("task_id", F.col("input").alias("fen")))
    return m.select(F.col("id").alias("task_id"), *[F.array_join(c, ", ").alias(c) for c in ("checks", "double_checks", "discovered")])


@query()
def answer_legality(spark: SparkSession, d: str) -> DataFrame:
    """Legality and outcome of the answers of all results to tactics tasks."""
    t = table(spark, d, "tasks").where("task_type like 'short_tactics%'").select(text.strip(F.lower("task_id")).alias("task"), F.col("input").alias("fen"))
    r = table(spark, d, "results").select("result_id", text.strip(F.lower("task_id")).alias("task"), F.col("extracted").alias("answer"), "error_type")
    rows = r.join(t, "task").select("result_id", "fen", "answer", "error_type")
    known = moves.legality(rows.select(F.concat_ws("\u0001", "result_id", "error_type"), "fen", "answer"))
    parts = F.split("id", "\u0001")
    return known.select(F.get(parts, F.lit(0)).cast("long").alias("result_id"), "legality", text.outcome(F.get(parts, F.lit(1)), F.col("legality")).alias("outcome"))


@query()
def normal_positions(spark: SparkSession, d: str) -> DataFrame:
    return moves.normal_fen(table(spark, d, "tasks").select("task_id", F.col("input").alias("fen"))).select(F.col("id").alias("task_id"), "final_fen")
