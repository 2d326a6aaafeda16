"""Queries that make question tasks, with the same in DuckDB's SQL where geometry suffices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import prompts, text
from gambitflow.functions.prompts import MOTIFS, STRUCTURAL, Kind
from gambitflow.operators import choices, taskgen
from gambitflow.plans.board_queries import _ATTACK, _BOTH, _NAME, _P, _RAYS, _VALUE
from gambitflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select(F.col("task_id").alias("puzzle_id"), F.col("input").alias("fen"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _quota_sql(kinds: list[Kind]) -> str:
    """Kind by kind the first N of candidates `c` that no kind before has taken."""
    parts = []
    for i, k in enumerate(kinds):
        before = " AND ".join(f"pos_id NOT IN (SELECT pos_id FROM t{j})" for j in range(i)) or "true"
        parts.append(f"t{i} AS (SELECT *, row_number() OVER (ORDER BY o, pos_id) - 1 AS no FROM c WHERE kind = '{k.name}' AND {before} QUALIFY no < {N})")
    rows = []
    for i, k in enumerate(kinds):
        asked = f"replace(replace(replace({_text(prompts.template(k))}, '{{fen}}', fen), '{{piece}}', coalesce(piece, '')), '{{square}}', coalesce(square, ''))"
        meta = "'{\"puzzle_id\":\"' || pos_id || '\"'" + (" || coalesce(',\"target_square\":\"' || square || '\",\"piece\":\"' || piece || '\"', '')") + (f" || ',\"{k.counted}\":' || n" if k.counted else "") + " || '}'"
        rows.append(
            f"SELECT '{k.name}_' || printf('%04d', no) AS task_id, '{k.name}' AS task_type, '{k.category}' AS task_category, fen AS input, {asked} AS question, "
            f"[{', '.join(map(_text, k.examples))}] AS format_examples, answer AS correct_answer, '{k.answer_type}' AS answer_type, {meta} AS metadata FROM t{i} JOIN fens USING (pos_id)"
        )
    return ",\n".join(parts) + "\n" + "\nUNION ALL ".join(rows)


_FENS = "fens AS (SELECT task_id AS pos_id, trim(split_part(input, '|', 1)) AS fen FROM tasks)"
_C = "c AS (SELECT kind, pos_id, answer, n, square, piece, md5(pos_id || ':42') AS o FROM cand WHERE answer <> '')"
_MOTIFS_SQL = [k for k in MOTIFS if k.name in ("motifs_pin", "motifs_fork", "motifs_battery", "motifs_skewer")]


def _items(kind: str, relation: str, item: str) -> str:
    return f"SELECT '{kind}' AS kind, pos_id, string_agg(DISTINCT {item}, ', ' ORDER BY {item}) AS answer, count(DISTINCT {item}) AS n, NULL::VARCHAR AS square, NULL::VARCHAR AS piece FROM ({relation}) GROUP BY pos_id"


_BATTERY = """SELECT pos_id, string_agg(nm, '>' ORDER BY place) AS i FROM g JOIN sn ON sn.s = sq WHERE fits GROUP BY pos_id, line, run HAVING count(*) >= 2"""
_BATTERY_CTE = """l AS (SELECT *, 'r' || sq // 8 AS line, sq % 8 AS place, lower(piece) IN ('r', 'q') AS fits FROM pc UNION ALL SELECT *, 'f' || sq % 8, sq // 8, lower(piece) IN ('r', 'q') FROM pc
  UNION ALL SELECT *, 'd' || (sq % 8 - sq // 8), sq % 8, lower(piece) IN ('b', 'q') FROM pc UNION ALL SELECT *, 'a' || (sq % 8 + sq // 8), 7 - sq % 8, lower(piece) IN ('b', 'q') FROM pc),
w AS (SELECT *, CASE WHEN fits AND coalesce(lag(fits) OVER o, false) AND (lag(piece) OVER o = upper(lag(piece) OVER o)) = (piece = upper(piece)) THEN 0 ELSE 1 END AS st FROM l WINDOW o AS (PARTITION BY pos_id, line ORDER BY place)),
g AS (SELECT *, sum(st) OVER (PARTITION BY pos_id, line ORDER BY place) AS run FROM w)"""


@query(f"""WITH {_P}, {_FENS}, {_ATTACK}, {_BATTERY_CTE},
cand AS ({_items('motifs_pin', f"SELECT pos_id, a.nm || '>' || z.nm || '>' || y.nm AS i FROM two JOIN sn a ON a.s = sq JOIN sn z ON z.s = t JOIN sn y ON y.s = t2 WHERE {_BOTH} AND lower(q2) = 'k'", 'i')}
UNION ALL {_items('motifs_fork', "SELECT att.pos_id, a.nm || '>' || string_agg(z.nm, '-' ORDER BY z.nm) AS i FROM att JOIN sn a ON a.s = sq JOIN sn z ON z.s = t WHERE board[t + 1] <> '.' AND (board[t + 1] = upper(board[t + 1])) <> (piece = upper(piece)) GROUP BY att.pos_id, a.nm HAVING count(*) >= 2", 'i')}
UNION ALL {_items('motifs_battery', _BATTERY, 'i')}
UNION ALL {_items('motifs_skewer', f"SELECT pos_id, a.nm || '>' || z.nm || '>' || y.nm AS i FROM two JOIN sn a ON a.s = sq JOIN sn z ON z.s = t JOIN sn y ON y.s = t2 WHERE {_BOTH} AND {_VALUE.format('q')} > {_VALUE.format('q2')}", 'i')}),
{_C},
{_quota_sql(_MOTIFS_SQL)}""")
def motif_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of the motifs that geometry alone tells."""
    return taskgen.position_tasks(_rows(spark, d), _MOTIFS_SQL, N)


_STRUCTURAL_SQL = [k for k in STRUCTURAL if k.name not in ("structural_legal_move_piece", "structural_legal_move_all", "structural_check_in_1")]


def _drawn_sql(kind: str, what: str) -> str:
    return f"""SELECT '{kind}' AS kind, m.pos_id, r.squares AS answer, len(string_split(r.squares, ', ')) AS n, m.square, m.piece FROM (
  SELECT x.pos_id, a.nm AS square, {_NAME.format('x.piece')} AS piece, x.sq FROM (SELECT pos_id, sq, piece, row_number() OVER (PARTITION BY pos_id ORDER BY sq) - 1 AS k, count(*) OVER (PARTITION BY pos_id) AS size FROM pc WHERE lower(piece) NOT IN ('p', 'k')) x JOIN sn a ON a.s = x.sq
  WHERE k = ('0x' || substr(md5(x.pos_id || ':{kind}:42'), 1, 8))::BIGINT % size) m JOIN rr r ON r.pos_id = m.pos_id AND r.sq = m.sq AND r.kind = '{what}'"""


@query(f"""WITH {_P}, {_FENS}, {_ATTACK}, pin AS (SELECT DISTINCT pos_id, t AS sq FROM two WHERE {_BOTH} AND lower(q2) = 'k' AND k2 - k >= 2),
r0 AS (SELECT att.pos_id, sq, t, CASE WHEN board[t + 1] = '.' THEN 'control' WHEN (board[t + 1] = upper(board[t + 1])) <> (piece = upper(piece)) THEN 'capture' WHEN lower(board[t + 1]) <> 'k' THEN 'protect' END AS kind
  FROM att WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.pos_id = att.pos_id AND pin.sq = att.sq)),
rr AS (SELECT pos_id, r0.sq, kind, string_agg(z.nm, ', ' ORDER BY z.nm) AS squares FROM r0 JOIN sn z ON z.s = t WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
g0 AS (SELECT pos_id, piece, string_agg('''' || nm || '''', ', ' ORDER BY nm) AS l FROM pc JOIN sn ON sn.s = pc.sq GROUP BY 1, 2),
cand AS (SELECT 'structural_piece_arrangement' AS kind, pos_id, string_agg({_NAME.format('piece')} || ': [' || l || ']', ', ' ORDER BY strpos('KQRBNPkqrbnp', piece)) AS answer, 1 AS n, NULL::VARCHAR AS square, NULL::VARCHAR AS piece FROM g0 GROUP BY pos_id
UNION ALL {_items('structural_check_detection', f"SELECT DISTINCT att.pos_id, {_NAME.format('piece')} || ' at ' || a.nm AS i FROM att JOIN sn a ON a.s = sq WHERE board[t + 1] = CASE WHEN white THEN 'K' ELSE 'k' END AND (piece = upper(piece)) <> white", 'i')}
UNION ALL {_drawn_sql('structural_capture_squares', 'capture')} UNION ALL {_drawn_sql('structural_protect_squares', 'protect')} UNION ALL {_drawn_sql('structural_control_squares', 'control')}),
{_C},
{_quota_sql(_STRUCTURAL_SQL)}""")
def structural_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of the structural kinds that geometry alone tells."""
    return taskgen.position_tasks(_rows(spark, d), _STRUCTURAL_SQL, N)


@query()
def rule_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of all kinds, those that need the rules of the game included."""
    return taskgen.position_tasks(_rows(spark, d), [*STRUCTURAL, *MOTIFS], N)


_K = prompts.JUDGEMENT
_OPTIONS = ", ".join(map(str, text.EVAL_BANDS.values()))


@query(f"""WITH v AS (SELECT input AS fen, try_cast(correct_answer AS INTEGER) AS cp, substr(md5(array_to_string(regexp_split_to_array(trim(input), '\\s+')[1:4], ' ')), 1, 16) AS position_id FROM tasks WHERE task_type LIKE 'position_judgement%' AND try_cast(correct_answer AS INTEGER) IS NOT NULL),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY fen, cp) AS k FROM v) WHERE k = 1),
b AS (SELECT *, CASE WHEN abs(cp + 400) <= 50 THEN 'losing' WHEN abs(cp + 200) <= 50 THEN 'disadvantage' WHEN abs(cp) <= 50 THEN 'neutral' WHEN abs(cp - 200) <= 50 THEN 'advantage' WHEN abs(cp - 400) <= 50 THEN 'winning' END AS band FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(position_id || ':42'), position_id) - 1 AS no FROM b WHERE band IS NOT NULL)
SELECT 'position_judgement_' || band || '_' || printf('%04d', no) AS task_id, 'position_judgement_' || band AS task_type, 'Position Judgement' AS task_category, fen AS input,
  replace(replace({_text(prompts.template(_K))}, '{{fen}}', fen), '{{options}}', '{_OPTIONS}') AS question, ['400', '-200'] AS format_examples,
  CASE band WHEN 'losing' THEN '-400' WHEN 'disadvantage' THEN '-200' WHEN 'neutral' THEN '0' WHEN 'advantage' THEN '200' ELSE '400' END AS correct_answer, 'single' AS answer_type,
  '{{"position_id":"' || position_id || '","actual_evaluation":' || cp || ',"depth":0,"knodes":null,"best_line":null,"category":"' || band || '","options":[-400,-200,0,200,400]}}' AS metadata FROM n WHERE no < {N}""")
def judgement_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks").where("task_type like 'position_judgement%'")
    evals = t.select(F.col("input").alias("fen"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("knodes"), F.col("correct_answer").try_cast("int").alias("cp"), F.lit(None).cast("string").alias("line")).where("cp is not null")
    return taskgen.judgement_tasks(evals, N)


@query()
def prompts_with_context(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with pieces and legal moves in the place of the context."""
    t = table(spark, d, "tasks").withColumn("format_examples", F.from_json("format_examples", "array<string>"))
    return taskgen.with_context(t)


def _comments(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    piece = F.regexp_extract(F.lower("text"), r"\b(king|queen|rook|bishop|knight|pawn)\b", 1)
    return choices.prepared(doc.select(
        "doc_id", F.col("text").alias("comment"), F.lit(None).cast("string").alias("cleaned_comment"), text.keywords_in(F.col("text"), text.CHESS_WORDS).alias("keywords"), piece.alias("move_piece"),
        F.regexp_extract("text", r"\b(\d{1,2})\. ", 1).alias("move_number"), F.lit("").alias("fen_before"), F.lit("").alias("fen_after"), F.lit("").alias("move_uci"), F.lit(None).cast("string").alias("side_to_move"),
    ), "doc_id")


@query()
def keyword_choices(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice tasks with distractors that share a keyword."""
    return choices.choice_tasks(_comments(spark, d), "keyword", N)


@query()
def stage_choices(spark: SparkSession, d: str) -> DataFrame:
    """The same with distractors of the same piece and stage of the game."""
    return choices.choice_tasks(_comments(spark, d), "piece_stage", N)


@query()
def vector_choices(spark: SparkSession, d: str) -> DataFrame:
    """The same with the nearest vectors as distractors."""
    return choices.choice_tasks(_comments(spark, d), "embedding", N, vectors=table(spark, d, "embeddings"))
