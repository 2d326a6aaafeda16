"""Round trips: tables written in the form of raw inputs and read again, results entered into
a warehouse, streams folded; the SQL says what must come back. Also text functions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import boards, text
from gambitflow.operators import ingest, sampling
from gambitflow.operators.deliveries import clean_identifier
from gambitflow.plans.benchmark_queries import _key, _strip
from gambitflow.session import materialise, scratch
from gambitflow.sources import readers, sinks
from gambitflow.sources.tables import table
from gambitflow.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# files --------------------------------------------------------------------------------------
@query("""SELECT row_number() OVER (ORDER BY task_id) AS ord, task_id, task_type, task_category, input, question, correct_answer, answer_type, metadata FROM tasks""")
def task_files(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written as JSON lines in order and read back with their places."""
    at = scratch(spark, "task-files")
    t = table(spark, d, "tasks").withColumn("format_examples", F.from_json("format_examples", "array<string>"))
    sinks.write_lines(t.select("task_id", "task_type", "task_category", "input", "question", "format_examples", "correct_answer", "answer_type", "metadata", F.col("task_id").alias("o")), at, "o")
    back = readers.tasks(spark, at, pattern="*")
    return back.select("ord", "task_id", "task_type", "task_category", "input", "question", "correct_answer", "answer_type", "metadata")


@query(f"""SELECT {_key('task_id')} AS task_id, max(result_id) AS result_id FROM results GROUP BY 1""")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Result lines written in order and read back: the last line of a task wins."""
    at = scratch(spark, "result-files")
    r = table(spark, d, "results").select(clean_identifier(F.col("task_id")).alias("task_id"), "result_id", F.col("result_id").alias("o"))
    sinks.write_lines(r, at, "o")
    return readers.results(spark, at).select("task_id", F.get_json_object("line", "$.result_id").cast("long").alias("result_id"))


_PUZZLE = "try_cast(json_extract_string(metadata, '$.rating') AS INTEGER)"


@query(f"""WITH p AS (SELECT task_id, trim(input) AS fen, {_PUZZLE} AS rating, try_cast(json_extract_string(metadata, '$.popularity') AS INTEGER) AS popularity FROM tasks WHERE task_type LIKE 'short_tactics%')
SELECT task_id AS puzzle, fen, rating, md5(task_id || ':42') AS o FROM p WHERE popularity >= 95 AND rating IS NOT NULL""")
def puzzle_files(spark: SparkSession, d: str) -> DataFrame:
    """Puzzles written as CSV with a header and read back in shuffled order, the popular ones kept."""
    at = scratch(spark, "puzzle-files")
    m = lambda k: F.get_json_object("metadata", f"$.{k}").try_cast("int")
    p = table(spark, d, "tasks").where("task_type like 'short_tactics%'").select(
        F.col("task_id").alias("PuzzleId"), F.trim("input").alias("FEN"), F.lit("e2e4 e7e5").alias("Moves"), m("rating").alias("Rating"), F.lit(80).alias("RatingDeviation"), m("popularity").alias("Popularity"),
        F.lit(1).alias("NbPlays"), F.lit("mate").alias("Themes"), F.lit("").alias("GameUrl"), F.lit("").alias("OpeningTags"),
    )
    p.where("Rating is not null").write.option("header", True).csv(at)
    return readers.good_puzzles(readers.puzzles(spark, at), min_popularity=95).select(F.col("PuzzleId").alias("puzzle"), F.col("FEN").alias("fen"), F.col("Rating").alias("rating"), "o")


@query(f"""WITH e AS (SELECT input AS fen, {_PUZZLE} AS r, length(task_id) AS n FROM tasks)
SELECT fen, CASE WHEN n % 2 = 0 THEN 30 ELSE 20 END AS depth, CASE WHEN n % 2 = 0 THEN coalesce(r, 0) ELSE 7 END AS cp FROM e WHERE coalesce(r, 0) % 3 <> 1""")
def evaluation_files(spark: SparkSession, d: str) -> DataFrame:
    """Engine evaluations written as JSON lines and read back: the deepest one, no mates."""
    at = scratch(spark, "evaluation-files")
    r, n = F.get_json_object("metadata", "$.rating").try_cast("int"), F.length("task_id")
    pv = lambda cp: F.array(F.struct(cp.alias("cp"), F.lit("e2e4").alias("line")))
    ev = lambda depth, cp: F.struct(depth.alias("depth"), F.lit(5).alias("knodes"), pv(cp).alias("pvs"))
    deep = F.when(n % 2 == 0, 30).otherwise(10)
    plain = F.to_json(F.struct(F.col("input").alias("fen"), F.array(ev(F.lit(20), F.lit(7)), ev(deep, r)).alias("evals")))
    mate = F.concat(F.lit('{"fen":"x","evals":[{"depth":99,"pvs":[{"mate":3,"line":"e2e4"}]}]}'))
    line = F.when(F.coalesce(r, F.lit(0)) % 3 == 1, mate).otherwise(plain)
    table(spark, d, "tasks").select(line.alias("value")).write.text(at)
    return readers.evaluations(spark, at).select("fen", "depth", "cp")


_LAST = f"""SELECT *, {_key('task_id')} AS task, row_number() OVER (PARTITION BY run_key, {_key('task_id')} ORDER BY rec_id DESC) AS k FROM openai_gpt_5"""


@query(f"""WITH h AS (SELECT max(rec_id) / 2 AS half FROM openai_gpt_5), l AS ({_LAST}),
f AS (SELECT run_key, {_key('task_id')} AS task, min(rec_id) AS first FROM openai_gpt_5 GROUP BY 1, 2)
SELECT coalesce(l.run_key, '') || '|' || l.task AS task_id, l.inference.extracted AS extracted, l.inference.is_correct::INTEGER AS is_correct, try_cast(json_extract_string(l.inference.usage, '$.completion_tokens') AS BIGINT) AS completion_tokens,
  len(l.inference.attempts)::INTEGER AS n_attempts, CASE WHEN f.first <= (SELECT half FROM h) THEN 'early' ELSE 'late' END AS created_at FROM l JOIN f ON f.task = l.task AND f.run_key IS NOT DISTINCT FROM l.run_key WHERE l.k = 1""")
def warehouse_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All result lines entered in two goes; the second replaces what the first had."""
    w = ingest.Warehouse(spark, scratch(spark, "warehouse"))
    lines = table(spark, d, "openai_gpt_5").withColumn("task_id", F.concat(F.coalesce("run_key", F.lit("")), F.lit("|"), clean_identifier(F.col("task_id"))))
    half = lines.agg(F.max("rec_id") / 2).first()[0]
    cols = ["rec_id", "task_id", "task_type", "task_category", "input", "question", "format_examples", "correct_answer", "answer_type", "metadata", "inference"]
    ingest.ingest(w, lines.where(F.col("rec_id") <= half).select(cols), "all", "rec_id", "early")
    ingest.ingest(w, lines.where(F.col("rec_id") > half).select(cols), "all", "rec_id", "late")
    return w.read("results").select("task_id", "extracted", "is_correct", "completion_tokens", "n_attempts", "created_at")


# streams --------------------------------------------------------------------------------------
_PIECE = 40


@query(f"""SELECT rec_id, nullif(inference.response, '') AS content, (length(coalesce(inference.response, '')) + {_PIECE} - 1) // {_PIECE} AS chunks, rec_id % 3 <> 0 AS complete, CASE WHEN coalesce(inference.response, '') <> '' THEN 10 END AS ttft_ms FROM openai_gpt_5""")
def event_streams(spark: SparkSession, d: str) -> DataFrame:
    """Responses cut into stream events and folded again; a third lacks every end mark."""
    r = table(spark, d, "openai_gpt_5").select("rec_id", F.coalesce("inference.response", F.lit("")).alias("t"))
    n = F.ceil(F.length("t") / _PIECE).cast("int")
    event = lambda x: F.concat(F.lit("data: "), F.to_json(x))
    piece = lambda i: event(F.struct(F.array(F.struct(F.struct(F.substr(F.col("t"), i * _PIECE + 1, F.lit(_PIECE)).alias("content")).alias("delta"))).alias("choices")))
    end = F.when(F.col("rec_id") % 3 != 0, F.array(event(F.struct(F.struct(F.length("t").alias("n")).alias("usage"))), F.lit("data: [DONE]"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.lit(": begun")), F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), piece)).otherwise(F.array().cast("array<string>")), end)
    stored = r.select(F.col("rec_id").cast("string").alias("attempt_key"), F.posexplode(lines).alias("seq", "line")).select("attempt_key", "seq", (F.col("seq") * 10).cast("long").alias("ms"), "line")
    out = events.folded(stored)
    return out.select(F.col("attempt_key").cast("long").alias("rec_id"), F.nullif("content", F.lit("")).alias("content"), F.col("chunks").cast("long").alias("chunks"), "complete", F.col("ttft_ms").cast("int").alias("ttft_ms"))


# boards and text --------------------------------------------------------------------------------
_DOTS = "split_part(trim(split_part(input, '|', 1)), ' ', 1)"
for _n in range(8, 0, -1):
    _DOTS = f"replace({_DOTS}, '{_n}', '{'.' * _n}')"


@query(f"""WITH b AS (SELECT task_id, array_to_string(list_reverse(string_split({_DOTS}, '/')), '') AS board FROM tasks WHERE regexp_full_match({_DOTS}, '([pnbrqkPNBRQK.]{{8}}/){{7}}[pnbrqkPNBRQK.]{{8}}')),
n AS (SELECT *, lead(board) OVER (ORDER BY task_id) AS nxt FROM b)
SELECT task_id, array_to_string(list_sort([chr((97 + s % 8)::INTEGER) || (s // 8 + 1) FOR s IN range(64) IF board[s + 1] <> nxt[s + 1]]), ' ') AS squares FROM n WHERE nxt IS NOT NULL""".replace("{{8}}", "{8}").replace("{{7}}", "{7}"))
def board_differences(spark: SparkSession, d: str) -> DataFrame:
    """Squares on which the board of each task differs from that of the next one by id."""
    b = table(spark, d, "tasks").select("task_id", boards.board_string(F.get(F.split("input", r"\|", 2), F.lit(0))).alias("board")).where("board is not null")
    # places by sorted splits: no window over all rows in one task
    placed = materialise(b.orderBy("task_id").withColumn("at", F.monotonically_increasing_id()), "boards")
    per = placed.groupBy(F.shiftright("at", 33).alias("split")).agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()  # a row for each split
    before, total = {}, 0
    for r in sorted(per, key=lambda r: r.split):
        before[r.split] = total - r.low
        total += r.n
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.shiftright("at", 33))
    numbered = placed.withColumn("no", F.col("at") + offset)
    nxt = numbered.select((F.col("no") - 1).alias("no"), F.col("board").alias("other"))
    return numbered.join(nxt, "no").select("task_id", F.array_join(boards.board_difference(F.col("board"), F.col("other")), " ").alias("squares"))


_PRONOUNS = [("i''m", "White is"), ("i''ve", "White has"), ("i''ll", "White will"), ("i''d", "White would"), ("myself", "White"), ("my", "White''s"), ("mine", "White''s"), ("me", "White"), ("i", "White")]
_FIRST = "text"
for _w, _t in _PRONOUNS:
    _FIRST = rf"regexp_replace({_FIRST}, '(?i)\b{_w}\b', '{_t}', 'g')"


@query(f"SELECT doc_id, {_FIRST} AS said FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def first_person(spark: SparkSession, d: str) -> DataFrame:
    """The first person of texts in ASCII as a side; word limits mean the same to both engines there."""
    doc = table(spark, d, "documents").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z"))
    return doc.select("doc_id", text.replace_first_person(F.col("text"), "White").alias("said"))


_WORDS = "[w FOR w IN regexp_split_to_array(trim(p_name), '\\s+') IF w <> '']"


@query(f"""SELECT p_partkey, {_WORDS}[1] AS first, {_WORDS}[-1] AS last, len(regexp_extract_all(p_name, '[A-Za-z'']+')) AS parts, upper(coalesce(nullif(regexp_extract(p_name, '(?i)(keep|drop)', 1), ''), 'DROP')) AS label, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS bare FROM part""".replace("{{L}}", "{L}").replace("{{N}}", "{N}"))
def names(spark: SparkSession, d: str) -> DataFrame:
    """Parts of names, the label of a judge, and bare letters."""
    n = text.name_parts(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", n["first"].alias("first"), n["last"].alias("last"), F.size(n["parts"]).cast("long").alias("parts"), text.keep_or_drop(F.col("p_name")).alias("label"), text.letters_and_digits(F.col("p_name")).alias("bare"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


@query(rf"""WITH t AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents), l AS (SELECT *, lower(t) AS l FROM t)
SELECT doc_id, length(t) >= 25 AND NOT {_any(text.GENERIC)} AND ({_any(text.CHESS_WORDS)} OR regexp_matches(t, '(^|[^A-Za-z0-9])((?i:o-o|0-0)|[KQRBN]?(?i:([a-h][1-8]|[a-h]|[1-8])?x?[a-h][1-8]))')) AS relevant FROM l""")
def relevant_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.relevant(F.col("text")).alias("relevant"))


@query("""WITH a AS (SELECT task_id, regexp_split_to_array(trim(split_part(input, ' ', 1)), '/') AS s FROM tasks)
SELECT task_id, array_to_string([CASE WHEN i % 2 = 1 THEN ((i + 1) // 2) || '. ' || s[i] ELSE s[i] END FOR i IN range(1, len(s) + 1)], ' ') AS numbered FROM a""")
def numbered_lists(spark: SparkSession, d: str) -> DataFrame:
    """The numbering of a list of moves, here of the ranks of a position."""
    ranks = F.split(F.trim(F.split_part("input", F.lit(" "), F.lit(1))), "/")
    return table(spark, d, "tasks").select("task_id", text.numbered_moves(ranks).alias("numbered"))


@query("""SELECT task_id, task_type, ('0x' || substr(md5(task_id || ':occasion:42'), 1, 8))::BIGINT % 10 AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY md5(task_id || ':42'), task_id) AS k FROM tasks) WHERE k <= 3 ORDER BY task_type, task_id LIMIT 40""")
def limited_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three tasks of each type, then the first forty; and a number drawn for each."""
    t = sampling.sample_tasks(table(spark, d, "tasks").select("task_id", "task_type"), per_type=3, most=40)
    return t.select("task_id", "task_type", sampling.drawn(F.col("task_id"), "occasion", F.lit(10)).alias("drawn"))
