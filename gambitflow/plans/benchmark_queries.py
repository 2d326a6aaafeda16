"""Queries over tasks, runs, results and commentary, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import primitives, text
from gambitflow.operators import sampling, similarity, stats, warehouse
from gambitflow.operators.deliveries import clean_identifier, instant
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


# SQL building blocks ----------------------------------------------------------------------
_W = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


def _key(x: str) -> str:
    return f"lower({_strip(x)})"


def _set(x: str) -> str:
    return f"list_distinct([i for i in [{_strip('j')} for j in string_split(lower({x}), ',')] if i <> ''])"


_MARKED = rf"regexp_extract_all(coalesce(response, ''), '(?is)FINAL ANSWER:{_W}*(.+?)(?:\n|\z)', 1)"
_BOXED = rf"regexp_extract_all(coalesce(response, ''), '[Tt]he{_W}+final{_W}+answer{_W}+is{_W}+\$?\\boxed\{{([^}}]+)\}}\$?', 1)"
_LAST = _strip(rf"regexp_replace({_strip('marked[-1]')}, '^(?i:FINAL ANSWER:){_W}*', '')")
_LAST = _strip(rf"regexp_replace(regexp_replace({_LAST}, '^\*+', ''), '\*+$', '')")
_EXTRACT = f"""x AS (SELECT *, {_MARKED} AS marked, {_BOXED} AS boxed FROM results),
e AS (SELECT *, CASE WHEN len(marked) > 0 THEN {_LAST} WHEN len(boxed) > 0 THEN {_strip('boxed[-1]')} ELSE '' END AS answer,
      len(marked) > 0 OR len(boxed) > 0 AS ok FROM x)"""
_GRADED = f"""{_EXTRACT},
g AS (SELECT e.result_id, e.run_id, {_key('e.task_id')} AS task, t.task_type, t.task_category, e.answer, e.ok, e.completion_tokens, e.total_tokens, e.prompt_tokens,
      e.cost_usd AS cost, e.latency_ms, e.thinking_source, e.usage_json, t.correct_answer, t.answer_type, r.max_tokens, {_set('e.answer')} AS a, {_set('t.correct_answer')} AS c
      FROM e JOIN tasks t ON {_key('e.task_id')} = {_key('t.task_id')} LEFT JOIN runs r ON r.run_id = e.run_id),
gr AS (SELECT *, CASE WHEN coalesce(coalesce(completion_tokens, 0) >= max_tokens * 0.98::DOUBLE, false) THEN 'max_token_reached' WHEN NOT ok THEN 'format_error'
      WHEN answer_type = 'multi' THEN CASE WHEN list_sort(a) = list_sort(c) THEN 'correct'
        WHEN len([i for i in c if NOT list_contains(a, i)]) = 0 THEN 'multi_extra_items' WHEN len([i for i in a if NOT list_contains(c, i)]) = 0 THEN 'multi_missing_items' ELSE 'multi_false_items' END
      WHEN {_strip('lower(answer)')} = {_strip("lower(coalesce(correct_answer, ''))")} THEN 'correct' ELSE 'wrong_answer' END AS error_type FROM g)"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return stats.graded(table(spark, d, "results"), table(spark, d, "tasks"), table(spark, d, "runs"))


# extraction and grading ---------------------------------------------------------------------
@query(f"WITH {_EXTRACT} SELECT result_id, answer, ok FROM e")
def extract_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select("result_id", text.extract_answer(F.col("response")).alias("x")).select("result_id", "x.answer", "x.ok")


@query(f"WITH {_GRADED} SELECT result_id, task_type, answer, ok, error_type FROM gr")
def grade_results(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("result_id", "task_type", "answer", "ok", "error_type")


@query(f"""WITH {_GRADED},
s AS (SELECT CASE grouping(error_type, task_type, task_category) WHEN 3 THEN 'error_type' WHEN 5 THEN 'task_type' WHEN 6 THEN 'task_category' ELSE 'all' END AS level,
  coalesce(error_type, task_type, task_category, '') AS key, count(*) AS n, count(*) FILTER (error_type = 'correct') AS n_correct, count(*) FILTER (ok) AS n_extracted,
  round(sum(coalesce(cost, 0.0)), 6) AS total_cost, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens
  FROM gr GROUP BY GROUPING SETS ((), (error_type), (task_type), (task_category)))
SELECT *, round(n_correct / n, 6) AS accuracy, round(n_extracted / n, 6) AS format_rate FROM s""")
def stats_by_level(spark: SparkSession, d: str) -> DataFrame:
    return stats.rollup_stats(_graded(spark, d))


@query(f"""WITH {_GRADED},
s AS (SELECT run_id, count(*) AS n, round(sum(coalesce(cost, 0.0)), 6) AS total_cost, sum(coalesce(prompt_tokens, 0))::BIGINT AS total_prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS total_completion_tokens,
  sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens, count(*) FILTER (usage_json IS NULL OR usage_json IN ('', '{{}}')) AS error_count, count(*) FILTER (ok) AS extraction_success_count FROM gr GROUP BY run_id)
SELECT *, round(extraction_success_count / n, 6) AS extraction_success_rate, round(total_cost / n, 6) AS avg_cost_per_task, round(total_tokens / n, 6) AS avg_tokens_per_task,
  CASE WHEN total_tokens > 0 THEN round(total_cost * 1000.0 / total_tokens, 6) ELSE 0.0 END AS cost_per_1k_tokens,
  CASE WHEN total_prompt_tokens > 0 THEN round(total_completion_tokens / total_prompt_tokens, 6) ELSE 0.0 END AS completion_ratio,
  CASE WHEN total_cost > 0 THEN round(total_tokens / total_cost, 6) ELSE 0.0 END AS tokens_per_dollar, round(total_prompt_tokens / n, 6) AS avg_prompt_tokens, round(total_completion_tokens / n, 6) AS avg_completion_tokens FROM s""")
def usage_by_run(spark: SparkSession, d: str) -> DataFrame:
    return stats.usage_rollup(_graded(spark, d), ["run_id"])


@query(f"""WITH {_GRADED} SELECT r.batch_id, count(*) AS n, round(avg(CASE WHEN gr.error_type = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM gr JOIN results r USING (result_id) GROUP BY 1""")
def batch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d).join(table(spark, d, "results").select("result_id", "batch_id"), "result_id")
    return stats.batch_accuracy(rows, "batch_id")


@query(f"""WITH {_GRADED}, n AS (SELECT run_id, error_type, count(*) AS n FROM gr GROUP BY 1, 2)
SELECT run_id, error_type, n, round(n / sum(n) OVER (PARTITION BY run_id), 6) AS rate FROM n""")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats.error_rates(_graded(spark, d))


@query(f"""WITH {_GRADED}
SELECT run_id, count(*) AS n_results, count(*) FILTER (error_type = 'correct') AS n_correct, count(*) FILTER (error_type = 'max_token_reached') AS n_capped, round(sum(cost), 4) AS total_cost,
  round(avg(completion_tokens))::BIGINT AS avg_completion_tokens, bool_and(coalesce(thinking_source, '') IN ('', 'none')) AS traceless FROM gr GROUP BY run_id""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_summary(_graded(spark, d)).drop("thinking_sources")


@query(f"""WITH {_GRADED} SELECT run_id, coalesce(thinking_source, 'none') AS source, count(*) AS n FROM gr GROUP BY 1, 2""")
def trace_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_summary(_graded(spark, d)).select("run_id", F.explode("thinking_sources").alias("source", "n"))


@query(f"""WITH {_GRADED},
c AS (SELECT task, run_id, arg_min(error_type, result_id) AS e FROM gr GROUP BY 1, 2),
o AS (SELECT task, string_agg('"' || printf('%06d', run_id) || '":"' || CASE e WHEN 'correct' THEN 'correct' WHEN 'max_token_reached' THEN 'capped' WHEN 'format_error' THEN 'format_error' ELSE 'wrong' END || '"', ',' ORDER BY run_id) AS m FROM c GROUP BY task)
SELECT o.task, '{{"category":"' || t.task_category || '","outcomes":{{' || m || '}},"task_id":"' || o.task || '","type":"' || t.task_type || '"}}' AS doc FROM o JOIN tasks t ON {_key('t.task_id')} = o.task""")
def outcome_documents(spark: SparkSession, d: str) -> DataFrame:
    return stats.outcome_documents(_graded(spark, d), table(spark, d, "tasks"))


_EXAMPLES = "from_json(format_examples, '[\"VARCHAR\"]')"


@query(rf"""WITH x AS (SELECT task_id, replace(question, 'CONTEXT_PLACEHOLDER', '') AS q, {_EXAMPLES} AS ex, unnest([1, 2]) AS grp FROM tasks),
y AS (SELECT *, CASE WHEN len(ex) >= 2 AND grp = 2 THEN ex[2] WHEN len(ex) >= 1 THEN ex[1] END AS e FROM x)
SELECT task_id, grp::INTEGER AS grp, CASE WHEN e IS NULL THEN q ELSE replace(q, 'FORMAT_EXAMPLE_PLACEHOLDER', e) END AS prompt,
  sha256(CASE WHEN e IS NULL THEN q ELSE replace(q, 'FORMAT_EXAMPLE_PLACEHOLDER', e) END) AS prompt_hash FROM y""")
def resolve_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks").withColumn("ex", F.from_json("format_examples", "array<string>")).withColumn("grp", F.explode(F.array(F.lit(1), F.lit(2))))
    t = t.withColumn("prompt", text.resolve_prompt(F.col("question"), F.col("ex"), F.col("grp")))
    return t.select("task_id", "grp", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))


@query(rf"""SELECT task_id, {_strip("string_split(input, '|')[1]")} AS fen, len([m for m in regexp_split_to_array(coalesce(nullif(substr(input, strpos(input, '|') + 1), CASE WHEN strpos(input, '|') = 0 THEN input ELSE '' END), ''), '{_W}+') if m <> '']) AS n_moves,
  substr(md5(array_to_string(regexp_split_to_array({_strip("string_split(input, '|')[1]")}, '{_W}+')[1:4], ' ')), 1, 16) AS position_hash FROM tasks""")
def split_inputs(spark: SparkSession, d: str) -> DataFrame:
    x = text.split_input(F.col("input"))
    return table(spark, d, "tasks").select("task_id", x["fen"].alias("fen"), F.size(x["moves"]).cast("long").alias("n_moves"), text.position_hash(x["fen"]).alias("position_hash"))


@query(r"""SELECT run_id, regexp_replace(model, '^[^/]*/', '') || CASE WHEN run_key LIKE '%-verbose-cot' THEN ' (verbose CoT)' WHEN enable_thinking <> 0 THEN ' (thinking)' ELSE ' (no thinking)' END AS display_name,
  translate(model, '/:', '__') || CASE WHEN enable_thinking <> 0 THEN '-thinking' ELSE '' END || CASE WHEN add_context <> 0 THEN '-piecearr' ELSE '' END || CASE WHEN format_example_group = 2 THEN '-fmt2' ELSE '' END AS built_key,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(run_key, '-fmt2$', ''), '-piecearr$', ''), '-thinking$', ''), '^([^_]*)_', '\1/') AS key_model,
  regexp_matches(regexp_replace(regexp_replace(run_key, '-fmt2$', ''), '-piecearr$', ''), '-thinking$')::INTEGER AS key_thinking FROM runs""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    m = text.run_meta(F.col("run_key"))
    return table(spark, d, "runs").select(
        "run_id", text.display_name(F.col("run_key"), F.col("model"), F.coalesce("enable_thinking", F.lit(0))).alias("display_name"),
        text.run_key(F.col("model"), F.coalesce("enable_thinking", F.lit(0)), F.coalesce("add_context", F.lit(0)), F.coalesce("format_example_group", F.lit(1))).alias("built_key"), m["model"].alias("key_model"), m["enable_thinking"].alias("key_thinking"),
    )


_SPLIT = f"[s for s in [{_strip('j')} for j in string_split(correct_answer, ',')] if s <> '']"


@query(rf"""WITH p AS (SELECT task_id, task_type, {_strip('correct_answer')} AS t, {_SPLIT} AS items, {_SPLIT.replace('correct_answer', 'lower(correct_answer)')} AS low FROM tasks),
k AS (SELECT task_id, CASE WHEN t IS NULL OR t = '' OR lower(t) = 'none' THEN 'none'
  WHEN task_type LIKE 'short_tactics%' OR task_type IN ('structural_check_in_1', 'structural_legal_move_all', 'structural_legal_move_piece', 'motifs_discovered_check', 'motifs_double_check')
    THEN CASE WHEN len(low) > 0 AND len([i for i in low if NOT regexp_full_match(i, '[a-h][1-8][a-h][1-8][qrbn]?')]) = 0 THEN 'moves' ELSE 'text' END
  WHEN task_type IN ('structural_capture_squares', 'structural_control_squares', 'structural_protect_squares') THEN CASE WHEN len(items) > 0 AND len([i for i in items if NOT regexp_full_match(i, '[a-h][1-8]')]) = 0 THEN 'squares' ELSE 'text' END
  WHEN task_type LIKE 'position_judgement%' THEN CASE WHEN regexp_full_match(t, '[-+]?\d+') THEN 'eval' ELSE 'text' END
  WHEN task_type LIKE 'semantic%' THEN CASE WHEN regexp_full_match(t, '\(?[A-Da-d]\)?\.?') THEN 'choice' ELSE 'text' END
  WHEN task_type IN ('motifs_pin', 'motifs_skewer', 'motifs_battery') THEN CASE WHEN len(items) > 0 AND len([i for i in items if NOT regexp_full_match(i, '[a-h][1-8](\s*>\s*[a-h][1-8])+')]) = 0 THEN 'chain' ELSE 'text' END
  WHEN task_type = 'motifs_fork' THEN CASE WHEN len(items) > 0 AND len([i for i in items if NOT regexp_full_match(i, '[a-h][1-8]\s*>\s*[a-h][1-8](\s*-\s*[a-h][1-8])*')]) = 0 THEN 'chain' ELSE 'text' END
  WHEN task_type = 'structural_check_detection' THEN CASE WHEN regexp_matches(t, '(?i)(White|Black)\s+(King|Queen|Rook|Bishop|Knight|Pawn)\s+at\s+[a-h][1-8]') THEN 'pieces' ELSE 'text' END
  WHEN task_type = 'structural_piece_arrangement' THEN CASE WHEN regexp_matches(t, '(?i)(White|Black)\s+(King|Queen|Rook|Bishop|Knight|Pawn):\s*\[[^\]]*[a-h][1-8][^\]]*\]') THEN 'pieces' ELSE 'text' END
  WHEN task_type LIKE 'structural_state_tracking%' AND regexp_matches(t, '^([pnbrqkPNBRQK1-8]+/){{7}}[pnbrqkPNBRQK1-8]+ [wb] ') THEN 'fen' ELSE 'text' END AS type, items, low, t FROM p)
SELECT task_id, type, CASE type WHEN 'moves' THEN len(low) WHEN 'chain' THEN len(regexp_extract_all(array_to_string(items, ','), '[>-]')) ELSE 0 END::INTEGER AS n_arrows,
  CASE WHEN type = 'moves' THEN low[1][3:4] WHEN type = 'chain' THEN regexp_extract(items[1], '>\s*([a-h][1-8])', 1) END AS first_to, CASE WHEN type = 'eval' THEN t::BIGINT END AS value, CASE WHEN type = 'choice' THEN upper(regexp_extract(t, '[A-Da-d]')) END AS letter FROM k""".replace("{{7}}", "{7}"))
def answer_primitives(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tasks").select("task_id", primitives.primitive(F.col("task_type"), F.col("correct_answer")).alias("p"))
    return p.select("task_id", "p.type", F.coalesce(F.size("p.arrows"), F.lit(0)).alias("n_arrows"), F.get("p.arrows", F.lit(0))["to"].alias("first_to"), "p.value", "p.letter")


# joins -----------------------------------------------------------------------------------------
@query("""SELECT r.run_id, r.run_key, count(*) AS n FROM runs r JOIN results s ON s.run_id = r.run_id WHERE r.status = 'complete' GROUP BY 1, 2 HAVING count(*) >= 50""")
def canonical_runs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "results").groupBy("run_id").agg(F.count("*").alias("n")).where("n >= 50")
    return table(spark, d, "runs").where("status = 'complete'").select("run_id", "run_key").join(n, "run_id")


@query(f"""SELECT task_id, task_category, task_type FROM tasks t WHERE EXISTS (SELECT 1 FROM results s JOIN runs r USING (run_id) WHERE r.status = 'complete' AND {_key('s.task_id')} = {_key('t.task_id')})""")
def tasks_with_results(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").where("status = 'complete'").select("run_id")
    seen = table(spark, d, "results").select("run_id", clean_identifier(F.col("task_id")).alias("task")).join(runs, "run_id", "left_semi").select("task").distinct()
    t = table(spark, d, "tasks").withColumn("task", clean_identifier(F.col("task_id")))
    return t.join(seen, "task", "left_semi").select("task_id", "task_category", "task_type")


@query(f"""SELECT 'runs' AS parent, count(*) FILTER (r.run_id IS NULL) AS orphans FROM results s LEFT JOIN runs r USING (run_id)
UNION ALL SELECT 'tasks', count(*) FILTER (t.task_id IS NULL) FROM results s LEFT JOIN tasks t ON {_key('s.task_id')} = {_key('t.task_id')}""")
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "results").select("run_id", clean_identifier(F.col("task_id")).alias("task"))
    a = res.join(table(spark, d, "runs").select("run_id"), "run_id", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit("runs").alias("parent"), "orphans")
    b = res.join(table(spark, d, "tasks").select(clean_identifier(F.col("task_id")).alias("task")), "task", "left_anti").agg(F.count("*").alias("orphans"))
    return a.unionByName(b.select(F.lit("tasks").alias("parent"), "orphans"))


@query(f"""WITH c AS (SELECT r.run_id, count(DISTINCT {_key('s.task_id')}) AS have FROM runs r LEFT JOIN (SELECT * FROM results s WHERE {_key('s.task_id')} IN (SELECT {_key('task_id')} FROM tasks)) s ON s.run_id = r.run_id GROUP BY 1)
SELECT run_id, have, (SELECT count(DISTINCT {_key('task_id')}) FROM tasks) - have AS missing FROM c""")
def matrix_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = stats.resume_split(table(spark, d, "tasks"), table(spark, d, "results"), table(spark, d, "runs"))
    return s.groupBy("run_id").agg(F.sum(F.when(F.col("state") != "new", F.col("n")).otherwise(0)).alias("have"), F.sum(F.when(F.col("state") == "new", F.col("n")).otherwise(0)).alias("missing"))


@query(f"""WITH s AS (SELECT run_id, {_key('task_id')} AS task, bool_or(NOT starts_with(coalesce(response, ''), 'ERROR') AND (length(coalesce(response, '')) > 0 OR coalesce(error_type = 'max_token_reached', false))) AS c
  FROM results WHERE {_key('task_id')} IN (SELECT {_key('task_id')} FROM tasks) GROUP BY 1, 2),
n AS (SELECT r.run_id, count(*) FILTER (c) AS a, count(*) FILTER (NOT c) AS b, (SELECT count(DISTINCT {_key('task_id')}) FROM tasks) AS total FROM runs r LEFT JOIN s USING (run_id) GROUP BY 1)
SELECT run_id, 'complete' AS state, a AS n FROM n UNION ALL SELECT run_id, 'again', b FROM n UNION ALL SELECT run_id, 'new', total - a - b FROM n""")
def resume_split(spark: SparkSession, d: str) -> DataFrame:
    return stats.resume_split(table(spark, d, "tasks"), table(spark, d, "results"), table(spark, d, "runs"))


@query(f"SELECT max(rec_id) AS rec_id, {_key('task_id')} AS task, run_key FROM openai_gpt_5 GROUP BY 2, 3")
def last_line_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = stats.last_line_wins(table(spark, d, "openai_gpt_5"), [F.col("run_key"), clean_identifier(F.col("task_id"))], "rec_id")
    return lines.select("rec_id", F.col("k0").alias("run_key"), F.col("k1").alias("task"))


@query("""SELECT r.run_key, round(avg(s.is_correct), 6) AS accuracy, round(sum(s.cost_usd), 4) AS cost, round(avg(s.completion_tokens), 4) AS avg_tokens,
  (SELECT max(x.completion_tokens) FROM results x WHERE x.run_id = r.run_id) AS max_tokens FROM results s JOIN runs r USING (run_id) GROUP BY r.run_key, r.run_id""")
def accuracy_by_run(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").groupBy("run_id").agg(F.round(F.avg("is_correct"), 6).alias("accuracy"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.round(F.avg("completion_tokens"), 4).alias("avg_tokens"), F.max("completion_tokens").alias("max_tokens"))
    return r.join(table(spark, d, "runs").select("run_id", "run_key"), "run_id").drop("run_id")


# warehouse ---------------------------------------------------------------------------------------
_NO = r"regexp_extract(batch_id, '(\d+)$', 1)::BIGINT"


@query(f"""WITH b AS (SELECT *, {_key('task_id')} AS task, {_NO} >= (SELECT max({_NO}) FROM results) / 2 AS new FROM results),
l AS (SELECT run_id, task, max(result_id) FILTER (NOT new) AS old_id, min(result_id) FILTER (NOT new) AS first_old, max(result_id) FILTER (new) AS new_id, min(result_id) FILTER (new) AS first_new FROM b GROUP BY 1, 2)
SELECT l.run_id, l.task, coalesce(first_old, first_new) AS result_id, coalesce(new_id, old_id) AS source_id, s.error_type, s.completion_tokens FROM l JOIN results s ON s.result_id = coalesce(new_id, old_id)""")
def upsert_results(spark: SparkSession, d: str) -> DataFrame:
    """Stored results of the earlier batches, upserted with the later ones: all columns are
    replaced, the first id stays."""
    rows = table(spark, d, "results").select("result_id", "run_id", clean_identifier(F.col("task_id")).alias("task"), "error_type", "completion_tokens", F.regexp_extract("batch_id", r"(\d+)$", 1).cast("long").alias("no"))
    half = rows.agg((F.max("no") / 2).alias("half"))
    rows = rows.crossJoin(F.broadcast(half))  # one row
    old, new = (warehouse.latest(rows.where(c), ["run_id", "task"], "result_id") for c in ("no < half", "no >= half"))
    return warehouse.upsert(old, new, ["run_id", "task"], keep=["result_id"]).select("run_id", "task", "result_id", "source_id", "error_type", "completion_tokens")


@query(f"""WITH t AS (SELECT *, hash_no % 3 AS h FROM (SELECT *, ('0x' || substr(md5(task_id), 1, 4))::INTEGER AS hash_no FROM tasks))
SELECT task_id, CASE WHEN h = 0 THEN 'Again: ' || question ELSE question END AS question, CASE WHEN h = 0 THEN coalesce(NULL, source_file) ELSE source_file END AS source_file, h = 0 AS replaced FROM t""")
def upsert_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A third of the tasks arrives again with other questions and without a source file."""
    t = table(spark, d, "tasks").select("task_id", "question", "source_file")
    new = t.where(F.conv(F.substring(F.md5("task_id"), 1, 4), 16, 10).cast("int") % 3 == 0).select("task_id", F.concat(F.lit("Again: "), "question").alias("question"), F.lit(None).cast("string").alias("source_file"))
    return warehouse.upsert(t.withColumn("replaced", F.lit(False)), new.withColumn("replaced", F.lit(True)), ["task_id"], coalesce=["source_file"])


@query("""SELECT rec_id, coalesce(a.attempt_no, i)::INTEGER AS attempt_no, a.started_at, a.duration_ms, a.http_status, a.error_class, coalesce(nullif(a.outcome, ''), 'unknown') AS outcome
FROM (SELECT rec_id, unnest(inference.attempts) AS a, generate_subscripts(inference.attempts, 1) AS i FROM openai_gpt_5)""")
def attempts(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.attempts(table(spark, d, "openai_gpt_5"))


@query("""WITH a AS (SELECT epoch(try_cast(a.started_at AS TIMESTAMPTZ))::BIGINT AS s, a.duration_ms AS ms FROM (SELECT unnest(inference.attempts) AS a FROM openai_gpt_5)),
t AS (SELECT make_timestamp(s // 600 * 600 * 1000000) AS tick, count(*) AS n, sum(ms)::BIGINT AS ms FROM a WHERE s IS NOT NULL GROUP BY 1)
SELECT tick, n, ms, sum(n) OVER (ORDER BY tick)::BIGINT AS n_so_far FROM t""")
def progress_ticks(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.progress(warehouse.attempts(table(spark, d, "openai_gpt_5")), 600)


@query("""SELECT result_id, try_cast(json_extract(usage_json, '$.prompt_tokens') AS BIGINT) AS prompt_tokens, try_cast(json_extract(usage_json, '$.completion_tokens') AS BIGINT) AS completion_tokens,
  try_cast(json_extract(usage_json, '$.completion_tokens_details.reasoning_tokens') AS BIGINT) AS reasoning_tokens FROM results""")
def usage_columns(spark: SparkSession, d: str) -> DataFrame:
    u = lambda p: F.get_json_object("usage_json", p).try_cast("long")
    return table(spark, d, "results").select("result_id", u("$.prompt_tokens").alias("prompt_tokens"), u("$.completion_tokens").alias("completion_tokens"), u("$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"))


# samples ------------------------------------------------------------------------------------------
@query("""SELECT task_id, task_type FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY md5(task_id || ':42'), task_id) AS k FROM tasks) WHERE k <= 5""")
def sample_per_type(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(table(spark, d, "tasks").select("task_id", "task_type"), ["task_type"], 5, "task_id").drop("rank")


_RATING = "try_cast(json_extract(metadata, '$.rating') AS INTEGER)"
_LEVEL = f"CASE WHEN {_RATING} <= 999 THEN 'beginner' WHEN {_RATING} <= 1499 THEN 'intermediate' WHEN {_RATING} <= 1999 THEN 'advanced' WHEN {_RATING} IS NOT NULL THEN 'expert' END"


@query(f"""SELECT task_id, level, level || '_' || printf('%04d', k - 1) AS numbered_id FROM (SELECT task_id, {_LEVEL} AS level, row_number() OVER (PARTITION BY {_LEVEL} ORDER BY md5(task_id || ':42'), task_id) AS k FROM tasks WHERE {_RATING} IS NOT NULL) WHERE k <= 25""")
def rating_bands(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks").select("task_id", text.rating_level(F.get_json_object("metadata", "$.rating").try_cast("int")).alias("level")).where("level is not null")
    few = sampling.per_group(t, ["level"], 25, "task_id").withColumnRenamed("rank", "k")
    return sampling.numbered(few, "level", ["k"]).drop("k")


@query(rf"""WITH v AS (SELECT task_id, try_cast(correct_answer AS INTEGER) AS cp FROM tasks WHERE task_type LIKE 'position_judgement%')
SELECT task_id, cp, CASE WHEN abs(cp + 400) <= 50 THEN 'losing' WHEN abs(cp + 200) <= 50 THEN 'disadvantage' WHEN abs(cp) <= 50 THEN 'neutral' WHEN abs(cp - 200) <= 50 THEN 'advantage' WHEN abs(cp - 400) <= 50 THEN 'winning' END AS band,
  (SELECT o FROM (SELECT unnest([-400, -200, 0, 200, 400]) AS o, unnest([1, 2, 3, 4, 5]) AS i) ORDER BY abs(o - cp), i LIMIT 1)::INTEGER AS nearest FROM v WHERE cp IS NOT NULL""")
def eval_bands(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "tasks").where("task_type like 'position_judgement%'").select("task_id", F.col("correct_answer").try_cast("int").alias("cp")).where("cp is not null")
    return v.select("task_id", "cp", text.eval_band(F.col("cp")).alias("band"), text.nearest_option(F.col("cp"), F.array(*[F.lit(x) for x in text.EVAL_BANDS.values()])).alias("nearest"))


_THEMES = "from_json(json_extract(metadata, '$.themes'), '[\"VARCHAR\"]')"


@query(f"SELECT theme, count(*) AS n FROM (SELECT task_id, unnest({_THEMES}) AS theme FROM tasks) WHERE theme <> '' GROUP BY theme")
def theme_tally(spark: SparkSession, d: str) -> DataFrame:
    return similarity.tag_postings(_themed(spark, d), "task_id", "themes").withColumnRenamed("tag", "theme")


def _themed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("task_id", F.from_json(F.get_json_object("metadata", "$.themes"), "array<string>").alias("themes"))


#: The themes that quotas are drawn for.
THEMES = ["deflection", "endgame", "hanging", "mate", "middlegame", "promotion", "quiet", "sacrifice", "zugzwang"]
_QUOTAS = ",\n".join(
    f"q{i} AS (SELECT '{k}' AS kind, task_id, (row_number() OVER (ORDER BY o, task_id) - 1)::INTEGER AS no FROM c WHERE kind = '{k}'" + "".join(f" AND task_id NOT IN (SELECT task_id FROM q{j})" for j in range(i)) + " QUALIFY no < 25)"
    for i, k in enumerate(THEMES)
)
_THEMED = "(SELECT task_id, unnest(list_distinct(from_json(json_extract(metadata, '$.themes'), '[\"VARCHAR\"]'))) AS kind FROM tasks)"


@query(f"WITH c AS (SELECT task_id, kind, md5(task_id || ':42') AS o FROM {_THEMED}),\n{_QUOTAS}\n" + " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(len(THEMES))))
def theme_quotas(spark: SparkSession, d: str) -> DataFrame:
    """25 tasks per theme, each task to its first theme with room."""
    c = _themed(spark, d).select("task_id", F.explode(F.array_distinct("themes")).alias("kind"), sampling.shuffled(F.col("task_id")).alias("o"))
    return sampling.quotas(c, THEMES, 25, "task_id", "o")


@query(f"""WITH t AS (SELECT * FROM {_THEMED} WHERE kind IS NOT NULL AND kind <> ''), q AS (SELECT DISTINCT task_id FROM t WHERE ('0x' || substr(md5(task_id), 1, 8))::BIGINT % 10 = 0)
SELECT q.task_id, (SELECT count(DISTINCT b.task_id) FROM t a JOIN t b ON b.kind = a.kind AND b.task_id <> a.task_id WHERE a.task_id = q.task_id) AS n FROM q""")
def theme_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """With how many other tasks a task of the query set shares a theme."""
    return similarity.sharing_neighbours(_themed(spark, d), "task_id", "themes", 10)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id, e.vec_id AS neighbour, round(list_cosine_similarity(q.v, e.v), 9) AS sim FROM q JOIN e ON e.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s)
SELECT vec_id, neighbour, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM k WHERE rank <= 5""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest(table(spark, d, "embeddings"))


@query("""WITH m AS (SELECT task_id, CASE WHEN coalesce(try_cast(json_extract_string(metadata, '$.move_number') AS INTEGER), 0) <= 12 THEN 'opening' WHEN try_cast(json_extract_string(metadata, '$.move_number') AS INTEGER) <= 30 THEN 'middlegame' ELSE 'endgame' END AS stage FROM tasks WHERE task_category = 'Semantic')
SELECT stage, count(*) AS n FROM m GROUP BY 1""")
def game_stages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks").where("task_category = 'Semantic'")
    return t.groupBy(text.game_stage(F.get_json_object("metadata", "$.move_number")).alias("stage")).agg(F.count("*").alias("n"))


# commentary ----------------------------------------------------------------------------------------
KEYWORDS = ["passed pawn", "rook endings", "outside passed pawn", "bishop", "tempo", "time control", "queenside", "light squares", "castle", "score sheet", "gambit"]
_NORM = "' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' '"


@query()
def comment_features(spark: SparkSession, d: str) -> DataFrame:
    """Words, keywords and lengths of plain symbols of every comment."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.count_words(F.col("text")).alias("n_words"), F.array_join(text.keywords_in(F.col("text"), KEYWORDS), ";").alias("keywords"), F.length(text.plain_symbols(F.col("text"))).alias("n_plain"))


SQL["comment_features"] = (
    "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9'']+'))::INTEGER AS n_words, array_to_string([k for k in ["
    + ", ".join(f"'{k}'" for k in sorted(KEYWORDS, key=lambda k: (-len(k), k)))
    + f"] if contains({_NORM}, ' ' || k || ' ')], ';') AS keywords, length(regexp_replace(replace(translate(text, '', 'QRBNK'), ' ', ' '), "
    + r"'[\x{200B}-\x{200F}\x{202A}-\x{202E}]', '', 'g'))::INTEGER AS n_plain FROM documents WHERE text IS NOT NULL"
)


@query()
def cleaned_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments without notation marks, and whether they are about chess; the rules need
    look-behind, which DuckDB's patterns lack."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.strip_notation(text.plain_symbols(F.col("text"))).alias("cleaned")).withColumn("relevant", text.relevant(F.col("cleaned")))


@query(f"""SELECT source, count(*) AS n, count(text) AS n_texts, count(DISTINCT text) AS n_distinct, sum(n_chars)::BIGINT AS chars, max(added_at) AS last_added FROM documents GROUP BY source""")
def documents_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    distinct = docs.where("text is not null").select("source", F.xxhash64("text").alias("h"), F.md5("text").alias("m")).distinct().groupBy("source").agg(F.count("*").alias("n_distinct"))
    base = docs.groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("n_texts"), F.sum("n_chars").alias("chars"), F.max("added_at").alias("last_added"))
    return base.join(distinct.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "n_texts", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "chars", "last_added")


@query(r"""SELECT result_id, epoch_us(try_cast(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN trim(created_at) ELSE trim(created_at) || 'Z' END AS TIMESTAMPTZ)) AS micros FROM results""")
def created_instants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select("result_id", instant(F.col("created_at")).alias("micros"))
