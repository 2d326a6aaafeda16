"""Queries of exports and projections, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import calls
from gambitflow.operators import exports, ingest, projection
from gambitflow.operators.deliveries import clean_identifier
from gambitflow.plans.benchmark_queries import _key
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


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return exports.cells(table(spark, d, "results"), table(spark, d, "tasks"))


@query()
def run_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of runs; illegal answers need the rules of the game."""
    return exports.run_index(_cells(spark, d), table(spark, d, "runs")).withColumn("thinking_sources", F.to_json("thinking_sources"))


_CELL = f"""c AS (SELECT * FROM (SELECT r.*, {_key('r.task_id')} AS task, row_number() OVER (PARTITION BY {_key('r.task_id')}, run_id ORDER BY result_id) AS k FROM results r) WHERE k = 1),
t AS (SELECT *, {_key('task_id')} AS task FROM tasks),
j AS (SELECT c.task, c.run_id, c.error_type, c.extracted, c.completion_tokens, c.latency_ms, t.task_type, t.task_category FROM c JOIN t ON t.task = c.task)"""


@query(f"""WITH {_CELL}
SELECT r.run_id, (SELECT count(DISTINCT task) FROM j) - count(DISTINCT j.task) AS missing FROM runs r LEFT JOIN j USING (run_id) GROUP BY r.run_id""")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return exports.missing_cells(_cells(spark, d), table(spark, d, "runs"))


@query()
def task_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of each task with the primitives of all its answers."""
    return exports.task_documents(_cells(spark, d), table(spark, d, "runs"))


@query(f"""WITH c AS (SELECT * FROM (SELECT r.*, {_key('r.task_id')} AS task, row_number() OVER (PARTITION BY {_key('r.task_id')}, run_id ORDER BY result_id) AS k FROM results r) WHERE k = 1)
SELECT c.task, u.run_key, '{{"content":' || to_json(coalesce(thinking_content, '')) || ',"response":' || to_json(coalesce(response, '')) || ',"thinking_source":' || coalesce(to_json(thinking_source), 'null') || '}}' AS doc FROM c JOIN runs u USING (run_id)""")
def trace_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.trace_documents(table(spark, d, "results"), table(spark, d, "runs"))


def _priced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = table(spark, d, "tasks")
    runs = table(spark, d, "runs").select("run_id", calls.run_slug(F.col("run_key")).alias("slug"))
    types = t.select(clean_identifier(F.col("task_id")).alias("task"), "task_type", "task_category")
    r = table(spark, d, "results").select(clean_identifier(F.col("task_id")).alias("task"), "run_id", "is_correct", "prompt_tokens", "completion_tokens", F.col("cost_usd").alias("cost"), "thinking_source", "error_type")
    rows = r.join(types, "task").join(runs, "run_id")
    # a price table of the same prices for every model: prices are the caller's
    prices = runs.select("slug").distinct().select("slug", F.lit(1.0).alias("price_in"), F.lit(4.0).alias("price_out"))
    return rows, projection.type_weights(t), prices


_SLUG = r"""regexp_replace(regexp_replace(run_key, CASE WHEN run_key LIKE '%-fmt2' THEN '-fmt2$' WHEN run_key LIKE '%-piecearr' THEN '-piecearr$' WHEN run_key LIKE '%-thinking' THEN '-thinking$' WHEN run_key LIKE '%-verbose-cot' THEN '-verbose-cot$' ELSE '$^' END, ''), '^([^_]*)_', '\1/')"""
_PRICED = f"""w AS (SELECT task_type, count(*) AS weight FROM tasks GROUP BY 1),
x AS (SELECT {_SLUG} AS slug, t.task_type, t.task_category, r.is_correct, r.prompt_tokens, r.completion_tokens, r.cost_usd, r.error_type, r.thinking_source, w.weight
  FROM results r JOIN tasks t ON {_key('t.task_id')} = {_key('r.task_id')} JOIN runs u USING (run_id) JOIN w ON w.task_type = t.task_type)"""


@query(f"""WITH {_PRICED},
g AS (SELECT slug, count(*) FILTER (coalesce(completion_tokens, 0) <> 0) AS n, count(*) FILTER (coalesce(completion_tokens, 0) = 0) AS error_rows, sum(cost_usd) FILTER (coalesce(completion_tokens, 0) <> 0) AS cost,
  coalesce(sum(prompt_tokens) FILTER (coalesce(completion_tokens, 0) <> 0), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, coalesce(sum(weight * completion_tokens), 0)::BIGINT AS out,
  count(*) FILTER (coalesce(completion_tokens, 0) <> 0 AND is_correct = 1) AS good, count(*) FILTER (coalesce(completion_tokens, 0) <> 0 AND error_type = 'max_token_reached') AS max_token_reached,
  count(DISTINCT task_type) FILTER (coalesce(completion_tokens, 0) <> 0) AS covered FROM x GROUP BY slug)
SELECT slug, n, error_rows, coalesce(cost, 0) = 0 AS native_priced, round(CASE WHEN coalesce(cost, 0) = 0 THEN (prompt_tokens * 1.0::DOUBLE + completion_tokens * 4.0::DOUBLE) / 1e6 ELSE cost END, 4) AS smoke_cost, prompt_tokens, completion_tokens,
  CASE WHEN n > 0 THEN round(good / n, 3) END AS accuracy, max_token_reached, round(out / 1e6, 2) AS projected_out_m, round((800000.0::DOUBLE * 1.0 + out * 4.0::DOUBLE) / 1e6, 2) AS projected_cost, (SELECT count(*) FROM w) - covered AS types_missing FROM g""")
def run_projection(spark: SparkSession, d: str) -> DataFrame:
    return projection.projection(*_priced(spark, d))


@query(f"""WITH {_PRICED} SELECT slug, task_category AS category, count(*) FILTER (coalesce(is_correct, 0) = 1) AS correct, count(*) AS n FROM x WHERE coalesce(completion_tokens, 0) <> 0 GROUP BY 1, 2""")
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    return projection.by_category(_priced(spark, d)[0])


@query(f"""WITH {_PRICED}, h AS (SELECT slug, 'thinking_source' AS kind, coalesce(nullif(thinking_source, ''), 'none') AS value FROM x WHERE coalesce(completion_tokens, 0) <> 0
UNION ALL SELECT slug, 'error_type', coalesce(nullif(error_type, ''), CASE WHEN is_correct = 1 THEN 'correct' ELSE '?' END) FROM x WHERE coalesce(completion_tokens, 0) <> 0)
SELECT slug, kind, value, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def result_histograms(spark: SparkSession, d: str) -> DataFrame:
    return projection.histograms(_priced(spark, d)[0])


@query(r"""SELECT rec_id, CASE WHEN inference.prompt <> '' THEN sha256(inference.prompt) END AS prompt_hash, inference.is_correct::INTEGER AS is_correct, try_cast(json_extract(inference.usage, '$.prompt_tokens') AS BIGINT) AS prompt_tokens,
  try_cast(json_extract(inference.usage, '$.completion_tokens_details.reasoning_tokens') AS BIGINT) AS reasoning_tokens, try_cast(json_extract(inference.usage, '$.cost') AS DOUBLE) AS cost_usd,
  CASE WHEN trim(inference.usage) NOT IN ('', '{}', '[]', 'null') THEN inference.usage END AS usage_json, len(inference.attempts)::INTEGER AS n_attempts FROM openai_gpt_5""")
def warehouse_columns(spark: SparkSession, d: str) -> DataFrame:
    """The result columns of result lines."""
    lines = table(spark, d, "openai_gpt_5").withColumn("task_id", F.col("rec_id").cast("string"))
    return ingest.result_columns(lines).select(F.col("task_id").cast("long").alias("rec_id"), "prompt_hash", "is_correct", "prompt_tokens", "reasoning_tokens", "cost_usd", "usage_json", "n_attempts")
