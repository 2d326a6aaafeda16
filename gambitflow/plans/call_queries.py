"""Queries about model calls and their attempts, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.functions import calls
from gambitflow.operators import warehouse
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


_BLOCKS = "json_extract(inference.raw_message, '$.content[*]')"


@query(f"""WITH b AS (SELECT rec_id, inference.raw_message AS m, {_BLOCKS} AS b FROM openai_gpt_5),
t AS (SELECT rec_id, m, coalesce([x for x in b if x ->> 'type' IN ('thinking', 'redacted_thinking')], []) AS th, coalesce([x ->> 'text' for x in b if x ->> 'type' = 'text' AND coalesce(x ->> 'text', '') <> ''], []) AS tx FROM b)
SELECT rec_id, array_to_string(tx, chr(10)) AS content, CASE WHEN len([x for x in th if coalesce(x ->> 'thinking', '') <> '']) > 0 THEN 'summary' WHEN len(th) > 0 THEN 'encrypted_only' ELSE 'none' END AS source,
  coalesce(try_cast(m ->> '$.usage.input_tokens' AS BIGINT), 0) AS prompt_tokens FROM t""")
def native_messages(spark: SparkSession, d: str) -> DataFrame:
    """The raw messages read as native responses."""
    m = calls.native_message(F.col("inference.raw_message"))
    return table(spark, d, "openai_gpt_5").select("rec_id", m.alias("m")).select("rec_id", F.col("m.content").alias("content"), F.col("m.source").alias("source"), F.col("m.prompt_tokens").alias("prompt_tokens"))


@query("""WITH l AS (SELECT rec_id, rec_id % 6 AS k, coalesce(inference.thinking_content, '') AS t FROM openai_gpt_5)
SELECT rec_id, CASE WHEN k IN (0, 1, 2, 3) AND t = '' THEN (CASE k WHEN 3 THEN 'encrypted_only' ELSE 'none' END) WHEN k = 0 THEN 'full_text' WHEN k = 1 THEN 'summary' WHEN k = 2 THEN 'untyped' WHEN k = 3 THEN 'plain' WHEN k = 4 THEN 'encrypted_only' ELSE 'none' END AS source,
  CASE WHEN k IN (0, 1, 2, 3) THEN length(t) ELSE 0 END AS n_chars FROM l""")
def trace_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Traces of all lines put into messages of six shapes and told apart again."""
    t = F.col("inference.thinking_content")
    detail = lambda **kv: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in kv.items()])
    k = F.col("rec_id") % 6
    message = (
        F.when(k == 0, F.to_json(F.struct(F.array(detail(type="reasoning.text", text=t)).alias("reasoning_details"), F.lit("flat").alias("other"))))
        .when(k == 1, F.to_json(F.struct(F.array(detail(type="reasoning.summary", summary=t)).alias("reasoning_details"))))
        .when(k == 2, F.to_json(F.struct(F.array(detail(text=t)).alias("reasoning_details"))))
        .when(k == 3, F.to_json(F.struct(F.array(detail(type="reasoning.encrypted", data="x")).alias("reasoning_details"), t.alias("reasoning"))))
        .when(k == 4, F.lit('{"reasoning_details":[{"type":"reasoning.encrypted","data":"x"}]}'))
        .otherwise(F.lit('{"reasoning_details":null}'))
    )
    return table(spark, d, "openai_gpt_5").select("rec_id", calls.thinking(message).alias("x")).select("rec_id", "x.source", F.length("x.content").cast("long").alias("n_chars"))


@query("""WITH a AS (SELECT rec_id, unnest(inference.attempts) AS a, generate_subscripts(inference.attempts, 1) AS i FROM openai_gpt_5),
c AS (SELECT rec_id, coalesce(a.attempt_no, i)::INTEGER AS attempt_no, a.http_status AS s, a.retry_after_s AS asked FROM a),
k AS (SELECT *, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s = 429 THEN 'http_429' WHEN s BETWEEN 400 AND 499 THEN 'http_4xx' WHEN s IS NULL THEN 'unknown' ELSE 'http_5xx' END AS error_class,
  s IS NULL OR NOT (s BETWEEN 200 AND 299 OR (s BETWEEN 400 AND 499 AND s <> 429)) AS retriable, s IS NULL OR s BETWEEN 200 AND 299 OR (s NOT IN (429, 502, 503) AND s NOT BETWEEN 400 AND 499) AS billed FROM c)
SELECT rec_id, attempt_no, error_class, retriable, billed AS billed_risk, CASE WHEN retriable AND attempt_no < CASE WHEN billed THEN 2 ELSE 4 END THEN 'retried' WHEN retriable THEN 'gave_up' ELSE 'fatal' END AS next,
  CASE WHEN asked IS NOT NULL THEN least(asked, 300.0) ELSE 0.5 * least(60.0, 2.0 ** attempt_no) END AS wait_s FROM k""")
def attempt_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every attempt classified again, and what follows it; the jitter is held at a half."""
    a = table(spark, d, "openai_gpt_5").select("rec_id", F.posexplode("inference.attempts").alias("pos", "a"))
    a = a.select("rec_id", F.coalesce("a.attempt_no", F.col("pos") + 1).cast("int").alias("attempt_no"), "a.http_status", "a.retry_after_s", calls.attempt_class(F.col("a.http_status"), F.lit(None).cast("string")).alias("c"))
    return a.select("rec_id", "attempt_no", "c.error_class", "c.retriable", "c.billed_risk", calls.after_attempt(F.col("attempt_no"), F.col("c.retriable"), F.col("c.billed_risk")).alias("next"), calls.backoff(F.col("attempt_no"), F.col("retry_after_s"), F.lit(0.5)).alias("wait_s"))


@query("""WITH a AS (SELECT unnest(inference.attempts) AS a FROM openai_gpt_5)
SELECT CASE WHEN a.http_status BETWEEN 200 AND 299 THEN 'ok' WHEN a.http_status = 429 THEN 'http_429' WHEN a.http_status BETWEEN 400 AND 499 THEN 'http_4xx' WHEN a.http_status IS NULL THEN 'unknown' ELSE 'http_5xx' END AS class,
  count(*) AS n, round(avg(a.duration_ms), 3) AS avg_ms FROM a GROUP BY 1""")
def attempt_classes(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.attempt_classes(warehouse.attempts(table(spark, d, "openai_gpt_5")))


@query(r"""SELECT run_id, coalesce(starts_with(model, 'anthropic/claude') AND try_cast(string_split(model, '-')[-1] AS DOUBLE) >= 4.7, false) AS adaptive,
  CASE WHEN coalesce(starts_with(model, 'anthropic/claude') AND try_cast(string_split(model, '-')[-1] AS DOUBLE) >= 4.7, false) THEN '{"type":"adaptive","display":"summarized"}' ELSE '{"effort":"medium"}' END AS payload,
  regexp_replace(regexp_replace(run_key, CASE WHEN run_key LIKE '%-fmt2' THEN '-fmt2$' WHEN run_key LIKE '%-piecearr' THEN '-piecearr$' WHEN run_key LIKE '%-thinking' THEN '-thinking$' WHEN run_key LIKE '%-verbose-cot' THEN '-verbose-cot$' ELSE '$^' END, ''), '^([^_]*)_', '\1/') AS slug FROM runs""")
def run_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("run_id", calls.adaptive_thinking(F.col("model")).alias("adaptive"), calls.reasoning_payload(F.col("model")).alias("payload"), calls.run_slug(F.col("run_key")).alias("slug"))


@query("""SELECT result_id, CASE WHEN completion_tokens >= 1000000 THEN printf('%d.%02dM', (completion_tokens + 5000) // 1000000, (completion_tokens + 5000) // 10000 % 100) WHEN completion_tokens >= 1000 THEN printf('%d.%02dK', (completion_tokens + 5) // 1000, (completion_tokens + 5) // 10 % 100) ELSE completion_tokens::VARCHAR END AS tokens,
  CASE WHEN latency_ms >= 3600000 THEN (latency_ms // 3600000) || 'h ' || (latency_ms % 3600000 // 60000) || 'm ' || printf('%d.%02ds', (latency_ms % 60000 + 5) // 1000, (latency_ms % 60000 + 5) // 10 % 100) WHEN latency_ms >= 60000 THEN (latency_ms // 60000) || 'm ' || printf('%d.%02ds', (latency_ms % 60000 + 5) // 1000, (latency_ms % 60000 + 5) // 10 % 100)
    ELSE printf('%d.%02ds', (latency_ms + 5) // 1000, (latency_ms + 5) // 10 % 100) END AS latency FROM results WHERE completion_tokens < 1000000000 AND latency_ms IS NOT NULL""")
def readable_results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").where("completion_tokens < 1000000000 and latency_ms is not null")
    return r.select("result_id", calls.readable_number(F.col("completion_tokens")).alias("tokens"), calls.readable_time(F.col("latency_ms") / 1000).alias("latency"))
