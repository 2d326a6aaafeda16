"""Queries of the general data problems 2 to 4, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gambitflow.operators import deliveries, drift, nested
from gambitflow.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.surplus_copies(table(spark, d, "results"), table(spark, d, "openai_gpt_5"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_nodes(table(spark, d, "raw_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_files"))


def p4_consistent_table(spark: SparkSession, d: str) -> DataFrame:
    """The drifting result and stats lines as one table, a typed column for every field."""
    return drift.consistent_table(table(spark, d, "raw_files"))


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """In which files of a stream a path stands for which field."""
    return drift.field_runs(table(spark, d, "raw_files")).select("stream", "path", "first_file", "last_file", "field")


_INSTANT = """epoch_us(try_cast(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-][0-9]{2}:?[0-9]{2})$')
       THEN trim(created_at) ELSE trim(created_at) || 'Z' END AS TIMESTAMPTZ))"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_consistent_table": p4_consistent_table,
    "p4_fields": p4_fields,
}

SQL: dict[str, str] = {
    "p3_found": """WITH r AS (SELECT raw_id, try_cast(payload AS JSON) AS j FROM raw_records), o AS (SELECT raw_id, j FROM r WHERE json_type(j) = 'OBJECT'),
m AS (SELECT raw_id, CASE WHEN json_type(j, '$.metadata') = 'VARCHAR' THEN try_cast(json_extract_string(j, '$.metadata') AS JSON) ELSE json_extract(j, '$.metadata') END AS m FROM o),
a AS (SELECT raw_id, 'example' AS node, 0 AS parent_no, json_extract(j, '$.format_examples') AS v FROM o
  UNION ALL SELECT raw_id, 'extracted', 0, json_extract(j, '$.inference.extracted') FROM o UNION ALL SELECT raw_id, 'attempt', 0, json_extract(j, '$.inference.attempts') FROM o),
e AS (SELECT raw_id, node, parent_no, unnest(l) AS x, generate_subscripts(l, 1) AS node_no FROM (SELECT raw_id, node, parent_no, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN v IS NULL OR json_type(v) = 'NULL' OR (json_type(v) = 'VARCHAR' AND v ->> '$' = '') THEN [] ELSE [v] END AS l FROM a)),
k AS (SELECT raw_id, CASE node WHEN 'extracted' THEN 'square' ELSE 'chunk' END AS node, node_no AS parent_no, CASE node WHEN 'extracted' THEN json_extract(x, '$.squares') ELSE json_extract(x, '$.chunks') END AS v FROM e WHERE node <> 'example' AND json_type(x) = 'OBJECT'),
f AS (SELECT raw_id, node, parent_no, unnest(l) AS x, generate_subscripts(l, 1) AS node_no FROM (SELECT raw_id, node, parent_no, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN v IS NULL OR json_type(v) = 'NULL' OR (json_type(v) = 'VARCHAR' AND v ->> '$' = '') THEN [] ELSE [v] END AS l FROM k)),
n AS (SELECT * FROM e UNION ALL SELECT * FROM f)
SELECT raw_id, 'record' AS node, 0::BIGINT AS parent_no, 1::BIGINT AS node_no, coalesce(json_extract_string(m, '$.puzzle_id'), '') AS val FROM m
UNION ALL SELECT raw_id, node, parent_no::BIGINT, node_no::BIGINT, coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, CASE node WHEN 'extracted' THEN '$.item' WHEN 'attempt' THEN '$.outcome' WHEN 'chunk' THEN '$.kind' ELSE '$.none' END) WHEN node IN ('attempt', 'chunk') THEN '' ELSE x ->> '$' END, '')
FROM n WHERE json_type(x) <> 'NULL'""",
    "p2_found": f"""
SELECT 'results' AS src, result_id AS row_id FROM (
  SELECT result_id, row_number() OVER (PARTITION BY run_id, lower(trim(task_id, ' ' || chr(9) || chr(10) || chr(13)))
         ORDER BY {_INSTANT} NULLS LAST, result_id) AS k FROM results) WHERE k > 1
UNION ALL
SELECT 'openai_gpt_5', rec_id FROM (
  SELECT rec_id, row_number() OVER (PARTITION BY run_key, lower(trim(task_id, ' ' || chr(9) || chr(10) || chr(13))) ORDER BY rec_id) AS k
  FROM openai_gpt_5) WHERE k > 1""",
}
