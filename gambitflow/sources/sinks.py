"""Writers: JSON lines with nulls kept, deterministic JSON, tables swapped by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_line(*cols) -> Column:
    """One JSON object with all fields in the given order, nulls included."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; with `order` the files and their lines are in that order (range
    partitioned, so no single task sorts everything)."""
    cols = [c for c in df.columns if c != order]
    (df.orderBy(order) if order else df).select(json_line(*cols).alias("value")).write.mode("overwrite").text(path)


def sorted_json(obj) -> str:
    """Compact JSON with sorted keys and a closing line feed: equal objects, equal bytes."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def write_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """One pretty JSON array in one file, for small tables at the edge of an export; rows come
    through the driver one partition at a time."""
    rows = (df.orderBy(order) if order else df).drop(*([order] if order else [])).select(json_line("*").alias("value")).toLocalIterator()
    _write_text(df.sparkSession, path, "[\n" + ",\n".join(json.dumps(json.loads(r.value), indent=2, ensure_ascii=False) for r in rows) + "\n]\n")


def write_object(spark: SparkSession, path: str, obj, indent: int | None = 2) -> int:
    """One JSON object in one file, indented or in the deterministic compact form; returns
    the number of bytes."""
    body = sorted_json(obj) if indent is None else json.dumps(obj, indent=indent, ensure_ascii=False) + "\n"
    _write_text(spark, path, body)
    return len(body.encode())


def _write_text(spark: SparkSession, path: str, body: str) -> None:
    """Write beside the target first, then put it in its place by one rename."""
    fs_ = spark._jvm.org.apache.hadoop.fs
    tmp, to = fs_.Path(f"{path}.{uuid.uuid4().hex}"), fs_.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(tmp)
    out.write(body.encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(fs_.Options.Rename, 1)
    over[0] = fs_.Options.Rename.OVERWRITE
    fs_.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, to, over)


def report(df: DataFrame, *order: str, rows: int = 1000) -> str:
    """A report of a small table as text: sorted, columns of equal width, at most `rows` lines."""
    got = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in (df.orderBy(*order) if order else df).limit(rows).collect()]
    width = [max(map(len, col)) for col in zip(df.columns, *got, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, width, strict=True)).rstrip() for row in [df.columns, *got])


def append_lines(df: DataFrame, path: str, *, columns: list[str] | None = None) -> None:
    """JSON lines added to a folder; repeated rows do no harm where the last line of a key wins."""
    df.select(json_line(*(columns or df.columns)).alias("value")).write.mode("append").text(path)


def swap_table(df: DataFrame, path: str) -> None:
    """Replace a parquet table that the plan itself may read: written beside it first, then
    the old one gives way. Tables whose readers must never find it missing belong into a
    Warehouse, which changes versions by one rename."""
    spark = df.sparkSession
    fs_ = spark._jvm.org.apache.hadoop.fs
    new, old, at = fs_.Path(f"{path}.new-{uuid.uuid4().hex}"), fs_.Path(f"{path}.old-{uuid.uuid4().hex}"), fs_.Path(path)
    df.write.parquet(new.toString())
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


#: Tables of the results warehouse: name -> (schema, key).
WAREHOUSE = {
    "schema_meta": ("key string, value string", ["key"]),
    "tasks": ("task_id string, task_type string, task_category string, input string, question string, format_examples string, correct_answer string, answer_type string, metadata string, source_file string, dataset_hash string", ["task_id"]),
    "runs": ("run_id long, run_key string, model string, backend string, enable_thinking int, add_context int, format_example_group int, max_tokens long, reasoning_config string, dataset_hash string, git_commit string, cli_args string, started_at string, updated_at string, status string, stats string", ["run_key"]),
    "results": ("result_id long, run_id long, task_id string, prompt_hash string, response string, thinking_content string, thinking_source string, extracted string, extraction_successful int, is_correct int, error_type string, prompt_tokens long, completion_tokens long, total_tokens long, reasoning_tokens long, cached_tokens long, cost_usd double, usage_json string, raw_message string, provider_meta string, n_attempts int, latency_ms long, created_at string", ["run_id", "task_id"]),
    "attempts": ("run_id long, task_id string, attempt_no int, started_at string, duration_ms long, http_status int, error_class string, billed_risk int, retry_after_s double, wait_s double, outcome string", ["run_id", "task_id", "attempt_no"]),
}


def create_warehouse(spark: SparkSession, root: str, version: str = "1") -> None:
    """Empty tables where none are yet, and the version row."""
    for name, (schema, _) in WAREHOUSE.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = [("version", version)] if name == "schema_meta" else []
            spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}")
