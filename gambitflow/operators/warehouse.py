"""Keyed upserts and the attempts of a result, as plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.functions import calls
from gambitflow.operators.deliveries import instant


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, with the smallest and the newest `order` value as
    `<order>` and `source_id`. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("best")
    return rows.groupBy(*key).agg(F.min(order).alias("first"), best).select(*key, F.col("first").alias(order), F.col(f"best.{order}").alias("source_id"), *[F.col(f"best.{c}") for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = (), coalesce: list[str] = ()) -> DataFrame:
    """Keyed union in which new rows win. Columns of `keep` stay as they were; those of
    `coalesce` are replaced only by values that are not null. Keys are compared null-safe."""
    o, n = old.alias("o"), new.alias("n")
    here = lambda side: F.col(f"{side}._in").isNotNull()
    joined = o.withColumn("_in", F.lit(1)).alias("o").join(n.withColumn("_in", F.lit(1)).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    pick = lambda c, first, second: F.when(here(first), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}"))
    cols = []
    for c in old.columns:
        if c in keep:
            cols.append(pick(c, "o", "n"))
        elif c in coalesce:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")))
        else:
            cols.append(pick(c, "n", "o"))
    return joined.select(*[x.alias(c) for x, c in zip(cols, old.columns, strict=True)])


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """Children of a parent are replaced as a whole; a parent without new ones keeps its old ones."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def attempts(lines: DataFrame) -> DataFrame:
    """One row per attempt; its number defaults to its place, its outcome to 'unknown'.
    Null arrays and null elements give no rows of their own values: a null element keeps
    its place with nulls."""
    a = lines.select("rec_id", F.posexplode("inference.attempts").alias("pos", "a"))
    return a.select("rec_id", F.coalesce("a.attempt_no", F.col("pos") + 1).alias("attempt_no"), "a.started_at", "a.duration_ms", "a.http_status", "a.error_class", F.coalesce(F.nullif(F.col("a.outcome"), F.lit("")), F.lit("unknown")).alias("outcome"))


def attempt_classes(rows: DataFrame) -> DataFrame:
    """class, n, avg_ms: attempts by the class that their status tells."""
    kind = calls.attempt_class(F.col("http_status"), F.lit(None).cast("string"))["error_class"]
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


def progress(rows: DataFrame, seconds: int) -> DataFrame:
    """Counters per tick and so far. Ticks are aggregated first; the running sum is taken
    within each day, and only the sums of days are added up in one place."""
    tick = F.timestamp_seconds(F.floor(instant(F.col("started_at")) / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz")
    per = rows.where(F.col("started_at").isNotNull()).groupBy(tick.alias("tick")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms")).where("tick is not null").withColumn("day", F.to_date("tick"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = per.groupBy("day").agg(F.sum("n").alias("d")).select("day", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("day").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("_so_far", within).join(days, "day").select("tick", "n", "ms", (F.col("_so_far") + F.col("before")).alias("n_so_far"))
