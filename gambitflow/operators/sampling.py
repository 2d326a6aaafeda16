"""Samples that any engine can repeat: order by md5 of id and seed instead of a generator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(id_col: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def drawn(id_col: Column, what: str, size: Column, seed: int = 42) -> Column:
    """A number from 0 to size - 1, drawn by the hash of the id and the occasion `what`."""
    return F.conv(F.substring(F.md5(F.concat(id_col.cast("string"), F.lit(f":{what}:{seed}"))), 1, 8), 16, 10).cast("long") % size


def per_group(df: DataFrame, group: list[str], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group in shuffled order. Spark limits each group inside every
    task before the shuffle, so a group that holds a third of all rows does no harm."""
    w = Window.partitionBy(*group).orderBy(shuffled(F.col(id_col), seed), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sample_tasks(df: DataFrame, per_type: int | None = None, most: int | None = None, type_col: str = "task_type", id_col: str = "task_id", order: str | None = None, seed: int = 42) -> DataFrame:
    """First `per_type` rows of each type, then at most `most` rows in all, in the given
    order (else by type and id); without limits all rows."""
    if per_type:
        df = per_group(df, [type_col], per_type, id_col, seed).drop("rank")
    return df.orderBy(*([order] if order else [type_col, id_col])).limit(most) if most else df


def quotas(candidates: DataFrame, kinds: list[str], n: int, id_col: str, order: str) -> DataFrame:
    """kind, id, no (from 0): greedy quotas. Every item goes to the first kind, in the given
    order, that it is eligible for and that is not full; n items of each kind. `candidates`
    has one row per item and kind.

    Closed form, kind by kind: the first n eligible items not taken before. No kind needs
    more than its first n * len(kinds) candidates, so each is reduced to them in every task
    before the shuffle; the rest, n * len(kinds)^2 rows at most, is assigned in one task."""
    w = Window.partitionBy("kind").orderBy(order, id_col)
    few = candidates.where(F.col("kind").isin(*kinds)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n * len(kinds)).select("kind", id_col, order)
    id_type = dict(candidates.dtypes)[id_col]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {k: [] for k in kinds}
        for b in batches:
            for kind, item, o in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                by[kind].append((o, item))
        taken: set = set()
        for kind in kinds:
            mine = [item for _, item in sorted(by[kind]) if item not in taken][:n]
            taken.update(mine)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(mine), pa.string()), id_col: pa.array(mine, few_type), "no": pa.array(range(len(mine)), pa.int32())})

    few_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    return few.coalesce(1).mapInArrow(assign, f"kind string, {id_col} {id_type}, no int")


def numbered(df: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Adds `numbered_id`: kind and a running index of four digits or more."""
    w = Window.partitionBy(kind).orderBy(*order)
    return df.withColumn("numbered_id", F.concat(F.col(kind), F.lit("_"), F.format_string("%04d", F.row_number().over(w) - 1)))


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order; ties by the other columns."""
    rest = [c for c in df.columns if c not in key and c != order]
    best = df.groupBy(*key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in [order, *rest]]).select(df.columns)


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier pass has taken."""
    return df.join(used.select(key).distinct(), key, "left_anti")
