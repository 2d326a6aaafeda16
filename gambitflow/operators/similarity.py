"""Nearest neighbours by cosine, and neighbours that share a tag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors matched in one block: with Arrow batches of 10,000 rows the products are 40 MB.
BLOCK = 512
#: Blocks that one pass over the rows holds at most; more queries take further passes.
BLOCKS = 64


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0 and exists(v, x -> x != 0) and not exists(v, x -> x is null or isnan(x))")


def _matched(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """vec_id, neighbour, similarity: k candidates of each query from each task."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast((np.array([r.vec_id for r in queries]), np.array([r.v for r in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shipped.value
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        best_id = [np.zeros((len(qid[a : a + BLOCK]), 0), dtype=np.int64) for a in range(0, len(qid), BLOCK)]
        best = [np.zeros(x.shape) for x in best_id]
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            m = (m / np.linalg.norm(m, axis=1, keepdims=True)).T
            for n, a in enumerate(range(0, len(qid), BLOCK)):
                own = qid[a : a + BLOCK]
                sim = q[a : a + BLOCK] @ m
                sim[own[:, None] == ids[None, :]] = -np.inf
                if sim.shape[1] > 4 * k:
                    # only what may be among the k best, ties included
                    cut = -np.partition(-np.round(sim, 9), k - 1, axis=1)[:, k - 1 : k]
                    keep = np.flatnonzero((np.round(sim, 9) >= cut).any(axis=0))
                    sim, some = sim[:, keep], ids[keep]
                else:
                    some = ids
                all_ids = np.concatenate([best_id[n], np.broadcast_to(some, sim.shape)], axis=1)
                sims = np.concatenate([best[n], sim], axis=1)
                order = np.lexsort((all_ids, -np.round(sims, 9)), axis=1)[:, :k]
                best_id[n], best[n] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(sims, order, 1)
        for n, a in enumerate(range(0, len(qid), BLOCK)):
            own, width = qid[a : a + BLOCK], best[n].shape[1]
            keep = best[n].ravel() > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, width)[keep], pa.int64()), pa.array(best_id[n].ravel()[keep], pa.int64()), pa.array(best[n].ravel()[keep], pa.float64())], ["vec_id", "neighbour", "similarity"])

    return rows.mapInArrow(run, "vec_id long, neighbour long, similarity double")


def _top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    out = None
    block: list = []

    def add(block: list) -> None:
        nonlocal out
        new = _matched(rows, block, k)
        out = new if out is None else out.unionByName(new)

    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK * BLOCKS:
            add(block)
            block = []
    if block or out is None:
        add(block) if block else None
    if out is None:
        out = rows.sparkSession.createDataFrame([], "vec_id long, neighbour long, similarity double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 9)).alias("s"), "neighbour"))), 1, k)
    return out.groupBy("vec_id").agg(top.alias("t")).select("vec_id", F.posexplode("t").alias("pos", "n")).select("vec_id", "n.neighbour", F.round(-F.col("n.s"), 6).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 100) -> DataFrame:
    """vec_id, neighbour, similarity, rank: exact neighbours of the stated query set (ids
    divisible by `every`) among all rows, the query itself left out.

    Queries are matched in blocks: one pass over the rows holds BLOCK * BLOCKS queries, and
    each task keeps k candidates per query, so k rows per task and query are shuffled. The
    work is rows x queries; `nearest_by_buckets` searches many queries in less.
    Null and zero vectors have no neighbours and are none; ties go to the smaller id."""
    rows = _vectors(vectors)
    return _top(rows, rows.where(F.col("vec_id") % every == 0), k)


def nearest_of(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same for the given queries (vec_id), a bounded set."""
    v = vectors if "embedding" in vectors.columns else vectors.select(F.col("item_id").alias("vec_id"), F.col("vector").alias("embedding"))
    rows = _vectors(v)
    return _top(rows, rows.join(F.broadcast(queries.select("vec_id").distinct()), "vec_id", "left_semi"), k)


def nearest_by_buckets(vectors: DataFrame, k: int = 5, every: int = 100, tables: int = 48, bits: int = 6, seed: int = 5, block: int = 4096) -> DataFrame:
    """As `nearest`, by random hyperplanes: a row is compared with the queries that share one
    of its `tables` buckets of `bits` signs. All rows are indexed; recall against the exact
    search is measured in the tests (0.9 or more with these values on the test vectors).
    Large buckets are split by salt: queries go to every part, rows to one."""
    spark = vectors.sparkSession
    rows = _vectors(vectors)
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return _top(rows, rows, k)
    planes = np.random.default_rng(seed).normal(size=(tables * bits, first.d))
    weights = 1 << np.arange(bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            sign = ((m @ planes.T) > 0).reshape(b.num_rows, tables, bits)
            keys = (sign * weights).sum(axis=2) + np.arange(tables)[None, :] * (1 << bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel(), pa.int64()))], ["vec_id", "v", "keys"])

    indexed = rows.mapInArrow(keyed, "vec_id long, v array<double>, keys array<long>")
    slots = indexed.select("vec_id", "v", F.explode("keys").alias("key"))
    sizes = slots.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    here = slots.join(F.broadcast(sizes) if tables << bits <= 100_000 else sizes, "key")
    mine = here.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("v").alias("qv"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    theirs = here.select("vec_id", "v", "key", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(F.col(a), F.col(a)))
    # a pair that meets in several tables is compared once
    pairs = mine.join(theirs, ["key", "part"]).where("query != vec_id").groupBy("query", "vec_id").agg(F.first("qv").alias("qv"), F.first("v").alias("v"))
    scored = pairs.select("query", "vec_id", F.round(dot(F.col("qv"), F.col("v")) / (norm("qv") * norm("v")), 9).alias("s"))
    w = Window.partitionBy("query").orderBy(F.col("s").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("vec_id"), F.col("vec_id").alias("neighbour"), F.round("s", 6).alias("similarity"), "rank")


def tag_postings(items: DataFrame, id_col: str, tags: str) -> DataFrame:
    """tag, n: the inverted index reduced to the length of its lists. Null and empty tags
    are left out; a tag counts once for each item."""
    return items.select(id_col, F.explode(F.array_distinct(tags)).alias("tag")).where("tag is not null and tag != ''").groupBy("tag").agg(F.count("*").alias("n"))


def postings(items: DataFrame, id_col: str, tags: str) -> DataFrame:
    """tag, id: the inverted index itself, as rows, so a hot tag is no single list."""
    return items.select(F.explode(F.array_distinct(tags)).alias("tag"), id_col).where("tag is not null and tag != ''")


def sharing_neighbours(items: DataFrame, id_col: str, tags: str, every: int = 100) -> DataFrame:
    """id, n: with how many other items an item of the stated query set (the number that its
    id's md5 begins with is divisible by `every`) shares a tag.

    Items are reduced to their distinct tag sets first, so the work grows with the kinds of
    sets of the queries, not with the pairs of items; how many items share a tag of a set is
    counted by inclusion and exclusion over the subsets of its tags while these are few, and
    by meeting the sets of its tags otherwise."""
    sets = items.select(id_col, F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != "")))).alias("s")).where("size(s) > 0")
    kinds = sets.groupBy("s").agg(F.count("*").alias("m"))
    asked = sets.where(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % every == 0)
    mine = asked.select(F.col("s").alias("a")).distinct()
    few = 10
    # every subset of a small tag set as a sorted array; its items are those that hold all of it
    subsets = lambda c: F.filter(F.aggregate(c, F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(acc, lambda x: F.concat(x, F.array(t))))), lambda x: F.size(x) > 0)
    small = mine.where(F.size("a") <= few).select("a", F.explode(subsets(F.col("a"))).alias("x"))
    # of each kind of set only the subsets that a query asks for are counted
    wanted = small.select("x").distinct()
    tagged = kinds.select("s", "m", F.explode("s").alias("t"))
    holds = tagged.join(wanted.select("x", F.get("x", F.lit(0)).alias("t")), "t").where(F.size(F.array_except("x", "s")) == 0).groupBy("x").agg(F.sum("m").alias("c"))
    sign = F.when(F.size("x") % 2 == 1, 1).otherwise(-1)
    by_subsets = small.join(holds, "x").groupBy("a").agg(F.sum(sign * F.col("c")).alias("n"))
    large = mine.where(F.size("a") > few).select("a", F.explode("a").alias("t"))
    by_meeting = large.join(tagged.select("t", F.col("s").alias("b"), "m"), "t").select("a", "b", "m").distinct().groupBy("a").agg(F.sum("m").alias("n"))
    reach = by_subsets.unionByName(by_meeting)
    return asked.join(reach, F.col("s") == F.col("a")).select(id_col, (F.col("n") - 1).alias("n"))
