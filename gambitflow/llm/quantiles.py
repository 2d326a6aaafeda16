"""Exact percentiles of very large numeric columns by bisection (problem 5).

Values are reduced to mergeable summaries first: per group and part (a batch or a day) the
distinct values with their counts. Summaries of parts combine by adding counts. For every
group and percentile an interval that holds the target value is kept; its ends are values
of the data. Each pass counts the rows up to the cut points of all intervals at once - an
aggregate that is combined in each task - and narrows every interval to the values between
two cut points. An interval whose ends are equal is resolved: the answer is the exact
discrete percentile, so the error bound is zero.

Cut points lie at equal steps and, for heavy tails, at powers of 1/16 of the width above
the lower end, so a few passes resolve whole numbers as well as fractions of any size.

Defined results: nulls and NaN are left out; infinite values count as the least and greatest
ones; a null group is a group of its own; a group without values gives no row; whole numbers
stay long, all others are double; the target rank of percentile p over n values is
ceil(p * n), at least 1 (the smallest value v with at least p * n values <= v, as SQL's
percentile_disc).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.session import materialise, release

#: An interval is cut at so many equal steps, and at the powers of 1/16 of its width up to this one.
STEPS, POWERS = 16, 12
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_MOST = 1.7976931348623157e308


def summary(rows: DataFrame, group: list[str], value: str, part: list[str] | None = None) -> DataFrame:
    """Counts of the distinct values by group (and part); combined before the shuffle."""
    whole = dict(rows.dtypes)[value] in _WHOLE
    v = F.col(value).cast("long" if whole else "double")
    kept = v.isNotNull() if whole else v.isNotNull() & ~F.isnan(v)
    # one zero: -0.0 and 0.0 are the same value
    return rows.where(kept).groupBy(*group, *(part or []), (v if whole else v + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))


def combine(*summaries: DataFrame, group: list[str]) -> DataFrame:
    """Summaries of separate parts as one."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*group, "value").agg(F.sum("n").alias("n"))


def _cuts(low: Column, high: Column, whole: bool) -> Column:
    """Cut points of an interval, from its lower end on, below its upper end."""
    steps, powers = range(1, STEPS), range(2, POWERS + 1)
    if whole:
        width = high.cast("decimal(20,0)") - low.cast("decimal(20,0)")
        even = [(low + F.floor(width * i / STEPS)).cast("long") for i in steps]
        close = [(low + F.floor(width / F.lit(16**i).cast("decimal(20,0)"))).cast("long") for i in powers]
    else:
        a, b = F.greatest(low, F.lit(-_MOST)), F.least(high, F.lit(_MOST))
        even = [a * (1 - i / STEPS) + b * (i / STEPS) for i in steps]
        close = [a + (b / 16.0**i - a / 16.0**i) for i in powers]
    return F.filter(F.array(low, *even, *close), lambda c: (c >= low) & (c < high))


def percentiles(counts: DataFrame, group: list[str], ps: list[float], broadcast_limit: int = 20_000) -> DataFrame:
    """group columns, p, value, n: exact discrete percentiles of a summary.

    The cut points are one row per group. They are broadcast to the counting pass only while
    the intervals are at most `broadcast_limit`; beyond it the pass is a shuffle join on the
    group. A hot group is split: it is joined by AQE's skew join, and its counts are combined
    in each task."""
    if {"p", "value", "n"} & set(group):
        raise ValueError("p, value and n are columns of the result; rename the group columns")
    names, group = group, [f"_k{i}" for i in range(len(group))]
    whole = dict(counts.dtypes)["value"] in _WHOLE
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in group]
    counts = counts.select(*[F.col(c).alias(k) for c, k in zip(names, group, strict=True)], "value", "n")
    counts = materialise(counts.withColumn("g", F.concat_ws("\u0001", *keys) if group else F.lit("")), "value-counts")
    frame = counts.groupBy("g", *group).agg(F.sum("n").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    state = frame.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("below", F.lit(0).cast("long"))
    # the rounding guards against p * n lying just above an integer in binary
    columns = ["g", *group, "total", "p", "rank", "low", "high", "below"]
    state = materialise(state.withColumn("rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.col("p") * F.col("total"), 6)))).select(columns), "intervals")
    hint = F.broadcast if state.count() <= broadcast_limit else (lambda d: d)
    # invariant: low and high are values of the group, count(value < low) = below < rank <= count(value <= high)
    while not (open_ := state.where("low < high")).isEmpty():
        # a group has as many intervals as percentiles at most; equal ones are cut once
        points = open_.groupBy("g").agg(F.collect_set(F.struct("low", "high")).alias("s"), F.min("low").alias("least"), F.max("high").alias("most"), F.min("below").alias("base"))
        cuts = F.flatten(F.transform("s", lambda x: _cuts(x["low"], x["high"], whole)))
        points = points.select("g", "least", "most", "base", F.array_sort(F.array_distinct(cuts)).alias("points"))
        # every value falls between two cut points; only the sums between them are shuffled
        slot = F.size(F.filter("points", lambda c: c < F.col("value")))
        sums = counts.join(hint(points), "g").where("value between least and most").groupBy("g", slot.alias("slot")).agg(F.sum("n").alias("m"), F.min("value").alias("a"), F.max("value").alias("b"), F.first("base").alias("base"))
        upto = F.sum("m").over(Window.partitionBy("g").orderBy("slot")) + F.col("base")
        slots = sums.select(F.col("g").alias("slot_g"), "a", "b", (upto - F.col("m")).alias("before"), upto.alias("upto"))
        hit = (F.col("g") == F.col("slot_g")) & (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
        narrowed = open_.join(slots, hit).select(*columns[:-3], F.greatest("low", "a").alias("low"), F.least("high", "b").alias("high"), F.greatest("below", "before").alias("below"))
        done, state = state, materialise(state.where("low >= high").unionByName(narrowed), "intervals")
        release(done)
    return state.select(*[F.col(k).alias(c) for c, k in zip(names, group, strict=True)], "p", F.col("high").alias("value"), F.col("total").alias("n"))
