"""Percentiles by bisection against sorting: whole numbers, fractions, ends of the range, nulls."""

import math
import random

import pytest

from gambitflow.llm import quantiles


def _exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(round(p * len(v), 6))) - 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_match_sorting(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), "day1" if rng.random() < 0.5 else "day2", rng.choice([0, 7, 7, -3, rng.randint(-(10**12), 10**12), None])) for _ in range(600)]
    rows.append(("one", "day1", 5))
    rows.append(("none", "day1", None))
    df = spark.createDataFrame(rows, "g string, part string, x long")
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    days = [quantiles.summary(df.where(f"part = '{d}'"), ["g"], "x") for d in ("day1", "day2")]
    got = {(r.g, r.p): (r.value, r.n) for r in quantiles.percentiles(quantiles.combine(*days, group=["g"]), ["g"], ps).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == g and r[2] is not None]
        want |= {(g, p): (_exact(v, p), len(v)) for p in ps if v}
    assert got == want


def test_percentiles_without_broadcast_and_empty(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "g string, x long")
    s = quantiles.summary(df, ["g"], "x")
    assert [r.value for r in quantiles.percentiles(s, ["g"], [0.5], broadcast_limit=0).collect()] == [49]
    assert quantiles.percentiles(s.limit(0), ["g"], [0.5]).count() == 0


def test_percentiles_of_fractions_and_ends(spark):
    rng = random.Random(3)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    groups = {
        "small": [0.2, 0.7, 1.9],
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(200)] + [0.0, -0.0, 5e-324, -5e-324],
        "ends": [float("inf"), float("-inf"), 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002],
        "tail": [round(rng.paretovariate(0.4), 3) for _ in range(300)],
    }
    rows = [(g, x) for g, v in groups.items() for x in v] + [("small", None), ("small", float("nan")), ("none", float("nan"))]
    s = quantiles.summary(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")
    got = {(r.g, r.p): (r.value, r.n) for r in quantiles.percentiles(s, ["g"], ps).collect()}
    assert got == {(g, p): (_exact(v, p), len(v)) for g, v in groups.items() for p in ps}
    low, high = -(2**63), 2**63 - 1
    whole = spark.createDataFrame([("e", x) for x in (low, low + 1, 0, high - 1, high)], "g string, x long")
    got = [r.value for r in quantiles.percentiles(quantiles.summary(whole, ["g"], "x"), ["g"], [0.1, 0.3, 0.5, 0.7, 0.9]).orderBy("p").collect()]
    assert got == [low, low + 1, 0, high - 1, high]


def test_percentiles_of_a_hot_group_and_clashing_names(spark):
    rows = spark.createDataFrame([(n % 3 if n % 3 else None, n % 17, "x", 1) for n in range(3000)], "slot int, x int, points string, total int")
    s = quantiles.summary(rows, ["slot"], "x")
    for limit in (0, 1000):
        got = {r.slot: r.value for r in quantiles.percentiles(s, ["slot"], [0.5], limit).collect()}
        assert got == {k: _exact([n % 17 for n in range(3000) if (n % 3 or None) == k], 0.5) for k in (None, 1, 2)}
    with pytest.raises(ValueError):
        quantiles.percentiles(s.withColumnRenamed("slot", "p"), ["p"], [0.5])
