"""Problems 2 to 5 on small fixtures against brute force, with nulls, ties and empty tables."""

import json
import random

import pytest

from gambitflow.operators import deliveries, drift, nested

RESULTS = "result_id long, run_id long, task_id string, created_at string, batch_id string, message string, part int"
LINES = "rec_id long, run_key string, task_id string, batch_id string"


def _surplus(spark, res, lines):
    out = deliveries.surplus_copies(spark.createDataFrame(res, RESULTS), spark.createDataFrame(lines, LINES))
    return sorted((r.src, r.row_id) for r in out.collect())


def test_deliveries_keep_the_earliest(spark):
    res = [
        (1, 1, "a", "2026-03-01T00:00:02Z", "b0", None, None),
        (2, 1, " A\t", "2026-03-01T01:00:01+01:00", "b1", "x", 3),  # the same instant as 00:00:01Z
        (3, 1, "a", None, "b9", None, None),
        (4, 1, "b", "2026-03-01 00:00:00", "b9", None, None),
        (5, None, "b", "2026-03-01 00:00:00", "b9", None, None),
        (6, None, "b", "2026-03-01 00:00:00", "b9", None, None),
        (7, 2, "c", None, None, None, None),
        (8, 2, "C", None, "b2", None, None),
        (9, 3, "d", "2026-03-01", "b3", None, None),
        (10, 3, "d", "no time", "b3", None, None),
    ]
    lines = [(1, "r", "t", "g0"), (2, "r", "T ", "g5"), (3, None, "t", "g5"), (4, "r", None, None)]
    assert _surplus(spark, res, lines) == [("openai_gpt_5", 2), ("results", 1), ("results", 3), ("results", 8), ("results", 10)]


def test_deliveries_empty(spark):
    assert _surplus(spark, [], []) == []


def test_ledger_rewrites_only_touched_partitions(spark, tmp_path):
    ledger = deliveries.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.deliver(spark.createDataFrame([("a", 1, 5, 0), ("b", 2, 5, 1), ("c", 3, None, 2)], ledger.SCHEMA)) == ["0", "1", "2"]
    before = ledger.manifest()
    # b comes again, earlier; d is new
    assert ledger.deliver(spark.createDataFrame([("b", 4, 1, 3), ("d", 5, 1, 3)], ledger.SCHEMA)) == ["1", "3"]
    after = ledger.manifest()
    assert after["0"] == before["0"] and after["2"] == before["2"] and "1" not in after
    assert sorted(r.row_id for r in ledger.winners().collect()) == [1, 3, 4, 5]
    # the same delivery again changes nothing
    ledger.deliver(spark.createDataFrame([("b", 4, 1, 3), ("d", 5, 1, 3)], ledger.SCHEMA))
    assert sorted(r.row_id for r in ledger.winners().collect()) == [1, 3, 4, 5]


def test_ledger_index_and_writers(spark, tmp_path):
    ledger = deliveries.Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    many = [(f"m{n}", n, n, n % 7) for n in range(200)] + [(None, 900, 1, 2), (None, 901, 1, 2)]
    ledger.deliver(spark.createDataFrame(many, ledger.SCHEMA))
    _, state = ledger._state()
    assert 1 < len(state["index"]) <= 4
    # the index alone names the partitions of a delivery, and reads only the buckets of its keys
    some = spark.createDataFrame([("m3", 500, 0, 8), ("new", 501, 0, 8), (None, 902, 1, 9)], ledger.SCHEMA)
    assert ledger.affected(some, state["index"]) == {"3"}
    assert ledger.deliver(some) == ["3", "8", "9"]
    got = {r.row_id for r in ledger.winners().collect()}
    assert got == {n for n in range(200) if n != 3} | {500, 501, 900, 901, 902}
    # the winner moved: the message is found in its new partition
    assert "8" in ledger.affected(spark.createDataFrame([("m3", 1, 1, 1)], ledger.SCHEMA), ledger._state()[1]["index"])
    # another writer commits between: the commit fails, the delivery starts again and loses nothing
    seen, state = ledger._state()
    ledger.deliver(spark.createDataFrame([("late", 700, 0, 1)], ledger.SCHEMA))
    with pytest.raises(deliveries.StaleLedger):
        ledger._commit(seen, state)
    other, once = deliveries.Ledger(spark, f"{tmp_path}/ledger", buckets=4), []
    real = ledger._commit

    def late(seen, state):
        if not once:
            once.append(1)
            other.deliver(spark.createDataFrame([("between", 701, 0, 1)], ledger.SCHEMA))
        real(seen, state)

    ledger._commit = late
    ledger.deliver(spark.createDataFrame([("after", 702, 0, 1)], ledger.SCHEMA))
    got |= {700, 701, 702}
    assert {r.row_id for r in ledger.winners().collect()} == got
    assert ledger.vacuum() and {r.row_id for r in ledger.winners().collect()} == got and not ledger.vacuum()
    ledger.deliver(spark.createDataFrame([], ledger.SCHEMA))
    assert {r.row_id for r in ledger.winners().collect()} == got


def test_nested_intervals_and_shapes(spark):
    payloads = [
        json.dumps({"format_examples": ["x", None, "y"], "metadata": '{"puzzle_id": "p"}', "inference": {"extracted": [{"item": "i", "squares": ["a1", None, "b2"]}, "t"], "attempts": {"outcome": "ok", "chunks": {"kind": "k"}}}}),
        '{"inference": {"extracted": "a, b", "attempts": [], "other": {"deep": [[1], {"z": null}]}}, "metadata": null}',
        '{"metadata": {"puzzle_id": null}, "format_examples": ""',
        None, "", "[]", "{}",
    ]
    df = spark.createDataFrame([(n, p, 1) for n, p in enumerate(payloads)], "raw_id long, payload string, nodes int")
    got = sorted(tuple(r) for r in nested.flat_nodes(df).collect())
    assert got == sorted([
        (0, "record", 0, 1, "p"), (0, "example", 0, 1, "x"), (0, "example", 0, 3, "y"), (0, "extracted", 0, 1, "i"), (0, "extracted", 0, 2, "t"), (0, "square", 1, 1, "a1"), (0, "square", 1, 3, "b2"),
        (0, "attempt", 0, 1, "ok"), (0, "chunk", 1, 1, "k"), (1, "record", 0, 1, ""), (1, "extracted", 0, 1, "a, b"), (6, "record", 0, 1, ""),
    ])
    labels = nested.label(json.loads(payloads[0]))
    for a in labels:  # intervals nest or are apart
        for b in labels:
            assert a[4] < b[3] or b[4] < a[3] or (a[3] <= b[3] and b[4] <= a[4]) or (b[3] <= a[3] and a[4] <= b[4])
    assert nested.flat_nodes(df.limit(0)).count() == 0


def test_many_siblings_and_containment():
    record = {"inference": {"extracted": [{"item": i, "squares": [f"a{i}", f"b{i}"]} for i in range(3000)], "attempts": [{"outcome": "x", "chunks": [{"kind": "k"}] * 3}] * 500}}
    nodes = nested.label(record)
    parents = nested.contained(nodes)
    got = [(n[1], p) for n, p in zip(nodes, parents, strict=True) if n[1] in ("square", "chunk")]
    assert got == [("square", i) for i in range(1, 3001) for _ in range(2)] + [("chunk", i) for i in range(1, 501) for _ in range(3)]
    few = nodes[:200]  # against the containment of all pairs
    for k, (_, node, _, pre, _, _) in enumerate(few):
        up = nested.PARENTS.get(node)
        holders = [m for m in few if m[1] == up and m[3] < pre <= m[4]]
        assert parents[k] == (holders[-1][2] if up and holders else 0)


def test_nested_depth_is_no_limit():
    deep: dict = {}
    for _ in range(5000):
        deep = {"a": deep}
    assert len(nested.label(deep)) == 5001


FILES = "stream string, file_no int, line_no int, record_key string, payload string, path string"


def _files(spark, rows):
    return spark.createDataFrame([(s, f, n, k, p if p is None or isinstance(p, str) else json.dumps(p), "x") for n, (s, f, k, p) in enumerate(rows)], FILES)


def test_drift_changes(spark):
    rows = []
    for k in range(4):
        rows += [
            ("s", 1, f"k{k}", {"a": {"x": k, "old": f"v{k}"}, "n": None, "gone": 1}),
            ("s", 3, f"k{k}", {"a": {"x": str(k), "new": f"v{k}"}, "n": 5, "more": None}),
            ("s", 4, f"k{k}", {"a": {"x": None, "new": f"v{k}"}, "n": 6, "gone": "text"}),
            ("s", 5, f"k{k}", {"a": {"x": [1], "new": f"v{k}"}, "n": True, "gone": 2}),
        ]
    rows += [("s", 3, "k9", "no json"), ("s", 2, "k1", "{"), ("t", 1, None, {"z": 1}), ("t", 2, None, {"y": 1}), (None, 1, "k", {"q": 1}), ("s", 5, "k1", None), ("s", 5, "k1", "[1]")]
    got = sorted(tuple(r) for r in drift.changes(_files(spark, rows)).collect())
    assert got == sorted([
        ("s", 3, "renamed", "a.new", "a.old"), ("s", 3, "type_changed", "a.x", ""), ("s", 3, "removed", "gone", ""), ("s", 3, "added", "more", ""),
        ("s", 4, "removed", "more", ""), ("s", 4, "added", "gone", ""), ("s", 5, "type_changed", "a.x", ""), ("s", 5, "type_changed", "n", ""), ("s", 5, "type_changed", "gone", ""),
        ("t", 2, "added", "y", ""), ("t", 2, "removed", "z", ""),
    ])
    assert drift.changes(_files(spark, rows).limit(0)).count() == 0


def test_drift_needs_three_agreeing_values(spark):
    rows = [("s", f, f"k{k}", {("a" if f == 1 else "b"): k}) for f in (1, 2) for k in range(2)]
    assert sorted(r.change for r in drift.changes(_files(spark, rows)).collect()) == ["added", "removed"]


def test_consistent_table_follows_renames(spark):
    rows = [("s", f, f"k{k}", {("a" if f == 1 else "b"): k if k else "bad"}) for f in (1, 2) for k in range(4)]
    got = drift.consistent_table(_files(spark, rows), {"b": "long"}).collect()
    assert sorted((r.file_no, r.b, tuple(r.cast_failures)) for r in got if r.b is not None) == [(f, k, ()) for f in (1, 2) for k in (1, 2, 3)]
    assert sorted(r.file_no for r in got if list(r.cast_failures) == ["b"]) == [1, 2]


def test_consistent_table_loses_no_field(spark):
    rows = [("s", f, f"k{k}", {("a" if f == 1 else "b"): k, ("x" if f == 1 else "y"): f"v{k}", "m": {"n": [k], "o": None}}) for f in (1, 2) for k in range(4)]
    rows += [("s", 2, "bad", {"b": "bad", "y": "v"}), ("s", 3, "two", {"a": 8, "b": 9})]
    got = {(r.file_no, r.record_key): r for r in drift.consistent_table(_files(spark, rows), {"b": "long"}).collect()}
    assert all(got[f, f"k{k}"].b == k and got[f, f"k{k}"].other_fields == {"y": [f"v{k}"], "m.n": [f"[{k}]"], "m.o": [None]} for f in (1, 2) for k in range(4))
    assert got[2, "bad"].other_fields == {"b": ["bad"], "y": ["v"]} and list(got[2, "bad"].cast_failures) == ["b"]
    assert got[3, "two"].b == 9 and got[3, "two"].other_fields == {"a": ["8"]}  # another field under the old name


def test_consistent_table_tells_reused_names_apart(spark):
    rows = []
    for k in range(5):
        rows += [("s", 1, f"k{k}", {"a": k, "c": f"x{k}"}), ("s", 2, f"k{k}", {"b": k, "c": f"x{k}"}), ("s", 3, f"k{k}", {"b": k, "c": f"x{k}", "d.e": 1})]
        rows += [("s", 4, f"k{k}", {"a": 900 + k, "b": k, "d": {"f": True}, "d_f": 1.5}), ("s", 5, f"k{k}", {"a": 900 + k, "d": {"f": "no"}})]
    for shipped in (drift.SHIPPED, 0):
        table = drift.consistent_table(_files(spark, rows), shipped=shipped)
        got = {(r.file_no, r.record_key): r.asDict() for r in table.collect()}
        assert dict(table.dtypes)["a"] == "bigint" and dict(table.dtypes)["b"] == "bigint" and dict(table.dtypes)["d_f_2"] in ("double", "boolean")
        for k in range(5):
            assert [got[f, f"k{k}"]["b"] for f in (1, 2, 3, 4, 5)] == [k, k, k, k, None]
            assert [got[f, f"k{k}"]["a"] for f in (1, 2, 3, 4, 5)] == [None, None, None, 900 + k, 900 + k]
        assert sorted(map(tuple, drift.changes(_files(spark, rows), shipped).collect())) == sorted(map(tuple, drift.changes(_files(spark, rows)).collect()))
    # a field renamed into a name that another one had before it
    rows = [("t", f, f"k{k}", {**({"a": k} if f < 3 else {}), **({"b": 70 - k} if f == 1 else {}), **({"b": k} if f == 3 else {})}) for f in (1, 2, 3) for k in range(4)]
    got = {(r.file_no, r.record_key): r for r in drift.consistent_table(_files(spark, rows)).collect()}
    assert all([got[f, f"k{k}"].b for f in (1, 2, 3)] == [k, k, k] and got[1, f"k{k}"]["b@1"] == 70 - k for k in range(4))
    assert drift.consistent_table(_files(spark, rows).limit(0)).count() == 0
