"""Deeply nested JSON records as related flat tables (problem 3).

Every node of a record gets an interval label by one depth-first traversal: `pre` is its
pre-order number and `post` the largest pre-order number below it, so that b lies under a
exactly if a.pre < b.pre <= a.post. Node tables per type are selections of the labelled
nodes; a child is linked to its parent by interval containment inside the same record.

Defined results: payloads that are null or do not parse, or whose root is no object, give
no node; a single value or object in place of an array is an array of one; missing, null,
'' and [] give no elements; null elements keep their place but give no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = "raw_id long, path string, node string, node_no long, pre int, post int, val string"

#: Paths of the nodes that make up the tables: type, the key that holds the elements.
_ELEMENTS = {"format_examples": "example", "inference.extracted": "extracted", "inference.extracted.squares": "square", "inference.attempts": "attempt", "inference.attempts.chunks": "chunk"}


def _text(v) -> str:
    """A scalar as text; booleans and numbers as JSON writes them."""
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)


def _shown(kind: str, v) -> str:
    """The value that the table of this type shows for a node."""
    if isinstance(v, dict):
        return _text(v.get({"extracted": "item", "attempt": "outcome", "chunk": "kind"}.get(kind, "")))
    return "" if kind in ("attempt", "chunk") else _text(v)


def label(record: dict) -> list[tuple]:
    """(path, node, node_no, pre, post, val) of every node of a record, in pre-order.

    The walk keeps its own stack, so the depth of a record is no limit. `node` is '' for
    nodes that belong to no table; arrays of the tables are unwrapped to their elements.
    """
    meta = record.get("metadata")
    if isinstance(meta, str):
        try:
            meta = json.loads(meta)
        except ValueError:
            meta = None
    puzzle = _text(meta.get("puzzle_id")) if isinstance(meta, dict) else ""
    out: list[list] = [["", "record", 1, 0, 0, puzzle]]
    stack: list = [("close", 0)] + [("open", k, v) for k, v in reversed(list(record.items()))]
    while stack:
        step = stack.pop()
        if step[0] == "close":
            out[step[1]][4] = len(out) - 1
            continue
        _, path, v = step[:3]
        kind = _ELEMENTS.get(path, "")
        if len(step) == 3 and kind:  # an array of a table, or what stands for it
            items = v if isinstance(v, list) else [] if v is None or v == "" else [v]
            for no in range(len(items), 0, -1):
                if items[no - 1] is not None:
                    stack.append(("open", path, items[no - 1], no))
            continue
        at = len(out)
        out.append([path, kind, step[3] if len(step) > 3 else 1, at, at, _shown(kind, v) if kind else None])
        stack.append(("close", at))
        if isinstance(v, dict):
            stack.extend(("open", f"{path}.{k}", w) for k, w in reversed(list(v.items())))
        elif isinstance(v, list):
            stack.extend(("open", f"{path}[]", w, n) for n, w in reversed(list(enumerate(v, 1))))
    return [tuple(x) for x in out]


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.struct([("path", pa.string()), ("node", pa.string()), ("node_no", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("val", pa.string())])
    for b in batches:
        ids, rows = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                record = json.loads(text) if text is not None else None
            except (ValueError, RecursionError):
                continue
            if isinstance(record, dict):
                ids.append(i)
                rows.append([dict(zip(("path", "node", "node_no", "pre", "post", "val"), x, strict=True)) for x in label(record)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(node))], ["raw_id", "nodes"])


def labelled(records: DataFrame, id_col: str = "raw_id", payload: str = "payload") -> DataFrame:
    """raw_id and the interval-labelled nodes of every record that parses."""
    return records.select(F.col(id_col).cast("long").alias("raw_id"), F.col(payload).alias("payload")).mapInArrow(
        _label_batches, "raw_id long, nodes array<struct<path:string,node:string,node_no:long,pre:int,post:int,val:string>>"
    )


def node_table(nodes: DataFrame, node: str) -> DataFrame:
    """The flat table of one type: raw_id, node_no, pre, post, val."""
    return nodes.select("raw_id", F.explode(F.filter("nodes", lambda n: n["node"] == node)).alias("n")).select("raw_id", "n.node_no", "n.pre", "n.post", "n.val")


#: The type whose nodes may contain nodes of the key's type.
PARENTS = {"square": "extracted", "chunk": "attempt"}


def contained(nodes: list[tuple]) -> list[int]:
    """parent_no of each labelled node, in pre-order: the node_no of the innermost node of its
    parent type whose interval holds it, else 0. One sweep over the intervals, however many
    nodes a record has."""
    out: list[int] = []
    open_: dict[str, list[tuple[int, int]]] = {up: [] for up in PARENTS.values()}
    for _, node, no, pre, post, _ in nodes:
        up = PARENTS.get(node)
        parent = 0
        if up:
            held = open_[up]
            while held and held[-1][0] < pre:
                held.pop()  # its interval ends before this node
            parent = held[-1][1] if held else 0
        out.append(parent)
        if node in open_:
            held = open_[node]
            while held and held[-1][0] < pre:
                held.pop()
            held.append((post, no))
    return out


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        ids, nos, parents, kinds, vals = cols
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                record = json.loads(text) if text is not None else None
            except (ValueError, RecursionError):
                continue
            if isinstance(record, dict):
                nodes = label(record)
                for (_, kind, no, _, _, val), parent in zip(nodes, contained(nodes), strict=True):
                    if kind:
                        ids.append(i)
                        kinds.append(kind)
                        parents.append(parent)
                        nos.append(no)
                        vals.append(val)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(parents, pa.int64()), pa.array(nos, pa.int64()), pa.array(vals, pa.string())], ["raw_id", "node", "parent_no", "node_no", "val"]
        )


def flat_nodes(records: DataFrame, id_col: str = "raw_id", payload: str = "payload") -> DataFrame:
    """raw_id, node, parent_no, node_no, val: one row per node of every record. All labels of
    a record are at hand where it is read, so the containment needs no join and no shuffle."""
    return records.select(F.col(id_col).cast("long").alias("raw_id"), F.col(payload).alias("payload")).mapInArrow(_node_batches, "raw_id long, node string, parent_no long, node_no long, val string")
