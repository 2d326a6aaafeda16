"""Schemas that drift between the files of a stream (problem 4).

Rows are loaded as path -> (raw type, value) entries; the type statistics of every path
are aggregated by file, in each task first; windows over the files of a stream then yield
what was added, removed or changed its type. Values are read only of fields that come or
go, and only in the two files between which they do; they tell the renames.
`consistent_table` projects typed columns under the newest names and reports every cast
that fails.

Defined results: lines that do not parse, or are no object, count for nothing; a file
without any parsed line is skipped; repeated lines count once as far as values are
compared; if several types occur in one file, the most frequent counts (ties: by name).
A value is compared by its JSON text with sorted keys; a null or missing value agrees only
with a null or missing one. In the table a field is known by its path and the files in
which it has it: a path that is used again for another field is another column.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.session import materialise, release

#: Rows of a lookup (fields of files) that are sent to every worker; a larger one is joined.
SHIPPED = 200_000
#: Columns that `consistent_table` derives at most; further fields stay in `other_fields`.
MOST_COLUMNS = 2000
#: Counts that a task holds before it hands them on.
_COUNTS = 200_000


def _raw_type(v) -> str | None:
    return None if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array"


def _record(text: str | None) -> dict | None:
    try:
        record = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def walk(record: dict) -> list[tuple[str, object]]:
    """(dotted path, value) of every value that is no object."""
    out, stack = [], [("", record)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{at}.{k}" if at else k, w) for k, w in v.items())
        else:
            out.append((at, v))
    return out


def _compared(v) -> str | None:
    """A value as it is compared; long ones by digest, so that the entry stays small."""
    if v is None:
        return None
    text = json.dumps(v, sort_keys=True, ensure_ascii=False)
    return text if len(text) <= 64 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _shown(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("stream", F.col("file_no").cast("int").alias("file_no"), "record_key", "payload").where("stream is not null and file_no is not null and payload is not null")


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("stream", "file_no", "path", "type", "n", "whole")
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
    counts: Counter[tuple] = Counter()
    wholes: Counter[tuple] = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*k, n, wholes[k]) for k, n in counts.items()]
        counts.clear()
        wholes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

    for b in batches:
        for stream, file_no, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            record = _record(text)
            for path, v in walk(record) if record else ():
                key = (stream, file_no, path, _raw_type(v))
                counts[key] += 1
                if type(v) is int and -(2**63) <= v < 2**63:
                    wholes[key] += 1
        if len(counts) > _COUNTS:
            yield flush()
    if counts:
        yield flush()


def path_types(files: DataFrame) -> DataFrame:
    """stream, file_no, path, type, n, whole: the type statistics of each file, reduced to its
    type (null where all values are null); n values of the path, `whole` of them whole numbers."""
    counts = _lines(files).select("stream", "file_no", "payload").mapInArrow(_stat_batches, "stream string, file_no int, path string, type string, n long, whole long")
    counts = counts.groupBy("stream", "file_no", "path", "type").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    best = F.max_by("type", F.when(F.col("type").isNotNull(), F.struct(F.col("n"), F.col("type"))))
    return counts.groupBy("stream", "file_no", "path").agg(best.alias("type"), F.sum("n").alias("n"), F.sum("whole").alias("whole"))


def _runs(stats: DataFrame) -> DataFrame:
    """The path statistics with the number of the file, the next file, the run of files
    without a gap (island) that the path is in, and whether it comes or goes there."""
    numbered = stats.select("stream", "file_no").distinct()
    order = Window.partitionBy("stream").orderBy("file_no")
    numbered = numbered.select("*", F.row_number().over(order).alias("no"), F.lead("file_no").over(order).alias("next_file"))
    per = Window.partitionBy("stream", "path").orderBy("no")
    return (
        stats.join(numbered, ["stream", "file_no"])
        .withColumn("island", F.col("no") - F.row_number().over(per))
        .withColumn("comes", (F.col("no") > 1) & ~F.lag("no").over(per).eqNullSafe(F.col("no") - 1))
        .withColumn("goes", F.col("next_file").isNotNull() & ~F.lead("no").over(per).eqNullSafe(F.col("no") + 1))
    )


def _value_batches(asked: dict[tuple[str, int], list[tuple[str, int, frozenset[str]]]]):
    """asked: (stream, file) -> (role, later file of the pair, paths). One row for each record
    and role: the values of the paths asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for stream, file_no, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                record = _record(text) if (stream, file_no) in asked else None
                if record is None:
                    continue
                values = walk(record)
                for role, pair, paths in asked[stream, file_no]:
                    got = [{"path": p, "value": x} for p, v in values if p in paths and (x := _compared(v)) is not None]
                    for c, x in zip(cols, (stream, pair, key, role, got), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), entry), strict=True)], ["stream", "pair", "record_key", "role", "entries"])

    return run


_VALUES = "stream string, pair int, record_key string, role string, entries array<struct<path:string,value:string>>"


def _joined_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _value_batches, where each line brings along what is asked of its file."""
    for b in batches:
        t = b.to_pylist()
        for r in t:
            asked = {(r["stream"], r["file_no"]): [(a["role"], a["pair"], frozenset(a["paths"])) for a in r["asked"]]}
            one = pa.RecordBatch.from_pylist([{k: r[k] for k in ("stream", "file_no", "record_key", "payload")}], pa.schema([("stream", pa.string()), ("file_no", pa.int32()), ("record_key", pa.string()), ("payload", pa.string())]))
            yield from _value_batches(asked)(iter([one]))


def _renames(files: DataFrame, came: DataFrame, gone: DataFrame, shipped: int) -> DataFrame:
    """stream, file_no, new_path, old_path of the fields that only changed their name."""
    by = ["stream", "file_no"]
    pairs = gone.groupBy(*by, "before").agg(F.array_sort(F.collect_set("old_path")).alias("old_paths")).join(came.groupBy(*by).agg(F.array_sort(F.collect_set("new_path")).alias("new_paths")), by)
    pairs = materialise(pairs, "changed-files")
    new = pairs.select("stream", "file_no", F.lit("new").alias("role"), F.col("file_no").alias("pair"), F.col("new_paths").alias("paths"))
    old = pairs.select("stream", F.col("before").alias("file_no"), F.lit("old").alias("role"), F.col("file_no").alias("pair"), F.col("old_paths").alias("paths"))
    asked = new.unionByName(old)
    lines = _lines(files).where("record_key is not null")
    if pairs.agg(F.coalesce(F.sum(F.size("old_paths") + F.size("new_paths")), F.lit(0))).first()[0] <= shipped:
        table: dict = {}
        for r in asked.collect():
            table.setdefault((r["stream"], r["file_no"]), []).append((r["role"], r["pair"], frozenset(r["paths"])))
        lines = lines.join(F.broadcast(asked.select(*by).distinct()), by, "left_semi").select("stream", "file_no", "record_key", "payload")
        found = lines.mapInArrow(_value_batches(table), _VALUES)
    else:
        wanted = asked.groupBy(*by).agg(F.collect_list(F.struct("role", "pair", "paths")).alias("asked"))
        found = lines.join(wanted, by).select("stream", "file_no", "record_key", "payload", "asked").mapInArrow(_joined_values, _VALUES)
    # one row for each record that both files of a pair hold; repeated lines give one value
    both = found.groupBy("stream", "pair", "record_key").agg(F.collect_set(F.when(F.col("role") == "old", F.col("entries"))).alias("old"), F.collect_set(F.when(F.col("role") == "new", F.col("entries"))).alias("new")).where("size(old) > 0 and size(new) > 0")
    value = lambda side, path: F.array_max(F.transform(F.filter(F.flatten(side), lambda e: e["path"] == F.col(path)), lambda e: e["value"]))
    compared = both.withColumnRenamed("pair", "file_no").join(pairs.drop("before"), by).withColumn("old_path", F.explode("old_paths")).withColumn("new_path", F.explode("new_paths"))
    compared = compared.select(*by, "old_path", "new_path", value("old", "old_path").alias("old_value"), value("new", "new_path").alias("new_value"))
    matched = (
        compared.groupBy(*by, "old_path", "new_path")
        .agg(F.count_if(F.col("old_value") == F.col("new_value")).alias("agree"), F.count_if(~F.col("old_value").eqNullSafe(F.col("new_value"))).alias("differ"), F.approx_count_distinct("new_value", 0.02).alias("values"))
        .where("agree >= 3 and differ = 0")
    )
    # one old path for each new one: the nearest name among those whose values agree
    leaf = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, r"\."), -1), "[^A-Za-z0-9]", ""))
    parent = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    score = F.struct(
        F.col("values"), (parent(F.col("old_path")) == parent(F.col("new_path"))).cast("int").alias("same_parent"), (-F.levenshtein(leaf(F.col("old_path")), leaf(F.col("new_path")))).alias("near")
    )
    matched = matched.withColumn("score", score)
    first = lambda c, other: F.row_number().over(Window.partitionBy(*by, c).orderBy(F.col("score").desc(), F.col(other)))
    best = matched.withColumn("a", first("new_path", "old_path")).withColumn("b", first("old_path", "new_path")).where("a = 1 and b = 1")
    return materialise(best.select(*by, "new_path", "old_path"), "renamed-fields")


def _drift(files: DataFrame, shipped: int = SHIPPED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Path statistics with their runs; the events among them; the renames."""
    stats = materialise(path_types(files), "path-types")
    runs = _runs(stats)
    known = F.last("type", ignorenulls=True).over(Window.partitionBy("stream", "path", "island").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    runs = materialise(runs.withColumn("known", known), "path-runs")
    release(stats)
    events = runs.where("comes or goes or (known is not null and type is not null and known != type)")
    came = events.where("comes").select("stream", "file_no", F.col("path").alias("new_path"))
    gone = events.where("goes").select("stream", F.col("file_no").alias("before"), F.col("next_file").alias("file_no"), F.col("path").alias("old_path"))
    return runs, events, _renames(files, came, gone, shipped)


def changes(files: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """stream, file_no, change, path, old_path."""
    _, events, renamed = _drift(files, shipped)
    none = F.lit("").alias("old_path")
    # each event row gives its changes; a rename takes the place of a coming and a going
    told = events.select(F.explode(F.array_compact(F.array(
        F.when(F.col("known").isNotNull() & F.col("type").isNotNull() & (F.col("known") != F.col("type")), F.struct("stream", "file_no", F.lit("type_changed").alias("change"), "path")),
        F.when(F.col("comes"), F.struct("stream", "file_no", F.lit("added").alias("change"), "path")),
        F.when(F.col("goes"), F.struct("stream", F.col("next_file").alias("file_no"), F.lit("removed").alias("change"), "path")),
    ))).alias("x")).select("x.*", none)
    taken = renamed.select("stream", "file_no", F.explode(F.array(F.struct(F.lit("added").alias("change"), F.col("new_path").alias("path")), F.struct(F.lit("removed").alias("change"), F.col("old_path").alias("path")))).alias("x")).select("stream", "file_no", "x.*")
    return told.join(taken, ["stream", "file_no", "change", "path"], "left_anti").unionByName(renamed.select("stream", "file_no", F.lit("renamed").alias("change"), F.col("new_path").alias("path"), "old_path"))


def field_runs(files: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """stream, path, first_file, last_file, field, type, n: in which files a path stands for
    which field. A field is named by the newest path that renames lead to. If another field
    had that path in some of the same files, the one that ended earlier is told apart by its
    last file."""
    runs, _, renamed = _drift(files, shipped)
    last = F.max_by("type", F.when(F.col("type").isNotNull(), F.col("no")))
    per = runs.groupBy("stream", "path", "island").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.max_by("next_file", "no").alias("ends"), last.alias("type"), F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum(F.when(F.col("type") == "number", F.col("n")).otherwise(0)).alias("numbers"))
    step = renamed.select("stream", F.col("old_path").alias("path"), F.col("file_no").alias("ends"), F.col("new_path").alias("to_path"))
    # a run points to the run that begins under the new name where it ends; else to itself
    links = per.join(step, ["stream", "path", "ends"], "left").select("stream", "path", "first_file", "last_file", "type", "n", "whole", "numbers", F.coalesce("to_path", "path").alias("end_path"), F.when(F.col("to_path").isNotNull(), F.col("ends")).otherwise(F.col("first_file")).alias("end_first"))
    links = materialise(links, "field-runs")
    while True:  # jumps double the length of the way that is known
        ahead = links.select("stream", F.col("path").alias("end_path"), F.col("first_file").alias("end_first"), F.col("end_path").alias("far_path"), F.col("end_first").alias("far_first"))
        far = links.join(ahead, ["stream", "end_path", "end_first"])
        moved = F.col("far_first") != F.col("end_first")
        new = materialise(far.select("stream", "path", "first_file", "last_file", "type", "n", "whole", "numbers", F.col("far_path").alias("end_path"), F.col("far_first").alias("end_first"), moved.alias("moved")), "field-runs")
        release(links)
        links = new
        if links.where("moved").isEmpty():
            break
    # a field: all runs that lead to the same newest run
    whole = links.groupBy("stream", "end_path", "end_first").agg(F.min("first_file").alias("begin"), F.max("last_file").alias("end"))
    later = Window.partitionBy("stream", "end_path").orderBy(F.col("end").desc(), F.col("end_first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("clash", F.coalesce(F.min("begin").over(later) <= F.col("end"), F.lit(False)))
    name = F.when(F.col("clash"), F.concat("end_path", F.lit("@"), F.col("end").cast("string"))).otherwise(F.col("end_path"))
    named = whole.select("stream", "end_path", "end_first", name.alias("field"))
    return links.join(named, ["stream", "end_path", "end_first"]).select("stream", "path", "first_file", "last_file", "field", "type", "n", "whole", "numbers")


def field_types(fields: DataFrame) -> DataFrame:
    """field, type: the Spark type of each field over all streams; the type that most of its
    values have in the files it was told in (ties: by name); numbers are long if all are whole."""
    by = fields.where("type is not null").groupBy("field", "type").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum("numbers").alias("numbers"))
    best = by.groupBy("field").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("whole").alias("whole"), F.sum("n").alias("n"), F.sum("numbers").alias("numbers"))
    spark_type = F.when(F.col("type") == "number", F.when(F.col("whole") >= F.col("numbers"), "long").otherwise("double")).when(F.col("type") == "array", "array<string>").otherwise(F.col("type"))
    return best.select("field", spark_type.alias("type"), "n")


_FIXED = ("stream", "file_no", "line_no", "record_key", "cast_failures", "other_fields")


def _columns(fields: list[str]) -> dict[str, str]:
    """field -> column; names that fall together are numbered."""
    out, used = {}, {c.lower() for c in _FIXED}
    for f in fields:
        name, k = f.replace(".", "_").replace("`", "_"), 1
        while name.lower() in used:
            k += 1
            name = f"{f.replace('.', '_').replace('`', '_')}_{k}"
        used.add(name.lower())
        out[f] = name
    return out


_ROWS = "stream string, file_no int, line_no int, record_key string, fields map<string,string>"


def _field_batches(lookup: dict[tuple[str, str], list[tuple[int, int, str]]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.map_(pa.string(), pa.string())
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for k, (stream, file_no, line_no, key, text) in enumerate(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)):
                record = _record(text)
                if record is None:
                    continue
                known = lookup if lookup is not None else {(stream, r["path"]): [(r["first_file"], r["last_file"], r["field"])] for r in b.column(5)[k].as_py() or ()}
                row = {}
                for path, v in walk(record):
                    spans = known.get((stream, path), ())
                    row[next((f for a, e, f in spans if file_no is not None and a <= file_no <= e), path)] = _shown(v)
                for c, x in zip(cols, (stream, file_no, line_no, key, list(row.items())), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pairs), strict=True)], ["stream", "file_no", "line_no", "record_key", "fields"])

    return run


def consistent_table(files: DataFrame, types: dict[str, str] | None = None, shipped: int = SHIPPED) -> DataFrame:
    """Rows of all files under the newest field names, one typed column for each field.

    types: field -> Spark type; without it the columns and their types are derived from the
    statistics of all files. Adds `cast_failures`, the names of the fields of a row that are
    present but cannot be cast; such a field is null. `other_fields` holds every field without
    a column, with its value as text, and the text of values that could not be cast, so that
    nothing is lost."""
    spark = files.sparkSession
    runs = materialise(field_runs(files, shipped), "fields")
    if types is None:
        few = field_types(runs).orderBy(F.col("n").desc(), "field").limit(MOST_COLUMNS)
        types = {r["field"]: r["type"] for r in sorted(few.collect(), key=lambda r: r["field"])}
    lines = files.select("stream", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "record_key", "payload")
    # only paths that stand for a field of another name are looked up
    other = runs.where("path != field").select("stream", "path", "first_file", "last_file", "field")
    if other.count() <= shipped:
        lookup: dict = {}
        for r in other.collect():
            lookup.setdefault((r["stream"], r["path"]), []).append((r["first_file"], r["last_file"], r["field"]))
        held = spark.sparkContext.broadcast(lookup)
        rows = lines.mapInArrow(lambda batches: _field_batches(held.value)(batches), _ROWS)
    else:
        per_file = lines.select("stream", "file_no").distinct().join(other, "stream").where("file_no between first_file and last_file").groupBy("stream", "file_no").agg(F.collect_list(F.struct("path", "first_file", "last_file", "field")).alias("known"))
        rows = lines.join(per_file, ["stream", "file_no"], "left").select("stream", "file_no", "line_no", "record_key", "payload", "known").mapInArrow(_field_batches(None), _ROWS)
    names = _columns(list(types))
    text = lambda f: F.col("fields")[F.lit(f)]
    cast = {f: F.from_json(text(f), t) if t.startswith("array") else text(f) if t == "string" else text(f).try_cast(t) for f, t in types.items()}
    failed = F.array_compact(F.array(*[F.when(text(f).isNotNull() & c.isNull(), F.lit(f)) for f, c in cast.items() if types[f] != "string"])) if any(t != "string" for t in types.values()) else F.array().cast("array<string>")
    table = rows.select(*_FIXED[:4], *[c.alias(names[f]) for f, c in cast.items()], failed.alias("cast_failures"), "fields")
    typed = F.array(*[F.lit(f) for f in types]) if types else F.array().cast("array<string>")
    rest = F.map_filter("fields", lambda k, v: ~F.array_contains(typed, k) | F.array_contains("cast_failures", k))
    return table.withColumn("other_fields", F.transform_values(rest, lambda k, v: F.array(v))).drop("fields")
