"""Messages delivered at least once: keep exactly one copy of each (problem 2).

The operator keeps a *ledger*: the single winners of all messages seen so far, stored in
arrival partitions, and a stored identifier index, (message hash, partition) entries in
buckets by hash. A delivery of new messages reads the buckets of its identifiers, takes from
them the affected partitions, reads only those, combines them with the incoming rows,
recomputes the single winners, writes the partitions and the new index entries, and commits
all of it as one new manifest. Readers see the old or the new state, never a mix; of two
writers that began from the same state one commits, the other starts again.

Defined results: a row whose message key has a null part is no repeat of anything and
always stays; a row with a null order value comes after all others; ties go to the smallest
row id; an empty delivery changes nothing; a delivery may repeat rows already in the ledger.
Two messages of one hash only make a delivery read one partition more.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.session import materialise, scratch

#: White space of any kind at either end of an identifier.
_EDGE = r"^[\s\p{Z}\x{200B}\x{FEFF}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{200B}\x{FEFF}\x{85}\x1c-\x1f]+$"


def clean_identifier(c: Column) -> Column:
    """Identifier without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, _EDGE, ""))


def instant(c: Column) -> Column:
    """ISO-like text -> microseconds since the epoch; a form without zone is UTC; null if unreadable."""
    t = F.regexp_replace(c, _EDGE, "")
    zoned = F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.when(t.rlike(r"\d:\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.unix_micros(zoned.try_cast("timestamp"))


class StaleLedger(RuntimeError):
    """Another writer committed first."""


class Ledger:
    """Winners by arrival partition. Rows: message (string, null: no identifier), row_id
    (long, unique), rank (long, null last), part (int, arrival partition)."""

    SCHEMA = "message string, row_id long, rank long, part int"
    INDEX = "key long, part int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, tries: int = 5):
        self.spark, self.root, self.buckets, self.tries = spark, root, buckets, tries
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # manifest: numbered files, each a whole state ---------------------------------------
    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _list(self, path) -> list:
        fs = path.getFileSystem(self._conf)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(self._path(""))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("MANIFEST-"))

    def _state(self) -> tuple[int, dict]:
        known = self._versions()
        if not known:
            return 0, {"parts": {}, "index": {}}
        p = self._path(f"MANIFEST-{known[-1]}")
        stream = p.getFileSystem(self._conf).open(p)
        try:
            return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict[str, list[str]]:
        """partition -> directories of its current version"""
        return self._state()[1]["parts"]

    def _commit(self, seen: int, state: dict) -> None:
        """Make `state` the one that follows the state that was seen, or fail: the rename
        does not overwrite, so only one writer can take a number."""
        tmp, to = self._path(f"tmp-{uuid.uuid4().hex}"), self._path(f"MANIFEST-{seen + 1}")
        out = tmp.getFileSystem(self._conf).create(tmp)
        out.write(json.dumps(state).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(to.toUri(), self._conf).rename(tmp, to, none)
        except Py4JJavaError as e:
            tmp.getFileSystem(self._conf).delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise StaleLedger(f"{to} was committed by another writer") from e
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove directories that none of the last `keep` states names, and older states.
        Only for times without another delivery under way."""
        known = self._versions()
        used: set[str] = set()
        for v in known[-keep:]:
            p = self._path(f"MANIFEST-{v}")
            stream = p.getFileSystem(self._conf).open(p)
            state = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            used |= {d.rsplit("/", 1)[0].rsplit("/", 1)[-1] for kind in state.values() for dirs in kind.values() for d in dirs}
        gone = []
        for s in self._list(self._path("")):
            name = s.getPath().getName()
            if (name.startswith(("v-", "i-")) and name not in used) or (name.startswith("MANIFEST-") and int(name.split("-")[1]) in known[:-keep]):
                s.getPath().getFileSystem(self._conf).delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)

    # reading ------------------------------------------------------------------------------
    def _read(self, dirs: list[str], schema: str) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(dirs))

    def winners(self) -> DataFrame:
        return self._read([d for dirs in self.manifest().values() for d in dirs], self.SCHEMA)

    # writing ------------------------------------------------------------------------------
    @staticmethod
    def single(rows: DataFrame) -> DataFrame:
        """The winner of each message; `fresh`: a row without a part in `stored` is among its
        copies. The aggregate combines before the shuffle, so a message that holds a third
        of all rows is one row a task; rows without an identifier are grouped by their own
        row id."""
        fresh = F.max("fresh") if "fresh" in rows.columns else F.lit(True)
        return (
            rows.groupBy("message", F.when(F.col("message").isNull(), F.col("row_id")).alias("own"))
            .agg(F.min(F.struct(F.col("rank").isNull().alias("n"), F.col("rank").alias("rank"), F.col("row_id").alias("row_id"), F.col("part").alias("part"))).alias("w"), fresh.alias("fresh"))
            .select("message", "w.row_id", "w.rank", "w.part", "fresh")
        )

    def _bucket(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.buckets)).cast("int")

    def affected(self, incoming: DataFrame, index: dict[str, list[str]]) -> set[str]:
        """The partitions that hold an identifier of the delivery, by the stored index."""
        if not index:
            return set()
        keys = incoming.where("message is not null").select(F.xxhash64("message").alias("key")).distinct()
        buckets = {str(r[0]) for r in keys.select(self._bucket(F.col("key"))).distinct().collect()}  # at most `buckets`
        entries = self._read([d for b, dirs in index.items() if b in buckets for d in dirs], self.INDEX)
        hit = entries.join(keys, "key", "left_semi").select("part").distinct()
        return {str(r.part) for r in hit.collect()}  # at most one row for each partition

    def deliver(self, incoming: DataFrame) -> list[str]:
        """Merge a delivery; returns the partitions that were rewritten."""
        incoming = incoming.select("message", "row_id", F.col("rank").cast("long").alias("rank"), F.col("part").cast("int").alias("part"))
        for left in range(self.tries - 1, -1, -1):
            try:
                return self._deliver(incoming)
            except StaleLedger:
                if not left:
                    raise
        return []

    def _deliver(self, incoming: DataFrame) -> list[str]:
        seen, state = self._state()
        old, index = state["parts"], state["index"]
        touched = self.affected(incoming, index) & set(old)
        stored = self._read([d for k in touched for d in old[k]], self.SCHEMA)
        rows = stored.withColumn("fresh", F.lit(False)).unionByName(incoming.withColumn("fresh", F.lit(True)))
        version, entries = f"{self.root}/v-{uuid.uuid4().hex}", f"{self.root}/i-{uuid.uuid4().hex}"
        self.single(rows).withColumn("slot", F.col("part")).write.partitionBy("slot").parquet(version)
        made = self._slots(version)
        # index entries of the messages of this delivery, from what was just written
        written = self._read([d for dirs in made.values() for d in dirs], f"{self.SCHEMA}, fresh boolean")
        key = F.xxhash64("message")
        written.where("fresh and message is not null").select(key.alias("key"), "part", self._bucket(key).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(entries)
        parts = {k: v for k, v in old.items() if k not in touched}
        for slot, dirs in made.items():
            # a partition that is not touched keeps its files; new rows are added beside them
            parts[slot] = parts.get(slot, []) + dirs
        indexed = {b: index.get(b, []) + dirs for b, dirs in {**{b: [] for b in index}, **self._slots(entries)}.items()}
        self._commit(seen, {"parts": parts, "index": indexed})
        return sorted(touched | set(made))

    def _slots(self, version: str) -> dict[str, list[str]]:
        return {s.getPath().getName().split("=", 1)[1]: [s.getPath().toString()] for s in self._list(self._fs.Path(version)) if s.isDirectory() and "=" in s.getPath().getName()}


def surplus(rows: DataFrame, batch: str, deliveries: tuple[float, ...] = (0.5, 0.75, 1.0), rows_per_partition: int = 1_000_000, name: str = "ledger") -> DataFrame:
    """Row ids of the copies that do not stay.

    rows: message, row_id, rank and the column `batch` (text ending in a number). The batches
    come in as deliveries, each up to the given share of the batch range; every delivery after
    the first finds the partitions that it affects in the index of the ledger. Rows that are
    no winner in the end are returned. They are told apart by their unique row id (an anti
    join without hot keys), not by the message."""
    spark = rows.sparkSession
    no = F.coalesce(F.regexp_extract(F.col(batch), r"(\d+)\s*$", 1).try_cast("long"), F.lit(0))
    rows = materialise(rows.select("message", "row_id", F.col("rank").cast("long").alias("rank"), no.alias("_no")), f"{name}-rows")
    low, high, n = rows.agg(F.min("_no"), F.max("_no"), F.count("*")).first()
    if low is None:
        return spark.createDataFrame([], "row_id long")
    partitions = max(32, -(-n // rows_per_partition))
    rows = rows.withColumn("part", F.floor((F.col("_no") - F.lit(low)) * partitions / F.lit(high - low + 1)).cast("int"))
    ledger = Ledger(spark, scratch(spark, name))
    begin = 0
    for share in deliveries:
        end = round(partitions * share)
        ledger.deliver(rows.where((F.col("part") >= begin) & (F.col("part") < end)))
        begin = end
    return rows.select("row_id").join(ledger.winners().select("row_id"), "row_id", "left_anti")


def result_rows(results: DataFrame) -> DataFrame:
    """Message = run and task; the earliest created_at stays."""
    key = F.when(F.col("run_id").isNotNull() & F.col("task_id").isNotNull(), F.concat_ws("\u0001", F.col("run_id").cast("string"), clean_identifier(F.col("task_id"))))
    return results.select(key.alias("message"), F.col("result_id").alias("row_id"), instant(F.col("created_at")).alias("rank"), F.col("batch_id").alias("batch_id"))


def model_rows(lines: DataFrame) -> DataFrame:
    """Message = run and task; the first line stays."""
    key = F.when(F.col("run_key").isNotNull() & F.col("task_id").isNotNull(), F.concat_ws("\u0001", F.col("run_key"), clean_identifier(F.col("task_id"))))
    return lines.select(key.alias("message"), F.col("rec_id").alias("row_id"), F.col("rec_id").alias("rank"), F.col("batch_id").alias("batch_id"))


def surplus_copies(results: DataFrame, lines: DataFrame) -> DataFrame:
    """src, row_id of every surplus delivery in both tables."""
    a = surplus(result_rows(results), "batch_id", name="results-ledger")
    b = surplus(model_rows(lines), "batch_id", name="lines-ledger")
    return a.select(F.lit("results").alias("src"), "row_id").unionByName(b.select(F.lit("openai_gpt_5").alias("src"), "row_id"))
