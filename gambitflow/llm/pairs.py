"""Broken prompt and response pairs (problem 1).

The sentences of the responses and their clauses, with numbers, squares and moves masked,
are clustered by MinHash with verified similarity. A template that recurs across unrelated
prompts, but hardly ever in responses that answer, is a refusal; no list of phrases is
asked. Checks of copy, language and termination label the other defects; languages are told
by profiles learnt from a labelled corpus.

Defined results: a null response or a null record is `empty`; a null prompt has neither a
copy nor a language to compare; the order of the labels is empty, copy, refusal, truncated,
other_language; repeated lines count each. A way of declining that stands with fewer than
PROMPTS prompts in the whole input can't be told from any other sentence and is none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.llm.endings import _ANSWER, answer_of, cut_values, inspected
from gambitflow.llm.languages import MASK, Profiles, learn, plain_profiles
from gambitflow.session import materialise, release

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
#: So many members of a band bucket make a block.
BLOCK = 1000
#: A template is a refusal if it recurs across so many prompts and this share of its responses answers at most.
PROMPTS, ANSWERED = 3, 0.1

_TOKEN = re.compile(r"\w+", re.UNICODE)
_NOTHING = {"", "n/a", "na", "none", "nothing", "unknown", "no answer", "-", "null", "?"}
_SENTENCE = re.compile(r"[^.!?。！？।؟\n]+[.!?。！？।؟]*")
#: Templates up to so many are sent to the workers; more are joined.
BROADCAST_TEMPLATES = 50_000


def body_of(text: str) -> tuple[str, str | None]:
    """The text without its answer lines, and the last answer (None: none given)."""
    kept, answer = [], None
    for line in text.split("\n"):
        if _ANSWER.match(line.strip()) and (got := answer_of(line)) is not None:
            answer = got
        elif (m := re.search(r"(?i)[.!?。！？]\s+\W*final answer\s*[:：]", line)) and (got := answer_of(line[m.start() + 1 :])) is not None:
            answer = got
            kept.append(line[: m.start() + 1])
        elif line.strip().strip("`"):
            kept.append(line)
    return "\n".join(kept), answer


def is_empty(text: str | None) -> bool:
    """Null, blank, only marks, or an answer heading without an answer."""
    if text is None:
        return True
    s = re.sub(r"</?[A-Za-z][^<>]*>|```\w*", " ", text)
    s = re.sub(r"[\W_]+", " ", s).strip().lower()
    return not s or re.fullmatch(r"(?:the )?(?:final )?(?:answer|antwort|réponse|respuesta|ответ|答案|答え)(?: is)?", s) is not None or (s in ("n a", "boxed", "null"))


def is_copy(prompt: str | None, text: str) -> bool:
    """Nothing but the prompt's own wording: a run of it from its beginning, perhaps behind
    an announcement of a few words."""
    if not prompt:
        return False
    p, r = _TOKEN.findall(prompt.casefold()), _TOKEN.findall(text.casefold())
    if len(p) < 5 or len(r) < 5:
        return "".join(p) == "".join(r) != "" or (len(p) < 5 and len("".join(r)) > 8 and "".join(p).startswith("".join(r)))
    # an announcement has a few words, or a small part of a long response
    for lead in range(min(max(8, len(r) // 5) + 1, len(r) - 4)):
        if r[lead : lead + 4] == p[:4]:
            rest = r[lead:]
            n = len(rest)
            if rest == p[:n]:
                return True
            # the last word may be cut, or a few closing words may follow
            same = next((k for k, (a, b) in enumerate(zip(rest, p, strict=False)) if a != b), min(n, len(p)))
            return same >= 8 and (same == n or (same == n - 1 and same < len(p) and p[same].startswith(rest[same])) or (n - same <= 4 and same == len(p)))
    return False


_CLAUSES = re.compile(r"[,;:，、；：]| but | so ")


#: Openings of masked sentences that were cut before; begun anew when full.
_CUT: dict[str, tuple[str, ...]] = {}
TABLE_SENTENCES = 50_000


def _openings_of(sentence: str) -> tuple[str, ...]:
    words = _TOKEN.findall
    whole = " ".join(words(sentence))
    if len(whole) < 4:
        return ()
    parts = _CLAUSES.split(sentence)
    clauses = [" ".join(c) for part in parts if len(c := words(part)) >= 4 or (len(part) >= 6 and not part.isascii())] if len(parts) > 1 else []
    return (whole, *clauses)


def openings(body: str) -> list[str]:
    """The sentences and their clauses, masked, each once."""
    out: dict[str, None] = {}
    for s in _SENTENCE.findall(MASK.sub("0", body.casefold().replace("’", "").replace("'", ""))):
        got = _CUT.get(s)
        if got is None:
            if len(_CUT) >= TABLE_SENTENCES:
                _CUT.clear()
            got = _CUT[s] = _openings_of(s)
        out.update(dict.fromkeys(got))
    return list(out)


ROWS_SCHEMA = "rec_id long, label string, answered boolean, foreign boolean, prompt_key long, openings array<string>"


def _rows(told: Callable[[], Profiles]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = told().language
        asked: dict[str, str | None] = {}
        for b in batches:
            ids, labels, answered, foreign, keys, segs = [], [], [], [], [], []
            for i, prompt, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                label, given, other, seg = "", False, False, []
                if is_empty(text):
                    label = "empty"
                elif is_copy(prompt, text):
                    label = "copy"
                else:
                    body, answer = body_of(text)
                    given = answer is not None and answer.lower() not in _NOTHING
                    seg = openings(body)
                    if prompt and body.strip():
                        if prompt not in asked:
                            if len(asked) >= 10_000:
                                asked.clear()
                            asked[prompt] = language(prompt)
                        a, c = asked[prompt], language(body)
                        other = bool(a and c and a != c)
                for col, v in zip((ids, labels, answered, foreign, keys, segs), (i, label, given, other, zlib.crc32((prompt or "").encode("utf-8", "surrogatepass")), seg), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(answered, pa.bool_()), pa.array(foreign, pa.bool_()), pa.array(keys, pa.int64()), pa.array(segs, pa.list_(pa.string()))],
                ["rec_id", "label", "answered", "foreign", "prompt_key", "openings"],
            )

    return run


#: Sets of fewer shingles are similar enough to equal sets only.
FEW = 4


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(17)
    a = rng.integers(1, 2**61 - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    c = rng.integers(0, 2**61 - 1, BANDS * ROWS, dtype=np.uint64)
    for b in batches:
        texts = b.column(0).to_pylist()
        bands, shingles = [], []
        for t in texts:
            ws = t.split()
            sh = sorted({zlib.crc32(" ".join(ws[k : k + SHINGLE]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(ws) - SHINGLE + 1))})
            if len(sh) < FEW:
                bands.append([])
            else:
                h = np.array(sh, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    low = ((h[:, None] * a[None, :] + c[None, :]) >> np.uint64(16)).min(axis=0)
                bands.append([zlib.crc32(low[k * ROWS : (k + 1) * ROWS].tobytes()) + (k << 32) for k in range(BANDS)])
            shingles.append(sh)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(shingles, pa.list_(pa.int64()))], ["opening", "bands", "shingles"])


def _verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs id, to whose shingles are similar, both ways."""
    sh = signed.select("id", "shingles")
    both = pairs.join(sh, "id").join(sh.select(F.col("id").alias("to"), F.col("shingles").alias("other")), "to")
    common = F.size(F.array_intersect("shingles", "other"))
    links = materialise(both.where(common >= SIMILAR * (F.size("shingles") + F.size("other") - common)).select("id", "to"), "opening-links")
    return links.unionByName(links.select(F.col("to").alias("id"), F.col("id").alias("to")))


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, cluster: the least cluster that the links lead to. Each round takes the least
    cluster of the neighbours and then jumps to the cluster of that cluster's own opening,
    so a chain of n links takes about log n rounds."""
    while True:
        least = links.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("least"))
        new = labels.join(least, "id", "left").select("id", "cluster", F.least("cluster", "least").alias("near"))
        jump = new.select(F.col("id").alias("near"), F.col("near").alias("far"))
        new = materialise(new.join(jump, "near").select("id", F.least("near", "far").alias("cluster"), (F.least("near", "far") < F.col("cluster")).alias("moved")), "opening-labels")
        release(labels)
        labels = new.select("id", "cluster")
        labels._scratch = new._scratch
        if new.where("moved").isEmpty():
            return labels


def _across(slots: DataFrame, labels: DataFrame) -> DataFrame:
    """id, to: every pair of a bucket whose members are in different clusters so far and
    whose numbers of shingles allow the similarity. Large buckets are cut into blocks, and
    each pair of blocks is compared apart."""
    named = slots.join(labels, "id")
    mixed = named.groupBy("band").agg(F.count("*").alias("members"), F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a != b")
    # a bucket's blocks in a row; block x meets block y in the cell (least, greatest)
    blocks = mixed.select("band", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    part = named.join(blocks, "band").withColumn("block", F.pmod("id", F.col("blocks")).cast("int"))
    left = part.select("band", "id", "cluster", "size", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other_block"))
    right = part.select("band", F.col("id").alias("to"), F.col("cluster").alias("to_cluster"), F.col("size").alias("to_size"), F.col("block").alias("other_block"), F.explode(F.sequence(F.lit(0), "block")).alias("block"))
    met = left.join(right, ["band", "block", "other_block"]).where((F.col("block") != F.col("other_block")) | (F.col("id") < F.col("to")))
    close = (F.col("cluster") != F.col("to_cluster")) & (F.col("size") >= SIMILAR * F.col("to_size")) & (F.col("to_size") >= SIMILAR * F.col("size"))
    return met.where(close).select(F.least("id", "to").alias("id"), F.greatest("id", "to").alias("to")).distinct()


def clusters(texts: DataFrame) -> DataFrame:
    """opening, cluster: distinct openings by verified similarity of their word shingles.

    Openings of the same shingles are one node. The clusters are the connected components of
    all similar pairs that share a band bucket; sets of fewer than FEW shingles are similar
    to equal ones only, so they need no buckets. First a node is compared with the first one
    of its bucket and its neighbour in order, which joins most of them; then with every
    member of its buckets that is still in another cluster, so that no link between clusters
    is missed. Components are found by label propagation with jumps."""
    signed = materialise(texts.select("opening").mapInArrow(_signatures, "opening string, bands array<long>, shingles array<long>").withColumn("id", F.xxhash64("shingles")), "openings")
    # most buckets have one member, which nothing is compared with
    slots = signed.select("id", F.size("shingles").alias("size"), F.explode("bands").alias("band"))
    crowded = slots.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("band")
    slots = materialise(slots.join(crowded, "band", "left_semi").distinct(), "opening-slots")
    met = slots.select("id").distinct()
    nodes = materialise(signed.select("id", "shingles").join(met, "id", "left_semi").dropDuplicates(["id"]), "opening-nodes")
    order = Window.partitionBy("band").orderBy("id")
    near = slots.select("id", F.first("id").over(order).alias("a"), F.lag("id").over(order).alias("b"))
    links = _verified(near.select("id", F.explode(F.array("a", "b")).alias("to")).where("to is not null and to != id").distinct(), nodes)
    labels = _spread(materialise(nodes.select("id", F.col("id").alias("cluster")), "opening-labels"), links)
    more = _verified(_across(slots, labels), nodes)
    if not more.isEmpty():
        labels = _spread(labels, links.unionByName(more))
    return signed.select("opening", "id").join(labels, "id", "left").select("opening", F.coalesce("cluster", "id").alias("cluster"))


def refusal_templates(rows: DataFrame) -> DataFrame:
    """opening: hashes of the members of template clusters that recur across unrelated
    prompts and hardly ever come with an answer."""
    used = rows.where("label = '' and not foreign").select("prompt_key", "answered", F.explode("openings").alias("text")).withColumn("opening", F.xxhash64("text"))
    # one row per opening and prompt: a template that fills a third of the rows combines early
    per = materialise(used.groupBy("opening", "prompt_key").agg(F.count("*").alias("n"), F.count_if("answered").alias("good")), "opening-prompts")
    texts = used.groupBy("opening").agg(F.first("text").alias("text"))
    named = clusters(texts.select(F.col("text").alias("opening"))).select(F.xxhash64("opening").alias("opening"), "cluster")
    counted = materialise(per.join(named, "opening"), "cluster-prompts")
    quiet = counted.groupBy("cluster", "prompt_key").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).groupBy("cluster").agg(F.count("*").alias("prompts"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    quiet = quiet.where((F.col("good") <= ANSWERED * F.col("n")) & (F.col("prompts") >= PROMPTS))
    return named.join(quiet.select("cluster"), "cluster", "left_semi").select("opening")


_PLAIN: list[Profiles] = []


def language(text: str) -> str | None:
    """The language of most of a text by the plain profiles; None if nothing tells."""
    if not _PLAIN:
        _PLAIN.append(plain_profiles())
    return _PLAIN[0].language(text)


def defects(lines: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """rec_id, defect of every defective pair. labelled: doc_id, text, lang of a corpus that
    teaches the languages; without it only a few small words of four languages tell them."""
    shipped = lines.sparkSession.sparkContext.broadcast(learn(labelled) if labelled is not None else plain_profiles())
    rows = lines.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("inference.prompt").alias("prompt"), F.col("inference.response").alias("response"))
    rows = materialise(rows.mapInArrow(_rows(lambda: shipped.value), ROWS_SCHEMA), "pairs")
    cut = cut_values(materialise(inspected(lines, ("response",)), "endings")).select("rec_id").withColumn("cut", F.lit(True))
    templates = materialise(refusal_templates(rows.join(cut, "rec_id", "left_anti")), "templates")
    if templates.count() <= BROADCAST_TEMPLATES:
        templates = F.broadcast(templates)
    open_rows = rows.where("label = '' and not answered")
    refused = open_rows.select("rec_id", F.explode(F.transform("openings", lambda t: F.xxhash64(t))).alias("opening")).join(templates, "opening", "left_semi").select("rec_id").distinct().withColumn("refused", F.lit(True))
    label = (
        F.when(F.col("label") != "", F.col("label"))
        .when(F.col("refused") & F.col("cut").isNull(), F.lit("refusal"))
        .when(F.col("cut"), F.lit("truncated"))
        .when(F.col("foreign"), F.lit("other_language"))
    )
    return rows.select("rec_id", "label", "foreign").join(cut, "rec_id", "left").join(refused, "rec_id", "left").select("rec_id", label.alias("defect")).where("defect is not null")
