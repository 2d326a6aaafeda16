"""Evaluation texts that leak into training text (problem 8).

The normalised own wording of the test items is compiled into one generalised suffix
automaton. Documents stream through it word by word; the automaton tracks the longest
match that ends at each word. Wherever a run of at least SEED words of any item ends -
whether it is the longest match there or a shorter one that the longest match hides - it
is extended to both sides with at most one word in seven replaced, misspelt or added. A
span of at least SPAN item words that begins and ends with a matched word is a leak.

No leak is missed: a longer span with one error in seven holds a part of SPAN to 2 * SPAN
words that keeps this limit by itself, so MOST_ERRORS errors are enough; and such a part
holds an exact run of SEED words.

Sentences that several items share are nobody's own; they part the wording of an item.

Defined results: null or blank texts of either side give no row; an item whose own wording
has fewer than SPAN words in a row cannot leak; equal items leak together; repeated document
ids give one row for each item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gambitflow.llm.sentences import Splitter

SPAN, PER_ERROR, SEED, MOST_ERRORS = 12, 7, 4, 3
#: Words of items compiled into one automaton, about 200 bytes each in a worker; more items
#: are matched in further passes over the documents.
BLOCK_WORDS = 500_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_WORDS = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and where each lies in the text (characters from 0, end exclusive).
    Case, punctuation, mark-up, invisible characters and the kind of white space don't count."""
    hidden = _HIDDEN.search(text) is not None
    if hidden:
        kept = [k for k, c in enumerate(text) if not _HIDDEN.match(c)]
        plain = "".join(text[k] for k in kept)
    else:
        kept, plain = None, text
    if "<" in plain:
        plain = _TAG.sub(lambda m: " " * len(m.group()), plain)
    if "&" in plain:
        plain = re.sub(r"&#?\w{1,8};", lambda m: html.unescape(m.group())[:1].ljust(len(m.group())) if html.unescape(m.group()) != m.group() else m.group(), plain)
    out, at = [], []
    for m in _WORDS.finditer(plain):
        w = m.group()
        if not w.isascii():
            w = unicodedata.normalize("NFKC", w)
        w = w.casefold().replace("’", "'").replace("ʼ", "'")
        a, b = m.span()
        out.append(w)
        at.append((kept[a], kept[b - 1] + 1) if kept else (a, b))
    return out, at


class SuffixAutomaton:
    """Of word sequences, in flat tables: one arc table for all states, numbers in arrays.

    A state stands for the runs of words that end at the same places. `top` is the first
    state up its suffix links whose runs have at least SEED words: its places are all those
    where the last SEED words of a match stand."""

    def __init__(self, flat: array, vocabulary: int):
        """flat: the sequences one behind the other, each with a -2 at its end."""
        self.width = vocabulary + 1
        self.go: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        first, arc_word, arc_next = array("i", [-1]), array("i"), array("i")
        self._build = (first, arc_word, arc_next)
        self.place, self.place_next = array("i", [-1]), array("i", [-1]) * len(flat)
        last = 0
        for k, w in enumerate(flat):
            if w < 0:
                last = 0
                continue
            last = self._extend(last, w)
            self.place_next[k] = self.place[last]
            self.place[last] = k
        del self._build
        n = len(self.link)
        self.child, self.sibling = array("i", [-1]) * n, array("i", [-1]) * n
        self.count, self.top = array("i", bytes(4 * n)), array("i", range(n))
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            up = self.link[s]
            self.sibling[s] = self.child[up]
            self.child[up] = s
            if self.length[up] >= SEED:
                self.top[s] = self.top[up]
        for s in reversed(order):
            k = self.place[s]
            while k >= 0:
                self.count[s] += 1
                k = self.place_next[k]
            self.count[self.link[s]] += self.count[s]

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.place.append(-1)
        self._build[0].append(-1)
        return len(self.link) - 1

    def _arc(self, s: int, w: int, to: int) -> None:
        first, word, nxt = self._build
        self.go[s * self.width + w] = to
        word.append(w)
        nxt.append(first[s])
        first[s] = len(word) - 1

    def _divide(self, p: int, w: int, q: int) -> int:
        """Part state q from its longer runs; the new state has the arcs of q."""
        new = self._state(self.length[p] + 1, self.link[q])
        first, word, nxt = self._build
        arc = first[q]
        while arc >= 0:
            self._arc(new, word[arc], self.go[q * self.width + word[arc]])
            arc = nxt[arc]
        self.link[q] = new
        while p >= 0 and self.go.get(p * self.width + w) == q:
            self.go[p * self.width + w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        go, width = self.go, self.width
        q = go.get(last * width + w)
        if q is not None:  # the sequence so far is known already
            return q if self.length[q] == self.length[last] + 1 else self._divide(last, w, q)
        cur = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and p * width + w not in go:
            self._arc(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = go[p * width + w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._divide(p, w, q)
        return cur

    def places(self, state: int) -> Iterator[int]:
        """Position of the last word of every occurrence of a state's runs."""
        stack = [state]
        while stack:
            s = stack.pop()
            k = self.place[s]
            while k >= 0:
                yield k
                k = self.place_next[k]
            s = self.child[s]
            while s >= 0:
                stack.append(s)
                s = self.sibling[s]

    def runs(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """(k, state): the last SEED words up to text[k] stand at the places of `state`, and
        some of these go on otherwise than the text. Places that all go on alike are left
        for the next word, so a text that follows one item costs a look-up a word."""
        go, width, link, length, top, count = self.go, self.width, self.link, self.length, self.top, self.count
        state = n = 0
        for k, w in enumerate(text):
            if w < 0:
                state = n = 0
                continue
            to = go.get(state * width + w)
            while to is None and state:
                # a shorter run may go on at other places
                state = link[state]
                n = length[state]
                to = go.get(state * width + w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= SEED:
                t = top[state]
                nxt = text[k + 1] if k + 1 < len(text) else -1
                on = go.get(t * width + nxt) if nxt >= 0 else None
                if on is None or count[on] < count[t]:
                    yield k, t


def _reach(flat: array, text: list[int], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """(item words, text words) beyond (i, j) in one direction, at most, with up to 0, 1, ..
    errors; the last word of each is a matched one. Replaced words count as item words."""
    best = [(0, 0)] * (MOST_ERRORS + 1)
    stack, seen = [(i, j, 0)], set()
    while stack:
        a, b, e = stack.pop()
        begun = a
        while 0 <= a < len(flat) and 0 <= b < len(text) and flat[a] == text[b]:
            a, b = a + step, b + step
        if (a, b, e) in seen:
            continue
        seen.add((a, b, e))
        if a != begun:
            best[e] = max(best[e], ((a - i) * step, (b - j) * step))
        if e < MOST_ERRORS and 0 <= b < len(text):
            if 0 <= a < len(flat) and flat[a] >= 0:
                stack.append((a + step, b + step, e + 1))
            stack.append((a, b + step, e + 1))
    for e in range(1, len(best)):  # an error less is allowed too
        best[e] = max(best[e], best[e - 1])
    return best


class LeakFinder:
    def __init__(self, items: list[tuple[int, list[str]]]):
        """items: (item_id, words of one stretch of its own wording)."""
        self.vocabulary: dict[str, int] = {}
        self.flat, self.owner, self.starts = array("i"), array("q"), array("i")
        for i, ws in items:
            self.owner.append(i)
            self.starts.append(len(self.flat))
            self.flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws)
            self.flat.append(-2)
        self.automaton = SuffixAutomaton(self.flat, len(self.vocabulary))

    def spans(self, text: str | None, every: bool = True) -> dict[int, list[tuple[int, int]]]:
        """item_id -> the characters of its leaked spans; only the first one without `every`."""
        if not text:
            return {}
        ws, at = words(text)
        if len(ws) < SPAN:
            return {}
        known, flat = self.vocabulary, self.flat
        seq = [known.get(w, -1) for w in ws]
        found: dict[int, list[tuple[int, int]]] = {}
        for k, state in self.automaton.runs(seq):
            nxt = seq[k + 1] if k + 1 < len(seq) else -1
            for p in self.automaton.places(state):
                if flat[p + 1] == nxt:
                    continue  # this run goes on
                owner = self.owner[bisect_right(self.starts, p) - 1]
                if not every and owner in found:
                    continue
                span = self._span(seq, p, k)
                if span:
                    found.setdefault(owner, []).append((at[span[0]][0], at[span[1]][1]))
        return found

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item_id -> the characters of its first leaked span."""
        return {i: s[0] for i, s in self.spans(text, every=False).items()}

    def _span(self, seq: list[int], p: int, k: int) -> tuple[int, int] | None:
        """First and last word of the span around the run that ends at item word p and text
        word k, if it is a leak."""
        left = _reach(self.flat, seq, p - SEED, k - SEED, -1)
        right = _reach(self.flat, seq, p + 1, k + 1, 1)
        best = None
        for x, (n, a) in enumerate(left):
            for y, (m, b) in enumerate(right):
                if n + m + SEED >= max(SPAN, PER_ERROR * (x + y)) and (best is None or n + m > best[0]):
                    best = (n + m, k - SEED + 1 - a, k + b)
        return best[1:] if best else None


def own_wording(items: DataFrame) -> DataFrame:
    """item_id, words: stretches of an item's wording between sentences shared with others."""
    cut = Splitter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, ws = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for no, (x, y) in enumerate(cut.units(text)):
                    got = words(text[x:y])[0]
                    if got:
                        ids.append(i)
                        nos.append(no)
                        ws.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(ws, pa.list_(pa.string()))], ["item_id", "no", "words"])

    units = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, no int, words array<string>")
    shared = units.groupBy("words").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a != b").select("words", F.lit(True).alias("shared"))
    return units.join(shared, "words", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce("shared", F.lit(False)).alias("shared"), "words"))).alias("units"))


def _stretches(units) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for u in units:
        if u["shared"]:
            out.append([])
        else:
            out[-1].extend(u["words"])
    return [x for x in out if len(x) >= SPAN]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Stretches in blocks of bounded size; the driver holds one block at a time."""
    block, n = [], 0
    for r in own_wording(items).toLocalIterator():
        for ws in _stretches(r.units):
            if n and n + len(ws) > BLOCK_WORDS:
                yield block
                block, n = [], 0
            block.append((r.item_id, ws))
            n += len(ws)
    if block:
        yield block


def _matched(documents: DataFrame, items: DataFrame, every: bool) -> DataFrame:
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, start_at long, end_at long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    out = spark.createDataFrame([], schema)
    for block in _blocks(items):
        # compiled once; a worker process loads the tables once for all its tasks
        shipped = spark.sparkContext.broadcast(LeakFinder(block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            finder = shipped.value
            for b in batches:
                cols: tuple[list, ...] = ([], [], [], [])
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for item, spans in sorted(finder.spans(text, every).items()):
                        for x, y in spans:
                            for c, v in zip(cols, (i, item, x, y), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_at", "end_at"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_at, end_at (characters from 0, end exclusive): every leaked span
    of each document and item; spans that lie inside another one of theirs are left out."""
    inside = F.exists("s", lambda y: (y["start_at"] <= F.col("x.start_at")) & (y["end_at"] >= F.col("x.end_at")) & (y != F.col("x")))
    spans = _matched(documents, items, True).groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("start_at", "end_at")).alias("s"))
    return spans.select("doc_id", "item_id", "s", F.explode("s").alias("x")).where(~inside).select("doc_id", "item_id", "x.*")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id; an item belongs to one block or several, so pairs are made distinct."""
    return _matched(documents, items, False).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, most: float = 0.5) -> DataFrame:
    """doc_id, text, removed of the documents that leak: the leaked spans are cut out; a
    document of which they cover more than the share `most` is removed whole (text null)."""
    spans = _matched(documents, items, True).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_at", "end_at"))).alias("s")).withColumnRenamed("doc_id", "_leaky")
    # walk along the sorted spans: what is kept so far, and up to where the text is told
    rest = lambda acc, x: F.when(x["start_at"] > acc["to"], F.concat(acc["kept"], F.substr(F.col("text"), acc["to"].cast("int") + 1, (x["start_at"] - acc["to"]).cast("int")))).otherwise(acc["kept"])
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("to"))
    walk = F.aggregate("s", begin, lambda acc, x: F.struct(rest(acc, x).alias("kept"), F.greatest(acc["to"], x["end_at"]).alias("to")), lambda acc: F.concat(acc["kept"], F.substr(F.col("text"), acc["to"].cast("int") + 1)))
    cut = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(spans, F.col("doc_id") == F.col("_leaky")).select("doc_id", F.length("text").alias("whole"), walk.alias("kept"))
    share = 1 - F.length("kept") / F.col("whole")
    return cut.select("doc_id", F.when(share <= most, F.col("kept")).alias("text"), F.round(share, 6).alias("removed"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, documents: how many documents leak each item; items without a leak have 0."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n"))
    every = items.select(F.col("item_id").cast("long").alias("item_id")).distinct()
    return every.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0).cast(T.LongType())).alias("documents"))
