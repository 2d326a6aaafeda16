"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 7).

The merge rules are compiled into a deterministic automaton over token labels: its states
are the last emitted token, and an arc `t` leaves state `s` exactly if the sequence s t is
not changed by any merge. It is built by successive merge gadgets. The gadget of the rule
a b -> c (number k)
  * adds an arc c to every state that has an arc a,
  * gives the new state c the arcs that state b has at that moment, and
  * takes the arc b from state a (a a stays possible only behind c = aa).
Gadgets are kept as tables (left, right, number), so an arc is decided by following the
gadgets that made it, and every arc that was decided once is a table entry from then on.
The bytes of the labels are compiled into one transition table (node, byte -> node). A word
of the pre-splitter is encoded in one forward pass over its bytes: every prefix of a word
has exactly one path through the automaton, so each byte position gets its state - the last
label up to there - from the transitions out of the positions before it, without going
back. Decoding emits the labels of the arcs of a path.

The tables are compiled once on the driver and sent to the workers.

Defined results: null and empty texts give an empty list; strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-splitter of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
#: Words kept in a worker's table; when full, the table is begun anew (results don't change).
TABLE_WORDS = 200_000
#: Likewise arcs that were decided.
TABLE_ARCS = 500_000


class MergeAutomaton:
    def __init__(self, ranked: list[bytes]):
        """ranked: the labels in order of their ids; those of more than one byte are made
        by one merge each, in this order."""
        self.labels = ranked
        self.ids = {b: i for i, b in enumerate(ranked)}
        n = len(ranked)
        self.left, self.right = [-1] * n, [-1] * n
        #: number of the gadget that made a label; -1 for single bytes
        self.made = [-1] * n
        self.rule: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for i, label in enumerate(ranked):
            if len(label) > 1:
                self._gadget(i, label)
        #: node << 8 | byte -> node, and the label that ends at a node
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for i, label in enumerate(ranked):
            if len(label) == 1 or self.made[i] >= 0:
                node = 0
                for c in label:
                    node = self.step.setdefault(node << 8 | c, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = i

    def _gadget(self, c: int, label: bytes) -> None:
        # the rule that makes `label` joins the two tokens that spell it before rule c
        parts = self._path_before(label, c)
        if len(parts) == 2:
            self.left[c], self.right[c], self.made[c] = parts[0], parts[1], c
            self.rule[parts[0], parts[1]] = c

    def _path_before(self, label: bytes, c: int) -> list[int]:
        """Tokens of a label by the rules before c."""
        at = [self.ids[label[k : k + 1]] for k in range(len(label))]
        while len(at) > 1:
            first = min((self.rule.get((a, b), c), k) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
            if first[0] >= c:
                return at
            at[first[1] : first[1] + 2] = [first[0]]
        return at

    def _has_arc(self, s: int, t: int, k: int) -> bool:
        """Does state s have an arc t after the gadgets up to number k?"""
        left, right, made, rule = self.left, self.right, self.made, self.rule
        while True:
            # taken away by a gadget since both exist?
            cut = rule.get((s, t))
            if cut is not None and cut <= k:
                return False
            ms, mt = made[s], made[t]
            if ms < 0 and mt < 0:
                return True
            if s == t:  # the new state's own arc: its copied arcs hold left(t)
                s, t, k = right[s], left[t], ms - 1
            elif mt > ms:  # arc t was added beside arc left(t)
                # a a -> c adds no arc c to state a: its arc a goes in the same gadget
                if left[t] == right[t] == s:
                    return False
                t, k = left[t], mt - 1
            else:  # state s began as a copy of state right(s)
                s, k = right[s], ms - 1

    def arc(self, s: int, t: int) -> bool:
        key = s << 20 | t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > TABLE_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._has_arc(s, t, len(self.labels))
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word: the labels of the one path that spells it."""
        n, step, ends, arc = len(word), self.step, self.ends, self.arc
        state, begun = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            s, node = state[i], 0
            for j in range(i, n):
                node = step.get(node << 8 | word[j], 0)
                if not node:
                    break
                t = ends[node]
                if t >= 0 and state[j + 1] < 0 and (i == 0 or arc(s, t)):
                    state[j + 1], begun[j + 1] = t, i
        path = []
        while n:
            path.append(state[n])
            n = begun[n]
        return path[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.labels[i] for i in ids)


def load(path: str | Path) -> MergeAutomaton:
    """Compile a vocabulary file of ranks (base64 label, id)."""
    with open(path, "rb") as f:
        ranks = sorted((int(i), base64.b64decode(b)) for b, i in (line.split() for line in f if line.strip()))
    return MergeAutomaton([b for _, b in ranks])


def _encode_batches(shipped, split: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: MergeAutomaton = shipped.value
        table: dict[str, list[int]] = {}
        find = regex.compile(split).findall
        for b in batches:
            ids: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                for word in find(text) if text else ():
                    got = table.get(word)
                    if got is None:
                        if len(table) >= TABLE_WORDS:
                            table.clear()
                        got = machine.encode(word.encode("utf-8", "surrogatepass"))
                        if len(word) <= 64:
                            table[word] = got
                    ids += got
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken", normal_form: str | None = None) -> DataFrame:
    """doc_id, ids of every document; one pass without a shuffle. normal_form: a Unicode
    form to bring texts into first (none for this vocabulary)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if normal_form:
        form = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unicodedata.normalize(normal_form, t)), "string")
        texts = texts.withColumn("text", form("text"))
    shipped = documents.sparkSession.sparkContext.broadcast(load(f"{tokenizers}/{vocabulary}"))
    return texts.mapInArrow(_encode_batches(shipped, PATTERN), "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, text from the labels of the arcs."""
    shipped = encoded.sparkSession.sparkContext.broadcast(load(f"{tokenizers}/{vocabulary}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for b in batches:
            texts = [machine.decode(x or []).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
