"""Which language a text is in, by profiles learnt from labelled texts.

Scripts of one language tell it themselves. For scripts that languages share, the words and
word endings of a labelled corpus are counted by label, and a feature weighs as much as it
tells the labels apart. Labels may be noisy: a wrong one only flattens the weights.

The profiles are fitted on at most `sample` texts of each label, chosen by a hash of the id,
and hold at most `words` words and `endings` endings of each label, so they are small enough
for every worker; the texts to be told are never sampled.

Defined results: null, blank and unlabelled texts teach nothing; a text in which nothing
tells has no language (None); a text of words that no profile knows is in an unknown
language ("und"); ties between two languages give no vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.session import materialise

#: Scripts and the language that is told by them; the first that fits counts.
SCRIPTS = (("ja", "぀", "ヿ"), ("ko", "가", "힣"), ("th", "฀", "๿"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("el", "Ͱ", "Ͽ"), ("ru", "Ѐ", "ӿ"), ("he", "֐", "׿"), ("zh", "一", "鿿"))
_FOREIGN = re.compile(f"[{''.join(f'{a}-{b}' for _, a, b in SCRIPTS)}]")
_SENTENCE = re.compile(r"[^.!?。！？।؟\n]+[.!?。！？।؟]*")
_TAKEN = re.compile(r"[^\W\d_]{2,}(?:['’](?=\w))?|[^\W\d_]['’](?=\w)")
#: Moves, squares and numbers in small letters.
MASK = re.compile(r"(?<![a-z])(?:[a-z]{0,4}\d[a-z0-9]*(?:=[qrbn])?[+#]?(?:[.,]\d+)*|o-o(?:-o)?)")
_FEN = re.compile(r"(?:[pnbrqkPNBRQK1-8]{1,8}/){3,7}[pnbrqkPNBRQK1-8]{1,8}(?: [wb] \S+ \S+ \d+ \d+)?")
#: A sentence votes if its best language leads by so much; a text is in an unknown language
#: if so many words are seen and at most this share is known, or no sentence votes.
MARGIN, UNKNOWN_WORDS, UNKNOWN_SHARE = 0.6, 16, 0.15

#: Sentences whose result is kept; when full, the table is begun anew (results don't change).
TABLE_SENTENCES = 50_000

# fixed values, asked only for words that the labelled corpus does not hold: frequent small words, none of two languages
_SMALL = {
    "en": "the of and to is that it was for on with as by this are be at from or which has had have but its his her they he she would before after while because only what how does without who than then there when you both near any even our into out over since until".split(),
    "de": "der die das und ist nicht von zu den dem des ein eine einen mit auf für im auch als nach wie bei aus wird er sie diesem dieser hat aber noch nur oder um vor durch werden sind sich so dass mir ich war was kann darf".split(),
    "fr": "le la les du et est une dans pour qui pas sur au aux avec ce cette il elle par plus ne se ses sans après ou mais leur je nous vous quel faut été fait depuis ait peux".split(),
    "es": "el los las del y una para por con su al lo como más pero sin sobre esta ha fue tras entre desde qué si ya muy sus casi mi puedo debo".split(),
}


class Profiles:
    """word -> weight by language, ending -> weight by language."""

    def __init__(self, names: list[str], words: dict[str, tuple], endings: dict[str, tuple]):
        self.names, self.words, self.endings = names, words, endings
        self._kept: dict[str, tuple] = {}
        self._told: dict[str, tuple[str, int, int, int]] = {}

    def __reduce__(self):
        return Profiles, (self.names, self.words, self.endings)

    def _learn(self, fresh: set[str]) -> None:
        """Enter the weights of further words; empty if neither a word nor its ending is known."""
        kept = self._kept
        if len(kept) >= 200_000:  # a table that is begun anew when full
            kept.clear()
        for w in fresh:
            kept[w] = self.words.get(w) or (self.endings.get(w[-3:]) if len(w) > 3 else None) or ()

    def _sentence(self, s: str) -> tuple[str, int, int, int]:
        """(language or '', letters, different words, words known) of a masked sentence."""
        if not s.isascii() and _FOREIGN.search(s):
            letters = [c for c in s if c.isalpha()]
            for code, a, b in SCRIPTS:
                n = sum(a <= c <= b for c in letters)
                if n and (code == "ja" or n * 3 > len(letters)):
                    return code, len(letters) * (3 if code in ("ja", "zh", "ko") else 1), 0, 0
        words = _TAKEN.findall(s)
        distinct = set(words)
        if not distinct <= self._kept.keys():
            self._learn(distinct)
        got = [x for x in map(self._kept.__getitem__, words) if x]
        told = ""
        if got:
            score = list(map(sum, zip(*got, strict=True)))
            best, second = sorted(score, reverse=True)[:2] if len(score) > 1 else (score[0], 0.0)
            if best >= MARGIN and best - second >= MARGIN:
                told = self.names[score.index(best)]
        return told, sum(map(len, words)), len(distinct), len(self.words.keys() & distinct)

    def votes(self, text: str) -> Counter[str]:
        """How many letters of the text tell for which language."""
        votes: Counter[str] = Counter()
        seen = known = 0
        if "/" in text:
            text = _FEN.sub(" ", text)
        told = self._told
        for s in _SENTENCE.findall(MASK.sub("0", text.casefold())):
            got = told.get(s)
            if got is None:
                if len(told) >= TABLE_SENTENCES:
                    told.clear()
                got = told[s] = self._sentence(s)
            if got[0]:
                votes[got[0]] += got[1]
            seen += got[2]
            known += got[3]
        if seen >= UNKNOWN_WORDS and (known <= UNKNOWN_SHARE * seen or not votes) and not any(c for c, _, _ in SCRIPTS if votes[c]):
            return Counter({"und": seen})
        return votes

    def language(self, text: str) -> str | None:
        votes = self.votes(text)
        return max(votes.items(), key=lambda x: (x[1], x[0]))[0] if votes else None


def plain_profiles() -> Profiles:
    """Of the small words alone, where no labelled corpus is at hand."""
    names = list(_SMALL)
    words = {w: tuple(2.0 if n == m else 0.0 for m in names) for n in names for w in _SMALL[n]}
    p = Profiles(names, words, {})
    return p


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", sample: int = 400, words: int = 6000, endings: int = 1500, least: int = 4) -> Profiles:
    """Profiles of the languages of a labelled corpus that are written in Latin letters.

    label: codes such as `de`, `DE` or `de-x-part`; only the first part counts. A label with
    fewer than `least` texts is left out."""
    code = F.lower(F.split(F.trim(F.col(label).cast("string")), "[-_]")[0])
    rows = labelled.select(code.alias("code"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(id_col)).alias("h")).where("length(code) > 0 and length(trim(t)) > 0")
    few = materialise(rows.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "t"))).where(F.col("k") <= sample), "labelled-texts")
    found = few.select("code", "h", F.explode(F.regexp_extract_all(F.regexp_replace(F.lower("t"), r"\S*\d\S*", " "), F.lit(r"[\p{IsLatin}]{2,}['’]?"), 0)).alias("w"))
    feature = F.explode(F.array(F.struct(F.lit("w").alias("kind"), F.col("w").alias("f")), F.struct(F.lit("e").alias("kind"), F.when(F.length("w") > 3, F.substring("w", -3, 3)).alias("f"))))
    counts = found.select("code", "h", feature.alias("x")).where("x.f is not null").groupBy("code", "x.kind", "x.f").agg(F.count("*").alias("n"), F.count_distinct("h").alias("texts")).where("texts > 1")
    most = F.when(F.col("kind") == "w", words).otherwise(endings)
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("code", "kind").orderBy(F.col("n").desc(), "f"))).where(F.col("r") <= most)
    got = top.select("code", "kind", "f", "n").collect()  # at most (words + endings) rows a label
    texts = {r["code"]: r["k"] for r in few.groupBy("code").agg(F.max("k").alias("k")).collect()}
    total: Counter[str] = Counter()
    for r in got:
        total[r["code"], r["kind"]] += r["n"]
    # a label whose texts hold few Latin words is told by its script
    heavy = max((total[c, "w"] / texts[c] for c in texts), default=0)
    names = sorted(c for c in texts if texts[c] >= least and total[c, "w"] / texts[c] >= 0.25 * heavy and c not in {s for s, _, _ in SCRIPTS})
    if len(names) < 2:
        return plain_profiles()
    share: dict[tuple[str, str], dict[str, float]] = {}
    for r in got:
        if r["code"] in names:
            share.setdefault((r["kind"], r["f"]), {})[r["code"]] = r["n"] / total[r["code"], r["kind"]]
    tables: dict[str, dict[str, tuple]] = {"w": {}, "e": {}}
    for (kind, f), by in share.items():
        whole = sum(by.values())
        even = 1 / len(names)
        weights = tuple((1.0 if kind == "w" else 0.5) * math.log((by.get(c, 0) / whole + 0.05) / (even + 0.05)) for c in names)
        # what all languages share tells nothing
        tables[kind][f] = tuple(round(x, 4) for x in weights)
    for c in set(names) & set(_SMALL):
        for w in _SMALL[c]:
            tables["w"].setdefault(w, tuple(2.0 if n == c else 0.0 for n in names))
    return Profiles(names, tables["w"], tables["e"])
