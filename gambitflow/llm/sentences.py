"""Sentence units of documents in many languages and scripts (problem 9).

Document-centred disambiguation. Whether a word with a full stop is an abbreviation, and
what kind of word follows it, is decided from unambiguous occurrences:

1. in the same document: the word with a stop before a small letter or a comma; the next
   word as a capitalised word behind a small one (a proper name), or as the first word of a
   paragraph or behind a question or exclamation mark (a word that begins sentences);
2. where the document is silent, in the whole corpus, by the same counts;
3. only where both are silent, by a list of well-known abbreviations.

The same order decides whether a number with a stop before a move is a move number, and
whether one before a capitalised word is an ordinal. Terminators, quotes and white space
follow the script.

Defined results: null and blank texts give no unit; positions count Unicode characters from
0; every character that is no white space around a unit belongs to exactly one unit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gambitflow.session import materialise

# fixed values, asked only where neither the document nor the corpus knows the word:
# abbreviations before a name or number (never end a sentence) ...
BEFORE_NAME = frozenset("mr mrs ms dr prof st capt col gen lt sgt rev hon jr sr vs cf fig figs vol vols no nos pp p ch sec ed eds m mm mme mlle hr fr frl nr bd vgl bzw sog abb kap str art pág págs sra dra srta núm lic см стр рис гл им проф акад тов κ κα кн ул д डॉ श्री د أ".split())
# ... and those that may end one, before a capital that begins the next
WITHIN = frozenset("etc e.g i.e p.m a.m approx ca b d usw z.b d.h u.a z.t o.ä aprox p.ej p.ex c.-à-d ej ex h env т.е т.д т.п т.к д е п г в гг δηλ μ.μ π.μ κ.λπ κλπ π.χ inc ltd co corp".split())
#: ... those of these that go on before any word, and those that a name does not follow
_GOES_ON = frozenset("e.g i.e approx aprox b z.b d.h h ej ex p.ej p.ex т.е е δηλ".split())
_NO_NAME = frozenset("p.m a.m μ.μ π.μ etc usw т.д т.п".split())
#: Likewise nouns before a plain number that is no move number ...
_COUNTED = frozenset("move moves record records round rounds part parts game games hall page table board zug partie runde runden coup ronde jugada partida ronda ход ходу туру партии партия γύρου γύρος".split())
#: ... and words before an ordinal with a stop.
_ORDINAL = frozenset("am der die das den dem des im vom zum zur beim bis ab seit jeder jede jedes".split())

_SAN = r"(?:O-O(?:-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)"
_MOVE_END = re.compile(rf"(?:^|[\s(.…]){_SAN}[+#]?$")
_MOVE_NEXT = re.compile(rf"(?:\.\.\.)?{_SAN}[+#]?[!?]{{0,2}}(?=[\s,;:.)\]]|$)")
_STOP = re.compile(r"[.!?…。！？｡।॥؟۔;;]+|[“”„«»「」『』\"‟()（）\[\]]")
_STOP_OR_SPACE = re.compile(_STOP.pattern + r"|\s+")
_OPEN = {"„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "“": "”"}
_PAIRS = set("".join(_OPEN)) | set("".join(_OPEN.values())) | {'"', "‟"}
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_ITEM = re.compile(r"(\d{1,3})[.)][^\S\n]+(?=\S)")
_BULLET = re.compile(r"[-*•‣▪][^\S\n]+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+(?:[.'’-][^\W\d_]+)*", re.UNICODE)
_CLOSERS = "\"'”’»）)]」』】"
_DASH = "—–-"


def _thai(c: str) -> bool:
    return "฀" <= c <= "໿" or "ក" <= c <= "៿"


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0003ffff"


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


#: Invisible characters inside words.
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060]")


def _before(text: str, low: int, at: int) -> str:
    """The word that ends at `at`, with the stops and hyphens inside it (as in e.g or c.-à-d);
    a part after a space counts too where it is one letter (z. B)."""
    k = text.rfind(" ", low, at) + 1
    word = text[max(k, low) : at]
    if word.isascii() and word.isalpha():
        return word  # the usual case
    k = at
    if at > low and text[at - 1].isdigit():
        number = re.search(r"(?:[A-Za-z]*\d[\d.,]*)$", text[max(low, at - 24) : at])
        return number.group() if number else ""
    while k > low and (text[k - 1].isalnum() or text[k - 1] in ".-'’\u00ad\u200b\u200c\u200d\u2060" or "̀" <= text[k - 1] <= "ͯ" or "ऀ" <= text[k - 1] <= "ॣ"):
        k -= 1
    word = text[k:at].lstrip(".-'’")
    return word if word.isascii() else _UNSEEN.sub("", word)


#: A stop behind a letter, or behind a mark on one, and what follows.
_STOPPED = re.compile("\\.(?<=[^\\W\\d_].|[\u0300-\u036f\u0900-\u0963].)(?=(?:\\s+|(?=[,;:)]))([,;:)]|\\w+))")
#: Any stop behind a letter, or behind a mark on one.
_ANY_STOP = re.compile("\\.(?<=[^\\W\\d_].|[\u0300-\u036f\u0900-\u0963].)")
#: The longest word that is counted, and the longest without stops in it that may be an
#: abbreviation before a capital.
_LONGEST, _PLAIN = 8, 6
_CAPITAL = re.compile(r" (?<=[a-zà-öø-ÿа-яёα-ωά-ώ] )((?=[^\W\d_a-z])[^\W\d_]{3,}+(?:[.'’-][^\W\d_]+)*)")
#: Abbreviations that close an enumeration.
_CLOSING = re.compile(r"(?:^|\W)(?:т\.\s?[дп]|и др|usw|etc)$", re.IGNORECASE)
_THAI = re.compile("[\u0e00-\u0eff\u1780-\u17ff]")


#: The first word of a paragraph, or of a sentence behind a mark that ends one for certain.
_BEGINNING = re.compile(r"(?:\A|\n[^\S\n]*\n|[!?؟。！？।](?=[\s\"“«„¿¡—]))[\s\"“”«„¿¡—(]*+([^\W\d_]++)")
#: A number behind a word; whether it has a stop and a move behind it.
_BEHIND_WORD = re.compile(rf"[^\S\n]\d{{1,3}}(?![\d.,]*\d)(\.\s+(?:\.\.\.)?{_SAN}(?![^\W_]))?")
#: A number of one or two digits with a stop before a capitalised word.
_ORDINAL_LIKE = re.compile(r"\.(?<=\d\.)(?<![\d.,]\d\d\.)(?<![.,]\d\.)\s+([^\W\d_a-z][^\W\d_]++)(?![1-8])")
#: A word without a stop behind it.
_PLAIN_WORD = re.compile(r"[^\W\d_]++(?![.\d])")

# what the corpus tells of a stopped word ...
KNOWN, ABBREVIATION, TITLE, NAMED, NUMBERED = 1, 2, 4, 8, 16
# ... and of the word behind it, or of a noun before numbers
NAME, BEGINS, ORDINAL, INSIDE, COUNTED = 1, 2, 4, 8, 1


class Evidence:
    """What a document tells without ambiguity, worked out when it is first asked."""

    def __init__(self, text: str):
        self.text = text
        self._small = ""
        self._names: set[str] | None = None
        self._begins: set[str] | None = None
        self._stops: dict[str, list[int]] | None = None
        self._counted: dict[str, list[int]] | None = None

    @property
    def names(self) -> set[str]:
        """Capitalised words behind a small word that never occur in small letters."""
        if self._names is None:
            found = {w for w in _CAPITAL.findall(self.text) if w[0].isupper()}
            self._names = {w for w in found if w.lower() not in self.text or not re.search(rf"\b{re.escape(w.lower())}\b", self.text)}
        return self._names

    @property
    def begins(self) -> set[str]:
        """Words that begin a sentence for certain."""
        if self._begins is None:
            self._begins = set(_BEGINNING.findall(self.text))
        return self._begins

    def repeats(self, low: str) -> bool:
        """Does a word stand before a stop twice or more? Without that there is no evidence."""
        if not self._small:
            self._small = self.text.lower()
        return self._small.count(low + ".") > 1

    @property
    def counted(self) -> dict[str, list[int]]:
        """noun -> [before a number without a move behind it, before one with it]"""
        if self._counted is None:
            out: dict[str, list[int]] = {}
            for m in _BEHIND_WORD.finditer(self.text):
                end = m.start()
                while end and self.text[end - 1] in " \t\u00a0\u3000":
                    end -= 1
                k = end
                while k and self.text[k - 1].isalpha():
                    k -= 1
                if k < end:
                    out.setdefault(self.text[k:end].lower(), [0, 0])[m.group(1) is not None] += 1
            self._counted = out
        return self._counted

    def stopped(self) -> Iterator[tuple[str, str]]:
        """(word in small letters, what follows its stop)"""
        for m in _STOPPED.finditer(self.text):
            word = _before(self.text, 0, m.start()).lower()
            if word and len(word) <= _LONGEST and not _MOVE_NEXT.match(self.text, m.start(1)):
                yield word, m.group(1)

    @property
    def stops(self) -> dict[str, list[int]]:
        """word -> [with stop before a small letter or comma, with stop before a capital, of
        these before a proper name]"""
        if self._stops is None:
            stops: dict[str, list[int]] = {}
            for word, rest in self.stopped():
                n = stops.setdefault(word, [0, 0, 0])
                if rest[0].islower() or rest[0] in ",;:)":
                    n[0] += 1
                else:
                    n[1] += 1
                    n[2] += rest in self.names
            self._stops = stops
        return self._stops


class Splitter:
    """corpus: what the statistics of the whole corpus tell, key -> flags. Keys are "w" and
    a stopped word, "f" and a word that follows a stop, "n" and a noun before numbers; a key
    without such a letter and with a bool is an abbreviation, and whether names follow it."""

    def __init__(self, corpus: dict[str, int | bool] | None = None):
        self.corpus = {("w" + k if isinstance(v, bool) else k): (KNOWN | ABBREVIATION | (NAMED if v else 0) if isinstance(v, bool) else v) for k, v in (corpus or {}).items()}

    def _about(self, low: str, told: Evidence) -> int:
        """Flags of a stopped word: the document first, then the corpus, then the lists."""
        flags = self.corpus.get("w" + low, 0)
        own = told.stops.get(low) if (len(low) <= _PLAIN or "." in low) and told.repeats(low) else None
        if own and own[0] > 1:
            # the document shows the abbreviation; whether names follow it, too, or the corpus
            return flags | KNOWN | ABBREVIATION | (NAMED if own[2] or not flags else 0)
        if flags:
            return flags
        if low in BEFORE_NAME:
            return ABBREVIATION | TITLE | NAMED | NUMBERED
        if low in WITHIN:
            return ABBREVIATION | NUMBERED | (0 if low in _NO_NAME else NAMED) | (TITLE if low in _GOES_ON else 0)
        return 0

    def units(self, text: str | None) -> list[tuple[int, int]]:
        if not text or not text.strip():
            return []
        told = Evidence(text)
        out: list[tuple[int, int]] = []
        at = 0
        for m in [*_BLANK.finditer(text), None]:
            end = m.start() if m else len(text)
            if text[at:end].strip():
                for a, b in self._parts(text, at, end):
                    self._sentences(text, a, b, told, out)
            at = m.end() if m else end
        return out

    @staticmethod
    def _parts(text: str, low: int, high: int) -> list[tuple[int, int]]:
        """List items of a block, or the block itself."""
        starts, no = [], None
        k = low
        while k < high and text[k].isspace():
            k += 1
        first = _ITEM.match(text, k, high)
        bullets = bool(_BULLET.match(text, k, high))
        if not bullets and (not first or _MOVE_NEXT.match(text, first.end(), high)):
            # a prose block may still lead into a list of bullets
            marks = [m.start() + 1 for m in re.finditer(r"\n(?=[-*•‣▪][^\S\n]+\S)", text[low:high])]
            cuts = [low, *(low + x for x in marks), high] if marks else [low, high]
            return list(zip(cuts, cuts[1:], strict=False))
        for m in re.finditer(r"(?:(?<=\n)|\A)[^\S\n]*(?=\S)", text[low:high]):
            p = low + m.end()
            item = _ITEM.match(text, p, high)
            if bullets and _BULLET.match(text, p, high):
                starts.append(p)
            elif not bullets and item and (no is None or int(item.group(1)) == no + 1):
                no = int(item.group(1))
                starts.append(p)
        cuts = [*starts, high]
        return [(a, -b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _sentences(self, text: str, low: int, high: int, told: Evidence, out) -> None:
        def emit(a: int, b: int) -> int:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            return b

        if high < 0:  # a list item is one unit
            emit(low, -high)
            return
        start = low
        while start < high and text[start].isspace():
            start += 1
        opened: list[tuple[str, int]] = []  # closers that would end the open quotes, and where they began
        k = low
        find = (_STOP_OR_SPACE if _THAI.search(text, low, high) else _STOP).search
        while k < high:
            m = find(text, k, high)
            if not m:
                break
            k = m.end()
            c = m.group()
            if c[0].isspace():
                # white space parts sentences of scripts without terminators
                if not opened and m.start() > start and (_thai(text[m.start() - 1]) or (k < high and _thai(text[k]) and any(map(_thai, text[start : m.start()])))):
                    start = emit(start, m.start())
                    start = k
                continue
            if c in _PAIRS:
                if opened and c in opened[-1][0]:
                    opened.pop()
                elif c in _OPEN or c == '"':
                    closes = _OPEN.get(c, '"')
                    if any(text.find(x, k, high) >= 0 for x in closes):
                        opened.append((closes, m.start()))
                continue
            end = k
            # closers that belong to this end
            quote = None
            while end < high and (text[end] in _CLOSERS or text[end] in "*_" or (text[end] in " \u00a0\u202f" and end + 1 < high and text[end + 1] == "»" and opened)):
                if text[end] in " \u00a0\u202f":
                    end += 1
                    continue
                if opened and text[end] in opened[-1][0]:
                    quote = opened.pop()
                elif opened or text[end] in "«“":
                    break
                elif text[end] in "\"'" and not opened:
                    break
                end += 1
            k = end
            if opened:
                continue
            if self._ends(text, start, m.start(), m.end(), end, high, quote, told):
                start = emit(start, end)
                start = end
        emit(start, high)

    def _ends(self, text, start, dot, dot_end, end, high, quote, told) -> bool:
        c = text[dot:dot_end]
        gap = end
        while gap < high and text[gap].isspace():
            gap += 1
        spaced = gap > end
        while gap < high and spaced and text[gap] in "*_~#":
            gap += 1  # emphasis around the next word
        if gap >= high:
            return True
        nxt = text[gap]
        if c[-1] in "。！？｡":
            if quote is None:
                return True
            # a quotation that opens the sentence, or is taken up by a particle, goes on
            lead = text[start : quote[1]].strip()
            return not (not lead or nxt in "とって、，,ね" or (lead[-1] not in "：:" and not spaced and _cjk(nxt) and nxt in "的地之"))
        if c[0] in ";;":
            # a question mark in Greek only
            letters = [x for x in text[start:dot] if x.isalpha()]
            greek = sum("Ͱ" <= x <= "Ͽ" or "ἀ" <= x <= "῿" for x in letters)
            return spaced and greek * 2 > len(letters) and not nxt.islower()
        if c[-1] in "।॥۔":
            return True
        if not spaced and not _cjk(nxt):
            # sentences written without a space between them
            glued = nxt.isupper() or nxt in "“«„\"¿¡" or _caseless(nxt) or (c[0] in "!?" and nxt.isdigit()) or bool(_MOVE_NEXT.match(text, gap, high))
            if not glued or (c == "." and (dot == start or re.fullmatch(r"[^\W\d_]", _before(text, start, dot)))) or (len(c) > 1 and c[0] == "."):
                return False
        if quote is not None:
            # outside the quotation the sentence may go on
            if _caseless(nxt):
                return _cjk(nxt) and bool(text[start : quote[1]].strip())
            return not (nxt.islower() or nxt in ",;:" or nxt in _DASH)
        if nxt in ",;:)" or (nxt in _DASH and c[-1] != "." and gap + 1 < high and (text[gap + 1].islower() or text[gap + 1].isspace())):
            return False
        move = None if nxt.isupper() else _MOVE_NEXT.match(text, gap, high)  # a sentence may begin with the name of a square
        if "…" in c or (c[0] == "." and len(c) > 1 and set(c) == {"."}):
            return nxt.isupper() or nxt in "«“„\"¿¡—" or bool(move) or (_caseless(nxt) and spaced)
        if c[0] in "!?" or c[-1] in "؟":
            if c[0] in "!?" and _MOVE_END.search(text[start:dot]):
                # a marked move; "?" alone after a move may be the end of a question
                if c != "?":
                    numbered = re.search(rf"\d+\.(?:\.\.)?\s*{_SAN}[+#]?$", text[start:dot])
                    return not numbered and c == "!" and (not nxt.islower() or bool(move))
                return not nxt.islower() or bool(move)
            return True
        if nxt.islower() and not move:
            # before a small letter only a word that is no abbreviation anywhere ends a sentence
            word = _before(text, start, dot).lower()
            if word[-1:].isdigit():
                return not word.isdigit() or len(word) > 2 or self._counted(text, start, dot, word, told)
            return len(word) > 2 and "." not in word and not (told.repeats(word) and told.stops.get(word, (0,))[0] > 1) and not self._about(word, told) & ABBREVIATION
        return self._stop_ends(text, start, dot, gap, high, nxt, told)

    @staticmethod
    def _word_before(text, start, dot, word) -> str:
        prev = re.search(r"([^\W\d_]+)\s+$", text[max(start, dot - len(word) - 24) : dot - len(word)])
        return prev.group(1).lower() if prev else ""

    def _counted(self, text, start, dot, word, told) -> bool:
        """Does a noun stand before a number, so that it is no move number?"""
        noun = self._word_before(text, start, dot, word)
        if not noun:
            return False
        own = told.counted.get(noun, (0, 0))
        if own[0] > 1:
            return own[0] > own[1]
        if "n" + noun in self.corpus:
            return bool(self.corpus["n" + noun] & COUNTED)
        return noun in _COUNTED

    @staticmethod
    def _next_word(text, gap, high) -> str:
        m = _WORD.match(text, gap, high)
        return m.group() if m else ""

    def _ordinal(self, text, start, dot, word, following, told) -> bool:
        """Is a number with a stop an ordinal of the capitalised word behind it?"""
        if len(word) > 2 or not following:
            return False
        flags = self.corpus.get("f" + following, 0)
        if following in told.begins or flags & BEGINS:
            return False
        return bool(flags & ORDINAL) or self._word_before(text, start, dot, word) in _ORDINAL

    def _stop_ends(self, text, start, dot, gap, high, nxt, told) -> bool:
        word = _before(text, start, dot)
        if not word:
            return True
        low = word.lower()
        if word.isdigit():
            if len(word) <= 3 and _MOVE_NEXT.match(text, gap, high) and not self._counted(text, start, dot, word, told):
                return False
            return not self._ordinal(text, start, dot, word, self._next_word(text, gap, high), told)
        if word[-1].isdigit():
            return True
        # initials, and one letter with a stop before another one, as in z. B.
        if len(word) == 1 and word.isupper() and not _caseless(word) and nxt.isupper():
            return False
        if len(word) == 1 and re.match(r"[^\W\d_]\.", text[gap : gap + 2]):
            return False
        # an abbreviation of two parts written apart is looked up as a whole, too
        lead = re.search(r"([^\W\d_])\.\s?$", text[max(start, dot - len(word) - 4) : dot - len(word)]) if len(word) <= 2 else None
        about = self._about(f"{lead.group(1).lower()}.{low}", told) if lead else 0
        about = about or self._about(low, told)
        if lead and not about:
            about = ABBREVIATION | NAMED
        if not about & ABBREVIATION:
            return True
        if nxt.isdigit():
            return not about & (NUMBERED | TITLE)
        if lead and _CLOSING.search(text, max(start, dot - 8), dot):
            return not _caseless(nxt) or nxt.isupper()
        if about & TITLE:
            return False
        if low == "г" and not about & KNOWN:  # a town, unless a year stands before it
            return bool(re.search(r"\d\s*$", text[start : dot - 1]))
        following = self._next_word(text, gap, high)
        flags = self.corpus.get("f" + following, 0)
        if following in told.names or flags & (NAME | INSIDE):
            return not about & NAMED
        if following in told.begins or flags & BEGINS:
            return True
        # nothing is known of the next word: a script without capitals goes on
        return not _caseless(nxt) or _cjk(nxt)


#: Fewest stops of a word, or numbers behind one, that tell something.
LEAST = 3
#: Rows of the corpus table that are sent to every worker; a larger one is joined by document.
BROADCAST_ROWS = 100_000
#: Entries that a task counts before it hands them on.
_COUNTS = 200_000


def _asked(told: Evidence) -> set[str]:
    """The keys that a document may ask the corpus for: words that `_before` can yield, also
    behind the stop of a sentence that is written on without a space; what follows a stop."""
    out = {"n" + w for w in told.counted}
    text = told.text
    for m in _ANY_STOP.finditer(text):
        w = _before(text, 0, m.start()).lower()
        while w:
            if len(w) <= _LONGEST:
                out.add("w" + w)
            w = w.partition(".")[2].lstrip(".-'’")
    out.update("w" + "".join(m.group(1, 2)).lower() for m in _APART.finditer(text))
    out.update("f" + m.group(1) for m in _FOLLOWS.finditer(text))
    return out


#: Two short parts with stops, written apart.
_APART = re.compile(r"(?<![^\W\d_])([^\W\d_]\.)\s?([^\W\d_]{1,2})(?=\.)")
#: The word behind a stop.
_FOLLOWS = re.compile(rf"\.[\s*_~#]+({_WORD.pattern})")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, word, next, n: counts of a task. Kinds: s stopped word (next: what follows; ''
    a small letter or comma, 0 a digit), c capital behind a small word, b beginning of a
    sentence, l word without a stop, in small letters, n noun before numbers."""
    stopped: Counter[tuple[str, str]] = Counter()
    numbers: Counter[tuple[str, str]] = Counter()
    single = {kind: Counter() for kind in "bcl"}

    def flush() -> pa.RecordBatch:
        rows = [("s", *k, n) for k, n in stopped.items()] + [("n", *k, n) for k, n in numbers.items()] + [(kind, w, "", n) for kind, c in single.items() for w, n in c.items() if kind != "l" or not w[0].isupper()]
        for c in (stopped, numbers, *single.values()):
            c.clear()
        return pa.RecordBatch.from_arrays([*[pa.array([r[x] for r in rows], pa.string()) for x in range(3)], pa.array([r[3] for r in rows], pa.int64())], ["kind", "word", "next", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if not text:
                continue
            told = Evidence(text)
            for w, rest in told.stopped():
                first = rest[0]
                stopped[w, "" if first.islower() or first in ",;:)" else "0" if first.isdigit() else rest] += 1
            for x in _ORDINAL_LIKE.findall(text):
                stopped["#", x] += 1
            for w, n in told.counted.items():
                if n[0]:
                    numbers[w, "other"] += n[0]
                if n[1]:
                    numbers[w, "move"] += n[1]
            single["b"].update(told.begins)
            single["c"].update(set(_CAPITAL.findall(text)))
            single["l"].update(set(_PLAIN_WORD.findall(text)))
            if len(stopped) + len(single["l"]) > _COUNTS:
                yield flush()
    yield flush()


def corpus_table(texts: DataFrame) -> DataFrame:
    """key, flags: what the whole corpus tells of stopped words, of the words behind them and
    of nouns before numbers; counts are combined in each task, then by word."""
    counts = texts.select("text").mapInArrow(_count_batches, "kind string, word string, next string, n long").groupBy("kind", "word", "next").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "sentence-counts")
    of = lambda kind, name: counts.where(F.col("kind") == kind).select(F.col("word").alias("token"), F.col("n").alias(name))
    pairs = counts.where("kind = 's'").select("word", F.col("next").alias("token"), "n")
    tokens = pairs.where("token not in ('', '0')").groupBy("token").agg(F.sum("n").alias("after"), F.sum(F.when(F.col("word") == "#", F.col("n"))).alias("ordinals"))
    tokens = tokens.join(of("c", "inside"), "token", "left").join(of("b", "begins"), "token", "left").withColumn("small", F.lower("token"))
    tokens = tokens.join(of("l", "smalls").withColumnRenamed("token", "small"), "small", "left").na.fill(0)
    name = (F.col("inside") > 0) & (F.col("smalls") <= 0.2 * F.col("inside"))
    tokens = materialise(tokens.select("token", name.alias("name"), (F.col("begins") > 0).alias("start"), ((F.col("ordinals") >= LEAST) & (F.col("begins") <= 0.1 * F.col("ordinals"))).alias("ordinal"), ((F.col("after") >= LEAST) & (F.col("begins") == 0)).alias("inner")), "sentence-tokens")
    kind = F.when(F.col("token") == "", "low").when(F.col("token") == "0", "digit").when(F.col("name"), "name").when(F.col("start"), "start").otherwise("unknown")
    seen = pairs.where("word != '#'").join(tokens, "token", "left").withColumn("as", kind)
    sums = seen.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("as") == k, F.col("n")).otherwise(0)).alias(k) for k in ("low", "digit", "name", "start", "unknown")])
    sums = sums.join(of("l", "plain").withColumnRenamed("token", "word"), "word", "left").na.fill(0, ["plain"])
    short = f"(length(word) <= {_PLAIN} or instr(word, '.') > 0)"
    flags = sums.where(f"n >= {LEAST}").select(
        F.concat(F.lit("w"), "word").alias("key"), "word",
        # words that never begin a sentence tell little behind a longer word, which may end a phrase
        F.expr(f"{short} and plain <= 3 * n and (low >= 0.3 * n or (start <= 0.05 * n and (length(word) <= 3 or 2 * unknown <= n))) or (low + digit >= 0.9 * n and {short})").alias("abbreviation"),
        F.expr(f"start <= 0.05 * n and n - low >= {LEAST}").alias("title"), F.expr("2 * (name + unknown) >= name + unknown + start").alias("named"), F.expr("digit > 0 and 2 * digit >= n - low").alias("numbered"),
    )
    listed = F.col("word").isin(*sorted(BEFORE_NAME | WITHIN))
    bit = lambda c, v: F.when(F.col(c), v).otherwise(0)
    words = flags.where(F.col("abbreviation") | listed).select("key", F.when(F.col("abbreviation"), KNOWN + ABBREVIATION + bit("title", TITLE) + bit("named", NAMED) + bit("numbered", NUMBERED)).otherwise(KNOWN).alias("flags"))
    # only words that follow an abbreviation or a number are ever asked for
    after = pairs.join(flags.where("abbreviation").select("word").unionByName(texts.sparkSession.createDataFrame([("#",)], "word string")), "word", "left_semi").select("token").distinct()
    follow = tokens.join(after, "token", "left_semi").select(F.concat(F.lit("f"), "token").alias("key"), (bit("name", NAME) + bit("start", BEGINS) + bit("ordinal", ORDINAL) + bit("inner", INSIDE)).alias("flags")).where("flags > 0")
    nouns = counts.where("kind = 'n'").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("next") == "other", F.col("n")).otherwise(0)).alias("other")).where(f"n >= {LEAST}")
    nouns = nouns.select(F.concat(F.lit("n"), "word").alias("key"), F.when(F.col("other") * 2 > F.col("n"), COUNTED).otherwise(0).alias("flags"))
    return words.unionByName(follow).unionByName(nouns)


def _unit_batches(known_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, a, e = [], [], [], []
            for i, text, splitter in known_of(b):
                for n, (x, y) in enumerate(splitter.units(text), 1):
                    ids.append(i)
                    no.append(n)
                    a.append(x)
                    e.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, no, a, e)], ["doc_id", "sent_no", "start_at", "end_at"])

    return run


def _ask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k in _asked(Evidence(text)) if text else ():
                ids.append(i)
                keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["known_id", "key"])


def sentence_units(documents: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, sent_no, start_at, end_at.

    The table of the corpus is sent to the workers while it has at most `broadcast_rows`
    rows; a larger one is joined to what each document asks for, with the same results."""
    schema = "doc_id long, sent_no long, start_at long, end_at long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialise(corpus_table(texts), "sentence-evidence")
    rows = table.collect() if table.count() <= broadcast_rows else None
    if rows is not None:
        shipped = texts.sparkSession.sparkContext.broadcast({r["key"]: r["flags"] for r in rows})

        def one(b):
            splitter = Splitter(shipped.value)
            return ((i, t, splitter) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        return texts.mapInArrow(_unit_batches(one), schema)
    asked = texts.mapInArrow(_ask_batches, "known_id long, key string")
    known = asked.join(table, "key").groupBy("known_id").agg(F.collect_set(F.struct("key", "flags")).alias("known"))
    joined = texts.join(known, F.col("doc_id").eqNullSafe(F.col("known_id")), "left").select("doc_id", "text", "known")

    def each(b):
        return ((i, t, Splitter({w["key"]: w["flags"] for w in known or ()})) for i, t, known in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))

    return joined.mapInArrow(_unit_batches(each), schema)
