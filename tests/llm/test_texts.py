"""Text problems against brute force, libraries and literal cases; nulls, ties, empty tables."""

import base64
import random
from pathlib import Path

import pytest

from gambitflow.llm import endings, languages, leaks, pairs, sentences, tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
has_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files")
DOCS = "doc_id long, text string, ids int, words string, start_at int"


def docs(spark, texts):
    return spark.createDataFrame([(n, t, 1, "x", 2) for n, t in enumerate(texts)], DOCS)


# tokens ---------------------------------------------------------------------------------
def merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte pair merging, the rule that the automaton compiles."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def test_small_automaton_is_exact():
    labels = [bytes([c]) for c in b"abc"] + [b"aa", b"ab", b"aab", b"bc", b"aaaa", b"abc", b"ca", b"cab"]
    ranks = {b: i for i, b in enumerate(labels)}
    m = tokens.MergeAutomaton(labels)
    import itertools

    for n in range(1, 9):
        for w in itertools.product(b"abc", repeat=n):
            w = bytes(w)
            assert m.encode(w) == merges(w, ranks), w
            assert m.decode(m.encode(w)) == w


@has_vocabulary
def test_tokens_against_plain_merging_and_round_trip(spark):
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = random.Random(2)
    bits = ["the", " position", "ing", "  ", "\n\n", "日本語", "प्यादा", "😀👩‍🚀", "'s", "'LL", "123", "<|endoftext|>", "ﬁ", "aaaaaaaaaaaa", " ", "Ж", "!?", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(60)] + [None, "", " ", "x" * 20000, "éa" * 3000]
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(docs(spark, texts)).collect()}
    import regex

    for n, t in enumerate(texts):
        want = [i for w in regex.findall(tokens.PATTERN, t or "") for i in (merges(w.encode(), ranks) if len(w) < 200 else tokens.load(VOCABULARY).encode(w.encode()))]
        assert got[n] == want
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(docs(spark, texts))).collect()}
    assert all(back[n] == (t or "") for n, t in enumerate(texts))
    assert tokens.encode_corpus(docs(spark, []).limit(0)).count() == 0


@has_vocabulary
def test_tokens_equal_the_library():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    import regex

    m = tokens.load(VOCABULARY)
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(" etaoinshrdlu,.'\n0123ÄßжЖก日é😀") for _ in range(rng.randint(1, 60)))
        assert [i for w in regex.findall(tokens.PATTERN, t) for i in m.encode(w.encode())] == lib.encode(t, add_special_tokens=False).ids


# sentences ------------------------------------------------------------------------------
def split(text, corpus=None):
    return [text[a:b] for a, b in sentences.Splitter(corpus).units(text)]


@pytest.mark.parametrize("units", [
    ["Mr. Rook and Dr. Pawn met at move 4, i.e. early.", "It was 5 p.m. sharp."], ["After 24. Rf5! Black is lost.", "Why not 4. Nf3, one asks?", "h4 had done its job."], ["White resigned on move 52.", "Qc4?! was a choice."],
    ["“Take it!” shouted White.", "The coach wrote: “Wait. Then strike.”", "Well... it hangs."], ["They traded queens, rooks, etc.", "The engine Oberon-K 7.5 gives 4.84 here."], ['"Is it mate? I doubt it," said R. King and left.', "E. Pawn (b. 1981) played."],
    ["Am 3. Mai 1920 spielte man die 2. Runde.", "Das gilt z. B. für Weiß bzw. Schwarz.", "„Nimm den Turm!“ rief er."], ["Faut-il jouer Nf4 ?", "« Prends la tour ! » cria M. Roi."], ["—¿Es mate? —preguntó él.", "¡Qué tiempo!"], ["В 1945 г. партия шла в г. Тавренск.", "Это слабо, т. е. теряет, и т. д.", "Вот."],
    ["Έχει χρόνο η άμυνα για f2;", "Ο κ. Βασιλιάς ήρθε."], ["قال د. سمران إن الفارق 2.63 نقطة.", "هل يملك وقتا لنقلة h7؟", "صاح المدرب: «خذ القلعة!» ثم جلس."], ["डॉ. King ने 2.5 अंक पाए।", "“हाथी ले लो!” कोच ने कहा।"],
])
def test_spaced_sentences(units):
    assert split(" ".join(units)) == units
    assert split("\n\n".join(units)) == units
    assert split("  " + "\n".join(units) + "\n \n") == units


@pytest.mark.parametrize("units", [["他写道：“等一等。然后进攻。”", "“吃掉那个车！”教练喊道。", "分数只涨了2.23分……几乎没有。", "开局是1. e4 e5，很好。"], ["「取れ！」とコーチが叫んだ。", "彼は「待て。攻めろ。」と書いた。", "なんと！"]])
def test_unspaced_sentences(units):
    assert split("".join(units)) == units


def test_lists_headings_thai_and_blank():
    assert split("Notes on round 3\n\n1. Develop first.\n2. Check e4 and Nf3, e.g. twice.\n\nDone.") == ["Notes on round 3", "1. Develop first.", "2. Check e4 and Nf3, e.g. twice.", "Done."]
    assert split("ฝ่ายขาวกดดันc2 ครูตะโกนว่า“กิน เรือ!”จากหลัง แต้ม1.5ฯลฯ") == ["ฝ่ายขาวกดดันc2", "ครูตะโกนว่า“กิน เรือ!”จากหลัง", "แต้ม1.5ฯลฯ"]
    assert split("A line\nbreak does not end it. Next.Glued one!Two") == ["A line\nbreak does not end it.", "Next.", "Glued one!", "Two"]
    assert split(None) == split("") == split(" \n\t ") == []


def test_document_evidence_decides():
    # 'xyz.' stands before small letters twice in this document, so it is an abbreviation
    text = "We met xyz. him and xyz. her. Then near Bravo the xyz. Bravo stood."
    assert split(text)[-1] == "Then near Bravo the xyz. Bravo stood."
    assert split("The xyz. Bravo stood near Bravo.", {"xyz": True}) == ["The xyz. Bravo stood near Bravo."]
    assert split("The xyz. Bravo stood.", None) == ["The xyz.", "Bravo stood."]


def test_evidence_counts_dotted_and_longer_words():
    stops = sentences.Evidence("We saw v.chr. and q.r.s.t. him, abcdefgh. it and डॉ. he; abcdefghi. on.").stops
    assert stops == {"v.chr": [1, 0, 0], "q.r.s.t": [1, 0, 0], "abcdefgh": [1, 0, 0], "डॉ": [1, 0, 0]}
    text = "He met q.r.s.t. him and q.r.s.t. her. Then near Bravo the q.r.s.t. Bravo stood."
    assert split(text)[-1] == "Then near Bravo the q.r.s.t. Bravo stood."
    assert split("The v.chr. Bravo stood near Bravo.", {"v.chr": True}) == ["The v.chr. Bravo stood near Bravo."]
    # a longer word that stands before small letters twice goes on there
    assert len(split("It is abcdefgh. so and abcdefgh. thus.")) == 1


def test_corpus_decides_for_any_number_of_words(spark):
    # 52,000 short words with a stop before a small letter, more than any table on the driver
    import itertools

    words = ["".join(x) for x in itertools.islice(itertools.product("bcdfghjklmnpqrstvwxz", repeat=4), 52_000)]
    texts = [" ".join(f"{w}. a" for w in words[k : k + 2000]) for k in range(0, len(words), 2000)] * 5
    asks = ["The bbbb. Bravo stood near Bravo.", "One went.The bbbb. Bravo stood near Bravo.", "The nonono. Bravo stood near Bravo."]
    got = sentences.sentence_units(docs(spark, [*texts, *asks])).where(f"doc_id >= {len(texts)}").collect()
    at = {n: [asks[n][r.start_at : r.end_at] for r in sorted(got, key=lambda r: r.sent_no) if r.doc_id == len(texts) + n] for n in range(3)}
    assert at == {0: ["The bbbb. Bravo stood near Bravo."], 1: ["One went.", "The bbbb. Bravo stood near Bravo."], 2: ["The nonono.", "Bravo stood near Bravo."]}


def test_corpus_evidence_decides_without_lists(spark):
    """Invented abbreviations, names, ordinals and nouns before numbers that no list holds:
    the statistics of other documents change how a silent document is split."""
    rng = random.Random(5)
    names = ["Ombrel", "Vastor", "Quinder", "Lorvane", "Theskar", "Mirdol"]
    starts = ["Some player waits.", "These rooks stand well!", "Every pawn moved on?", "Often a bishop leaves.", "Later it rained."]
    teach = []
    for _ in range(60):
        a, b = rng.sample(names, 2)
        teach.append(
            f"{rng.choice(starts)} {rng.choice(starts)} We saw near {a} the old zrk. {b} who sat behind {a} again. {rng.choice(starts)}\n\n"
            f"{rng.choice(starts)} It was on turn {rng.randint(1, 40)}, they say. He left at 6 qv.tl. and came back. {rng.choice(starts)}\n\nThey met on the 4. Brumaire of that year. It ends there on turn {rng.randint(1, 40)}."
        )
    asks = ["He met zrk. Quinder there. Later it rained.", "He left at 6 qv.tl. Often a bishop leaves.", "They stopped on turn 12. Nf3 was too late.", "It was the 4. Brumaire again."]
    want = [["He met zrk. Quinder there.", "Later it rained."], ["He left at 6 qv.tl.", "Often a bishop leaves."], ["They stopped on turn 12.", "Nf3 was too late."], ["It was the 4. Brumaire again."]]
    assert [split(t) for t in asks[:1] + asks[2:]] != want[:1] + want[2:]  # nothing in the documents themselves
    for most in (sentences.BROADCAST_ROWS, 0):  # sent to the workers, and joined by document
        got = sentences.sentence_units(docs(spark, [*teach, *asks]), most).where(f"doc_id >= {len(teach)}").collect()
        at = [[asks[n][r.start_at : r.end_at] for r in sorted(got, key=lambda r: r.sent_no) if r.doc_id == len(teach) + n] for n in range(len(asks))]
        assert at == want


def test_document_comes_before_corpus_and_lists():
    # the list has "capt", the document and the corpus overrule it
    assert split("He is a capt. Vastor came.", {"wcapt": sentences.KNOWN}) == ["He is a capt.", "Vastor came."]
    assert split("He is a capt. Vastor came.") == ["He is a capt. Vastor came."]
    text = "The capt. left and the capt. slept near Vastor. A capt. Vastor came."
    assert split(text, {"wcapt": sentences.KNOWN})[-1] == "A capt. Vastor came."


def test_units_cover_every_character(spark):
    rng = random.Random(8)
    bits = ["a", "B", ". ", "!", "? ", "\n", "\n\n", "“", "”", "(", ")", "1. ", "e4 ", "。", "ก", " ", "…", "\"", "Mr.", "- x", "​", "«", "»", "**"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        units = sentences.Splitter().units(t)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in units) and all(x[1] <= y[0] for x, y in zip(units, units[1:], strict=False))
        assert "".join(t[a:b] for a, b in units).replace(" ", "").replace("\n", "") == "".join(t.split())
    got = sentences.sentence_units(docs(spark, ["One. Two.", None, "x" * 50000])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, 4), (0, 2, 5, 9), (2, 1, 0, 50000)]
    assert sentences.sentence_units(docs(spark, []).limit(0)).count() == 0


# leaks -----------------------------------------------------------------------------------
def brute(item, text):
    """Is there an alignment of 12 or more item words with at most one error in seven?"""
    n, m = len(item), len(text)
    for i in range(n):
        for j in range(m):
            if item[i] != text[j]:
                continue
            frontier = {(i, j, 0)}
            while frontier:
                new = set()
                for a, b, e in frontier:
                    size = a - i + 1
                    if a < n and b < m and item[a] == text[b]:
                        if size >= 12 and e * 7 <= size:
                            return True
                        new.add((a + 1, b + 1, e))
                    elif a < n and b < m and e < 3:
                        new.add((a + 1, b + 1, e + 1))
                    if a < n and b < m and e < 3:
                        new.add((a, b + 1, e + 1))
                frontier = new
    return False


def test_leaks_match_brute_force():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    hits = 0
    for _ in range(150):
        item = [rng.choice(vocabulary) for _ in range(rng.randint(10, 30))]
        a = rng.randint(0, max(0, len(item) - 8))
        text = item[a : a + rng.randint(8, 26)]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[k] = "other"
            else:
                text.insert(k, "more")
        text = ["pre"] * rng.randint(0, 3) + text + [rng.choice(vocabulary) for _ in range(3)]
        found = bool(leaks.LeakFinder([(1, item)]).find(" ".join(text)))
        assert found == brute(item, text), (item, text)
        hits += found
    assert 20 < hits < 140


def test_leaks_of_several_items_match_brute_force():
    """Items that share long runs, so that the longest match of one hides those of others."""
    rng = random.Random(11)
    pairs_found = 0
    for _ in range(120):
        vocabulary = [f"w{i}" for i in range(rng.choice([6, 14, 40]))]
        base = [rng.choice(vocabulary) for _ in range(30)]
        items = []
        for i in range(5):
            a = rng.randint(0, 12)
            items.append((i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))] + base[a : a + rng.randint(8, 18)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]))
        a = rng.randint(0, 10)
        text = base[a : a + rng.randint(10, 20)]
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice([*vocabulary, "other"])
        found = set(leaks.LeakFinder(items).find(" ".join(text)))
        want = {i for i, ws in items if len(ws) >= 12 and brute(ws, text)}
        assert found == want, (items, text)
        pairs_found += len(found)
    assert pairs_found > 100


def test_shorter_run_of_another_item_leaks_too():
    run = [f"w{k}" for k in range(12)]
    items = [(1, [*run, *"abc"]), (2, ["q", *run, *"bcd"])]
    assert set(leaks.LeakFinder(items).find(" ".join(["q", *run]))) == {1, 2}
    # and where the longer match goes on behind the end of the shorter one
    assert set(leaks.LeakFinder(items).find(" ".join(["q", *run, "b", "c", "d"]))) == {1, 2}


def test_three_errors_are_enough(monkeypatch):
    rng = random.Random(12)
    cases = []
    for _ in range(60):
        item = [f"w{k}" for k in range(rng.randint(24, 70))]
        text = list(item)
        for _ in range(len(item) // 7):
            k = rng.randrange(1, len(text) - 1)
            if rng.random() < 0.6:
                text[k] = "other"
            else:
                text.insert(k, "more")
        cases.append((item, text))
    few = [bool(leaks.LeakFinder([(1, i)]).find(" ".join(t))) for i, t in cases]
    monkeypatch.setattr(leaks, "MOST_ERRORS", 9)
    assert few == [bool(leaks.LeakFinder([(1, i)]).find(" ".join(t))) for i, t in cases] and any(few)


def test_leaks_removed(spark):
    own = " ".join(f"own{k}" for k in range(14))
    items = spark.createDataFrame([(1, own + ".")], "item_id long, text string")
    texts = [f"Before it. {own}, and behind it comes much more text that nobody asked for, on and on until the very end of the page.", own, None, "Nothing here."]
    got = {r.doc_id: r for r in leaks.without_leaks(docs(spark, texts), items).collect()}
    assert set(got) == {0, 1} and got[0].text.startswith("Before it. , and behind") and got[1].text is None
    spans = leaks.leaked_spans(docs(spark, texts), items).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start_at : r.end_at]) for r in spans) == [(0, own), (1, own)]


def test_leaks_through_markup_and_shared_sentences(spark):
    own = "Beside the amber mill of Grenholt some quiet baker often paints every rook from a1 to b2."
    shared = "Answer with one single move and write nothing else before the closing line of your reply."
    items = spark.createDataFrame([(1, f"{own} {shared}"), (2, shared), (3, None), (4, ""), (5, shared + " Too short to be leaked alone.")], "item_id long, text string")
    texts = ["BESIDE **the** am­ber mill <b>of</b> Grenholt, some​ quiet baker -- often paints one rook from a1", shared, None, "", "the amber mill of Grenholt some quiet baker often paints", own.replace("amber", "umber"), own + own]
    got = sorted(map(tuple, leaks.leaks(docs(spark, texts), items).collect()))
    assert got == [(0, 1), (5, 1), (6, 1)]
    assert {r.item_id: r.documents for r in leaks.leak_report(docs(spark, texts), items).collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0}
    assert leaks.leaks(docs(spark, texts), items.limit(0)).count() == 0 and leaks.leaks(docs(spark, []).limit(0), items).count() == 0


def test_automaton_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(15))) for i in range(6)], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    got = leaks.leaks(docs(spark, [" ".join(f"word{i}x{k}" for k in range(13)) for i in range(6)]), items).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(6)]


# endings ---------------------------------------------------------------------------------
@pytest.mark.parametrize(("text", "want"), [
    ("White wins a paw", "cut"), ("White wins.", "complete"), ("He wrote: “Wait. Then strike.”", "complete"), ("He wrote: “Wait.", "cut"), ("So it ended\nFINAL ANSWER: e2e4, a1", "cut"), ("x.\nFINAL ANSWER: e2e4", "complete"),
    ("x.\n**FINAL ANSWER: White King at e1**", "complete"), ("x.\n```\nFINAL ANSWER: a1\n```", "complete"), ("x.\nFINAL AN", "cut"), ("The end is...", "cut"), ("The end. �", "cut"), ("See Fig.", "cut"), ("Play until 11 p.m.", "weak"), ("queens, rooks, etc.", "complete"),
    ("After 24.", "weak"), ("Il pense à.", "weak"), ("White moves é.", "weak"), ("The best plan is plan b.", "weak"), ("Der Zug kam um 5.", "weak"), ("He won 24.", "weak"), ("It was 1924.", "complete"), ("x.\nFINAL ANSWER: c3>b8, e7>d5 once it is checked.", "complete"),
    ("White resigned on move 50.", "weak"), ("", ""), (None, ""), ("...", ""), ("**", ""), ("- one.\n- two.", "complete"), ("The final answer is $\\boxed{e4}$", "complete"), ("The final answer is $\\boxed{e", "cut"), ("FINAL ANSWER:", ""), ("Done.\nFINAL ANSWER:", "cut"), ("他写道：“等。", "cut"), ("残局决定胜负。", "complete"), ("残局决定胜", "cut"),
])
def test_verdicts(text, want):
    assert endings.verdict(text) == want


INFERENCE = "struct<prompt:string,response:string,thinking_content:string>"


def lines(spark, rows):
    return spark.createDataFrame([(n, k, (p, r, t), "x", True) for n, (k, p, r, t) in enumerate(rows)], f"rec_id long, run_key string, inference {INFERENCE}, label string, cut boolean")


def test_hidden_limits(spark):
    rng = random.Random(1)
    rows = []
    for n in range(300):
        body = " ".join(rng.choice(["white", "black", "moves", "rook", "é"]) for _ in range(rng.randint(5, 60)))
        text = (body + ".").encode()[:200].decode("utf-8", "ignore")
        rows.append(("capped", None, text, None))
        rows.append((None, None, body + ".", "It ends at 5 p.m." if n % 2 else None))
    seen = endings.inspected(lines(spark, rows))
    limits = {(r.run_key, r.field, r.measure, r["size"]) for r in endings.hidden_limits(seen).collect()}
    assert ("capped", "response", "utf8", 200) in limits and not any(k is None for k, *_ in limits)
    cut = endings.cut_values(seen)
    assert all(r.run_key == "capped" for r in cut.collect())
    assert sorted(r.rec_id for r in cut.collect()) == [n for n, (k, _, t, _) in enumerate(rows) if k == "capped" and not t.endswith(".")]
    rates = {(r.run_key, r.field): (r.n, r.cut) for r in endings.cut_rates(None, seen, cut).collect()}
    assert rates[None, "response"] == (300, 0) and rates["capped", "response"][1] > 20
    assert endings.cut_values(endings.inspected(lines(spark, []))).count() == 0


# pairs -----------------------------------------------------------------------------------
PROMPT = "Consider the board given as FEN 8/8/8/8/8/8/8/K6k w - - 0 {n}. List all moves that fit the task, e.g. a{n}b2. Explain the reasoning step by step.\nFINAL ANSWER: <answer>"


def test_defects(spark):
    rows, want = [], {}

    def add(prompt, response, defect=None):
        if defect:
            want[len(rows)] = defect
        rows.append(("r", prompt, response, None))

    for n in range(40):
        p = PROMPT.format(n=n)
        add(p, f"White keeps the rook on a1 and waits. I cannot move the pinned piece, so it stays. Both sides have castled by move {n}.\nFINAL ANSWER: a1b2")
        if n % 4 == 0:  # a template that no word list knows
            add(p, f"It is better if a human coach handles board {n} today.", "refusal")
            add(p, "Thanks, but it is better if a human coach handles board 7 today.\nFINAL ANSWER: N/A", "refusal")
        if n % 10 == 0:
            for r in (None, "", " \n", "**", "```\n```", "FINAL ANSWER:", "<answer></answer>", "..."):
                add(p, r, "empty")
            add(p, p, "copy")
            add(p, "> " + p.split("\n")[0].upper(), "copy")
            add(p, "You asked: " + p[: p.index(" Explain")], "copy")
            add(p, "Weiß hält den Druck auf der Diagonale aufrecht. Der Springer gehört nach c5.\nFINAL ANSWER: a1b2", "other_language")
            add(p, "白方继续对c2格施加压力。残局中远方通路兵决定胜负。", "other_language")
            add(p, "White keeps the rook on a1 and waits. Both sides have cas", "truncated")
            add(p, p.split(". ")[0] + ". White keeps the rook on a1 and waits.\nFINAL ANSWER: a1b2")
            add(p, "So the answer is e2e4.")
            add("Gegeben ist das Brett und die Frage, welche Züge hier am besten sind.", "FINAL ANSWER: e2e4")
            add(None, "White keeps the rook on a1 and waits.\nFINAL ANSWER: a1b2")
    got = {r.rec_id: r.defect for r in pairs.defects(lines(spark, rows)).collect()}
    assert got == want
    assert pairs.defects(lines(spark, [])).count() == 0


def test_clusters_keep_all_verified_links(spark):
    base = [f"w{k}" for k in range(30)]
    texts = [" ".join([*base[:-1], f"end{n}"]) for n in range(6)] + [" ".join(f"v{k}" for k in range(30)), "a b", "a b c"]
    got = {r.opening: r.cluster for r in pairs.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert len({got[t] for t in texts[:6]}) == 1 and len(set(got.values())) == 4


def test_clusters_are_the_components_of_all_similar_pairs(spark, monkeypatch):
    # one template with varying slot words: pairs far below and above the limit share buckets
    rng = random.Random(3)
    base = [f"w{k}" for k in range(40)]
    texts = sorted({" ".join(f"s{rng.randrange(3)}" if k in (3, 4, 17, 18, 30) else w for k, w in enumerate(base)) for _ in range(120)})
    rows = spark.createDataFrame([(t,) for t in texts], "opening string")
    (batch,) = pairs._signatures(iter(rows.toArrow().combine_chunks().to_batches()))
    signed = batch.to_pylist()
    root = {r["opening"]: r["opening"] for r in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            x, y = set(a["shingles"]), set(b["shingles"])
            if set(a["bands"]) & set(b["bands"]) and len(x & y) >= pairs.SIMILAR * len(x | y):
                root[top(a["opening"])] = top(b["opening"])
    want = {frozenset(t for t in root if top(t) == r) for r in set(map(top, root))}
    for block in (1000, 7):
        monkeypatch.setattr(pairs, "BLOCK", block)
        got: dict[int, set] = {}
        for r in pairs.clusters(rows).collect():
            got.setdefault(r.cluster, set()).add(r.opening)
        assert set(map(frozenset, got.values())) == want
    assert len(want) > 1


def test_limits_decide_weak_endings(spark):
    """Every text ends with its stop; only those that pile up at the limit are cut."""
    rng = random.Random(9)
    rows = []
    for n in range(200):
        size = rng.randint(70, 160)
        body = ("White waits near the rook and plays on for hours. " * 4)[: size - 6].rstrip()
        rows.append(("free", None, f"{body} on {rng.randint(10, 30)}.", None))
    for n in range(40):
        text = ("White waits near the rook and plays on. " * 4)[:117] + (" b." if n % 2 else "...")  # 120 characters
        rows.append(("capped", None, text, None))
        rows.append(("capped", None, "White waits, and all is said." * rng.randint(1, 3), None))
    rows.append(("capped", None, ("White waits near the rook and plays on. " * 4)[:116] + " b.", None))  # a space was dropped
    rows.append(("capped", None, "日" + ("White waits near the rook and plays on. " * 4)[:112] + " b.", None))  # 118 bytes: two of a character were dropped
    rows += [("capped", None, "Then comes plan b." + " It is a good one." * k + " So is plan c.", None) for k in range(3)]  # weak, far below the limit
    cut = {r.rec_id for r in endings.cut_values(endings.inspected(lines(spark, rows))).collect()}
    assert cut == {n for n, (k, _, t, _) in enumerate(rows) if k == "capped" and 116 <= len(t) <= 120 and (t.endswith(" b.") or t.endswith("..."))}


def test_long_refusals_and_unanswered_sound_texts(spark):
    """A refusal behind a long preamble, in words that no list knows."""
    rng = random.Random(2)
    openers = [f"The {a} holds the {b} on the long file while the clock runs on." for a in ("rook", "bishop", "knight", "queen") for b in ("pawn", "king", "tower", "square", "line")]
    rows, want = [], {}
    for n in range(60):
        p = PROMPT.format(n=n)
        long = " ".join(rng.choice(openers) for _ in range(14))
        rows.append(("r", p, f"{long}\nFINAL ANSWER: a1b2", None))
        rows.append(("r", p, long, None))
        if n % 5 == 0:
            want[len(rows)] = "refusal"
            rows.append(("r", p, f"{long} The committee leaves board {n} to the referee on duty tonight.", None))
    got = {r.rec_id: r.defect for r in pairs.defects(lines(spark, rows)).collect()}
    assert got == want


def test_learnt_languages(spark):
    texts = {"xa": "mor tel vanu drisk olan pelu", "xb": "quin sarv moltu ebri kesti rauf", "zz": "白方继续对c2格施加压力"}
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choice(t.split()) for _ in range(9)) + ".", code if n % 20 else "XB-x-part") for n, (code, t) in enumerate([*texts.items()] * 40)]
    p = languages.learn(spark.createDataFrame([*rows, (None, None, None), (9999, "only one text", "yy"), (9998, " ", "xa")], "doc_id long, text string, lang string"))
    assert p.names == ["xa", "xb"]
    assert [p.language(t) for t in ("Mor vanu e4 olan.", "Sarv 12. Nf3 kesti.", "白方", "", "mor vanu")] == ["xa", "xb", "zh", None, "xa"]
    assert p.language(" ".join(f"unseen{'abcdefghijklmnopqrst'[k]}" for k in range(20))) == "und"
    prompts = ["Mor tel vanu drisk olan pelu mor tel, vanu drisk."] * 3
    rows = [("r", prompts[0], "Vanu drisk mor olan.\nFINAL ANSWER: a1", None), ("r", prompts[1], "Quin sarv moltu ebri kesti.\nFINAL ANSWER: a1", None), ("r", prompts[2], "FINAL ANSWER: a1", None)]
    labelled = spark.createDataFrame([(n, " ".join(rng.choice(t.split()) for _ in range(9)), c) for n, (c, t) in enumerate([*texts.items()] * 40)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in pairs.defects(lines(spark, rows), labelled).collect()] == [(1, "other_language")]
    assert languages.learn(labelled.limit(0)).names == ["en", "de", "fr", "es"]


def test_languages():
    assert pairs.language("The rook belongs on e4, where it blocks the pawn.") == "en"
    assert pairs.language("Der Turm gehört nach e4, wo er beide Flügel beherrscht.") == "de"
    assert pairs.language("Le cavalier se place en c2 et bloque le pion.") == "fr"
    assert pairs.language("El caballo llega a c2 y bloquea el peón.") == "es"
    assert [pairs.language(x) for x in ("Ладья идёт на e4.", "白方继续施加压力。", "白は圧力を保っている。", "e4 12 Nf3", "")] == ["ru", "zh", "ja", None, None]
