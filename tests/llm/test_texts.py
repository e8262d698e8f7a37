import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.llm import canon, leakage, pairs, pii

from . import hand_labelled

CLEAN = ["Plain text, 12 «Мир» (Дружба) Ελπίς", "كِتَابـــ ١٢٣", "line\nbreak\r\n\tEnd…", "Édralula Sañor", "", "сок и чай", "½ №"]
ODD = ["ｆｕｌｌ", "ofﬁce", "ﻷن", "ﺎﻟﻤ", "é", "أ", "zero​width", "soft­hyphen", "no break", "thin space", "‏", "﻿", "Weхarаsk", "Ѕ/56/914", "Μarch", "ہالفاسک", "٢۸", "Ⅳ", " ", "x⁠y", "К"]


@pytest.mark.parametrize("value", CLEAN)
def test_values_in_the_consistent_form(spark, value):
    assert not canon.canonicalize(spark.createDataFrame([(1, value)], "k int, value string"), ["k"]).first().changed


def test_values_that_only_look_right(spark):
    got = canon.canonicalize(spark.createDataFrame(list(enumerate(ODD)), "k int, value string"), ["k"]).orderBy("k").collect()
    assert [ODD[r.k] for r in got if not r.changed] == []
    forms = dict(zip(ODD, (r.canonical for r in got), strict=True))
    assert forms["ｆｕｌｌ"] == "full" and forms["ofﬁce"] == "office" and forms["ﻷن"] == "لأن" and forms["é"] == "é" and forms["no break"] == "no break" and forms["Weхarаsk"] == "wexarask"
    assert forms["ہالفاسک"] == "هالفاسك" and forms["٢۸"] == "٢٨" and forms["‏"] == "" and forms["Ѕ/56/914"] == "s/56/914"


def test_letters_of_more_scripts():
    for odd, form in {"ᎪᏢᏢle": "apple", "cⲟde": "code", "ꓐank": "bank", "p\u0251per": "paper", "lo\u0261o": "logo"}.items():
        assert canon.stands_in(odd) and canon.canonical(odd) == form
    for genuine in ("ᎣᏏᏲ", "ⲕⲟⲥⲙⲟⲥ", "ꓐꓑ", "\u0261\u0251", "\u0251\u0303"):
        assert not canon.stands_in(genuine)


def test_further_letters_in_latin_words(spark):
    odd = {"b\u03b1nk": "bank", "pa\u03c1er": "paper", "boo\u03ba": "book", "te\u03c7t": "text", "da\u03b3s": "days", "bor\u0501er": "border", "he\u04cflo": "hello", "\u04c0sland": "island", "ri\u0475er": "river", "BA\u0393S": "bays", "lo\u0581o": "logo", "\u0548orth": "north"}
    genuine = ["\u03ba\u03b1\u03c1", "\u03c7\u03b1\u03c1\u03b1", "\u0433\u043e\u0440\u0430", "\u0561\u0581\u0584"]
    got = canon.canonicalize(spark.createDataFrame(list(enumerate([*odd, *genuine])), "k int, value string"), ["k"]).orderBy("k").collect()
    assert [r.changed for r in got] == [True] * len(odd) + [False] * len(genuine)
    assert [r.canonical for r in got] == [*odd.values(), *genuine]
    assert canon.canonical("\u0433o\u0440\u0430") == "\u0433\u043e\u0440\u0430"


def test_hidden_characters_of_plane_14(spark):
    odd = ["of\U000e0041fice", "\U000e0001", "नि\U000e0100", "x\U000e01efy", "\U000e0fff"]
    plain = ["\U0001f600", "\U00020000", "\U000e1000", "x"]
    got = canon.canonicalize(spark.createDataFrame(list(enumerate(odd + plain)), "k int, value string"), ["k"]).orderBy("k").collect()
    assert [r.changed for r in got] == [True] * 5 + [False] * 4
    assert [r.canonical for r in got[:5]] == ["office", "", "नि", "xy", ""] and [r.canonical for r in got[5:]] == plain


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_the_form_is_stable(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once


def test_one_script_to_a_word():
    assert canon.one_script("Дрyжбa Weхarаsk Мир сор") == "Дружба Wexarask Мир cop"


def test_canonical_tables(spark):
    df = spark.createDataFrame([(1, "A​", "x"), (1, "A​", "x"), (None, None, "y"), (2, "", "y"), (3, "é" * 200_000, "z")], "k int, answer string, changed string")
    got = canon.canonicalize(df, ["k"], "answer").collect()
    assert sorted(((r.k or 0, len(r.canonical or ""), r.changed) for r in got)) == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 0, False), (3, 200_000, False)]
    assert canon.canonicalize(df.limit(0), ["k"], "answer").count() == 0


# --- pairs ---

Q = "How many families did the Committee on seed banks register in Belosport in 1992?"
PAIRS = [
    (None, Q, "en", None, "empty"), (" ​…", Q, "en", None, "empty"), ("—", Q, "ar", True, "empty"), ("", Q, "en", None, "empty"),
    ("UNKNOWN.", Q, "en", False, "refusal"), ("Not in the context.", Q, "en", None, "refusal"), ("I'm sorry, but I cannot answer this question.", Q, "en", False, "refusal"), ("أعتذر، لا يمكنني تحديد ذلك من المقاطع.", Q, "ar", False, "refusal"),
    ("NOT_IN_CONTEXT", Q, "en", True, ""), ("The passages provided do not say", Q, "ar", False, "refusal"), ("because the auditors were unable to verify the stock lists", Q, "en", False, None), ("unknown soldier", Q, "en", None, None),
    (Q, Q, "en", False, "copied_question"), (f"You asked: {Q.upper()}", Q, "en", None, "copied_question"), (f"{Q} {Q}", Q, "en", None, "copied_question"), (f"«{Q[:-1]}.»", Q, "en", None, "copied_question"), (f"{Q}\nAnswer:", Q, "en", None, "copied_question"),
    (f"{Q} 474,026", Q, "en", None, None), ("The Committee on seed banks registered 5 families in Belosport.", Q, "en", None, None),
    ("Le comité chargé des écoles de Ardovune", Q, "en", None, "other_language"), ("Porque no había personal calificado", Q, "en", None, "other_language"), ("Vor Ende des Jahres 2004, nach Auskunft der Behörde", Q, "en", None, "other_language"), ("لجنة مصارف البذور", Q, "en", None, "other_language"),
    ("28 February 2010", Q, "ar", None, "other_language"), ("HX/48/76582 (Ελπίς)", Q, "en", None, None), ("Belosport «Мир»", Q, "en", None, None), ("بيلوسبورت (A/47/10)", Q, "ar", None, None), ("HX/48/76582.", Q, "ar", None, None), ("1,438,592", Q, "ar", None, None), ("Belosport", Q, "ar", None, "other_language"),
    ("the Working Group on ...", Q, "en", None, "truncated"), ("22 December 19", Q, "en", None, "truncated"), ("1,438,5", Q, "en", None, "truncated"), ("22 December 1996", Q, "en", None, None),
]


@pytest.mark.parametrize(("response", "prompt", "lang", "abstained", "want"), PAIRS)
def test_defects_that_one_pair_shows(response, prompt, lang, abstained, want):
    assert pairs.look(response, prompt, lang, bool(abstained))[0] == want


def test_copies_want_the_prompt_and_nothing_else():
    assert pairs.look(Q, None, "en", False)[0] != "copied_question"
    assert not pairs.copies("", "") and not pairs.copies("seed banks", pairs.plain(Q)) and pairs.copies(pairs.plain(Q), pairs.plain(Q))


def test_compressed_sizes_decide_copies(monkeypatch):
    asked = pairs.plain(Q)
    says = lambda t: pairs.copies(pairs.plain(t), asked)
    assert says(Q.replace("families", "famlies")) and says(Q.replace(" in 1992", "")) and says("Question: " + Q + " Answer:") and says("How many families did the Committee on seed banks register")
    assert not says(Q + " Chad.") and not says(Q + " 12") and not says(Q.replace("families", "people")) and not says("families in Belosport") and not says("the answer is") and not says("Belosport in 1992")
    long = "x" * 200_000
    assert not says(Q + long) and not pairs.copies(long, asked) and pairs.copies(long, long) and not pairs.copies("the", "is it") and not pairs.copies("", "")
    # without the sizes, any words of the prompt pass for a copy of it
    monkeypatch.setattr(pairs, "COPY_BYTES", 1 << 30)
    monkeypatch.setattr(pairs, "COPY_RATIO", 1e9)
    assert says("families in Belosport") and says("Belosport in 1992")


def test_ends_that_break_off(spark, rows):
    data = [("g", str(i), "en", "Which body?", f"the Committee on {t}", False) for i, t in enumerate(["seed banks", "water metering", "school meals"] * 48)]
    data += [("g", f"x{i}", "en", "Which body?", t, None) for i, t in enumerate(["the Committee on wat", "the Commit", "the Committee on", "the Committee on seed banks.", "the Committee on seed"])]
    data += [("g", "dup", "en", "Which body?", "the Committee on wat", None)] * 2 + [("g", None, "en", None, None, None), ("q", "1", "fr", "x", "le comité des", None)]
    df = spark.createDataFrame(data, "tbl string, record_id string, lang string, prompt string, response string, abstained boolean")
    prompts = spark.createDataFrame([("en", "Which body met?"), ("en", None)], "lang string, prompt string")
    got = rows(pairs.defects(df, prompts), "record_id", "defect")
    assert got == [("dup", "truncated"), ("x0", "truncated"), ("x1", "truncated"), ("x2", "truncated"), ("x4", "truncated"), (None, "empty")]
    assert pairs.defects(df.limit(0), prompts.limit(0)).count() == 0
    # a word of any length costs as many rows as there are lengths of endings
    long = spark.createDataFrame([("g", "long", "en", "Which body?", "the " + "w" * 100_000 + " of it", None)], df.schema)
    assert rows(pairs.defects(df.unionByName(long), prompts), "record_id", "defect") == got


def test_pairs_of_the_two_tables(spark, rows):
    generation = spark.createDataFrame([(1, "q1", "en", "yes", None), (1, "q1", "en", "yes", None), (2, "gone", "ar", None, True)], "gen_id bigint, qid string, lang string, answer string, abstained boolean")
    questions = spark.createDataFrame([("q1", ("Who?", "من؟"), ("x", None)), ("q1", ("Who?", "من؟"), ("x", None)), ("q2", None, None)], "qid string, question struct<en: string, ar: string>, answer struct<en: string, ar: string>")
    made, prompts = pairs.question_pairs(generation, questions)
    assert rows(made, "tbl", "record_id", "lang", "prompt", "response") == [
        ("generation", "1", "en", "Who?", "yes"), ("generation", "2", "ar", None, None), ("questions", "q1", "ar", "من؟", None), ("questions", "q1", "en", "Who?", "x"), ("questions", "q2", "ar", None, None), ("questions", "q2", "en", None, None),
    ]
    assert prompts.count() == 4
    assert rows(pairs.defects(made, prompts), "tbl", "record_id", "lang", "defect") == [("generation", "2", "ar", "empty"), ("questions", "q1", "ar", "empty"), ("questions", "q2", "ar", "empty"), ("questions", "q2", "en", "empty")]


# --- leaks ---

ITEM = "When engineer crews from Carvéova sealed the Drendock tunnel on 7 December 2012, they recorded 365,859 leaks, a figure that the Task Force on archives later disputed."


def brute(doc: str, item: str) -> int:
    """The longest run of item words in the document, by trying every start."""
    value, _, word, edge = leakage.folded(pa.array([doc]))
    text = "".join(map(chr, value))
    ivalue, _, iword, _ = leakage.folded(pa.array([item]))
    itext = "".join(map(chr, ivalue))
    starts = [i for i in range(len(itext)) if iword[i]] + [len(itext)]
    best = 0
    for a in range(len(starts) - 1):
        for b in range(a + 1, len(starts)):
            part, at = itext[starts[a] : starts[b]], -1
            while (at := text.find(part, at + 1)) >= 0:
                if edge[at] and edge[at + len(part)]:
                    best = max(best, b - a)
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [ITEM, "بموجب القواعد الجديدة يرفع مركز البيانات إلى أمانة شؤون التعاونيات النسائية تقريرا عن تدريب المعلمين كل شهر", "a b c d e f g h i j k l m n o p q r", " ".join(ITEM.split()[5:20]) + " and some more words of its own to end", "too short an item", ""]
    docs = []
    for i in range(120):
        words = rng.choice(items[:4]).split()
        n = rng.randrange(6, 18)
        a = rng.randrange(max(1, len(words) - n))
        part = words[a : a + n]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "changed"
        text = rng.choice([" ", "\n", "  ", " - "]).join(part)
        text = rng.choice([str, str.upper, lambda t: t.replace(",", "").replace(".", ""), lambda t: t.replace("ا", "اـ"), lambda t: "x" + t])(text)
        docs.append("Before it stood this. " + text + rng.choice([" and after", ", after", "after"]))
    docs += [None, "", ITEM * 50, "x" * 300_000 + " " + ITEM]
    d = spark.createDataFrame([(i, t, "y") for i, t in enumerate(docs)] + [(0, docs[0], "y")], "doc_id bigint, text string, item_id string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(0, items[0]), (None, "x"), (9, None)], "item_id bigint, text string")
    want = {(i, j) for i, doc in enumerate(docs[:123]) if doc for j, item in enumerate(items) if brute(doc, item) >= 12} | {(123, 0)} | ({(123, 3)} if brute(ITEM, items[3]) >= 12 else set())
    for block in (leakage.BLOCK_CHARS, 200):
        got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, t, block_chars=block).filter("n_words >= 12").collect()]
        assert set(got) == want and len(got) == len(set(got))
    assert leakage.leaks(d, t.limit(0)).count() == 0 and leakage.leaks(d.limit(0), t).count() == 0


def test_whole_long_items_are_counted_whole():
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    items = [" ".join(words(n)) for n in (120, 40, 90, 700)]
    long = items[0].split()
    docs = [f"before {items[0]} after", items[3], " ".join(items[1].split()[3:]), " ".join([*long[:50], "other", *long[51:]]), "x" + " ".join(long[:30]), "x" + "".join(long[:4]) + " " + " ".join(long[4:60]) + "y", " ".join(long[:70]) + " " + items[0], (items[2] + " ") * 3]
    prepared = leakage.prepare(list(range(4)), items)
    row, item, n, edits = leakage.hits(pa.array(docs), prepared)
    assert not edits.any()
    got = dict(zip(zip(row.tolist(), item.tolist(), strict=True), n.tolist(), strict=True))
    want = {(0, 0): 120, (1, 3): 700, (2, 1): 37, (3, 0): 69, (4, 0): 29, (5, 0): 55, (6, 0): 120, (7, 2): 90}
    assert got == want and all(brute(docs[i], items[j]) == k for (i, j), k in want.items() if j != 3)


def test_myers_within_the_budget():
    import numpy as np

    rng = random.Random(1)

    def distance(p, t):
        row = list(range(len(t) + 1))
        row = [0 + j for j in range(len(t) + 1)]
        for i, x in enumerate(p, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return min(row)

    for budget in (0, 1, 2):
        p = [[rng.choice("ab") for _ in range(11)] for _ in range(200)]
        t = [[c if rng.random() > 0.1 else rng.choice("abc") for c in x] + ["a"] * budget for x in p]
        codes = lambda m: np.array([[ord(c) for c in x] for x in m], np.uint32).T
        got = leakage.myers(codes(p), codes(t), budget)
        for x, y, g in zip(p, t, got.tolist(), strict=True):
            assert (g <= budget) == (distance(x, y) <= budget)


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_of_prefixes():
    rng = random.Random(4)
    for longest in (9, 70, 140):
        patterns = ["".join(rng.choice("abcd") for _ in range(longest)) for _ in range(12)]
        texts = ["".join(c if rng.random() > 0.02 else rng.choice(["", "x", c + "y"]) for c in p)[: longest + 2].ljust(longest + 2, "z") for p in patterns]
        codes = lambda rows: np.array([[ord(c) for c in r] for r in rows], np.uint32).T
        wanted = np.array([[rng.random() < 0.08 for _ in patterns] for _ in range(longest + 1)])
        got = leakage.distances(codes(patterns), codes(texts), wanted, 2)
        for k, (p, t) in enumerate(zip(patterns, texts, strict=True)):
            for length in np.flatnonzero(wanted[:, k]).tolist():
                true = min(plain_distance(p[:length], t[:m]) for m in range(length + 3) if m <= len(t))
                assert min(int(got[length, k]), 3) == min(true, 3)


def test_edited_passages_are_found_and_others_not(spark):
    # Planted edits: every passage within the budget comes out, with its edits; Myers alone decides.
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items = [" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(12)]
    docs, want = [], {}
    for i in range(100):
        k = rng.randrange(len(items))
        words = items[k].split()
        a = rng.randrange(len(words) - 11)
        passage = " ".join(words[a : a + 12])
        n = rng.randrange(0, 7)
        spots = sorted(rng.sample(range(2, len(passage) - 2), n))
        for at in reversed(spots):
            if passage[at] != " ":
                passage = passage[:at] + rng.choice(["", "z", passage[at] + "z"]) + passage[at + 1 :]
        docs.append(f"{word()} {word()} {passage} {word()}")
        bare = "".join(passage.split())
        true = min(plain_distance("".join(x[s : s + 12]), bare) for x in [words] for s in range(len(x) - 11))
        want[i, k] = true
    prepared = leakage.prepare(list(range(len(items))), items)
    row, item, _, edits = leakage.hits(pa.array(docs), prepared)
    got = dict(zip(zip(row.tolist(), item.tolist(), strict=True), edits.tolist(), strict=True))
    close = {p: n for p, n in want.items() if n <= leakage.BUDGET}
    assert len(close) > 30 and sum(n > 0 for n in close.values()) > 15
    assert all(p in got and got[p] <= max(n, 1) for p, n in close.items())
    assert all(n <= leakage.BUDGET + 1 for p, n in want.items() if p in got)  # the passage may end in the words after it


def test_one_item_of_short_words_does_not_cut_the_others_shorter():
    prepared = leakage.prepare([1, 2, 3, 4], ["a b c d e f g h i j k l m", ITEM, "too short", ""])
    assert len(prepared) == 2 and prepared[0].size <= 4 and prepared[1].size >= 8
    row, item, n, edits = leakage.hits(pa.array(["x " * 5000 + "a b c d e f g h i j k l " + "y " * 5000, "a b " * 20000, ITEM]), prepared)
    assert [(r, prepared[0].ids[i], k) for r, i, k in zip(row.tolist(), item.tolist(), n.tolist(), strict=True)] == [(0, 1, 12), (2, 2, 27)] and not edits.any()


def test_items_too_short_to_check(spark):
    rows = spark.createDataFrame([(ITEM,), ("one two - three",), (None,), ("",), (" ".join("ab" * 1 for _ in range(12)),)], "text string")
    assert [r[0] for r in rows.select(leakage.has_passage(F.col("text"))).collect()] == [True, False, False, False, True]


# --- personal information ---

NAMES = ["Tomas Halsemont", "Petra D. Droander", "Renske Vorander-Pellock", "B. Lindetz", "Mirko Tenwick"]


def marked_sample(n=400):
    """Texts with their pieces (start, end, type), known from how they are made."""
    rng = random.Random(3)
    out = []
    for _ in range(n):
        name, digits = rng.choice(NAMES), "".join(rng.choice("0123456789") for _ in range(7))
        card, tel = f"{digits[:2]}-{digits}-{digits[0]}", f"650.555.01{digits[:2]}"
        parts = rng.choice([
            ["Contact: ", (name, 0), ", tel. ", (tel, 2), "\nThe panel met in 2009."], ["The statement was signed by ", (name, 0), ", holder of passport ", (f"TR {digits}", 3), "."], ["National identity card no. ", (card, 3), " was issued to ", (name, 0), " in Halvport."],
            ["Contact: ", (name, 0), ", tel. ", (tel, 2), "\nMinutes taken by ", (name, 0), "; copies from none."], [f"The contract bears the number {card} and the project code KX{digits}."], ["Minutes taken by ", (name, 0), "; copies from ", (f"{name.split()[-1].lower()}@quarrynet.example", 1), "."], ["The Pellwick Prize was awarded to the Panel on roads."],
            ["The witness gave an address at ", (f"{digits[:2]} Quarryfield Lane", 4), " and the telephone number ", (f"+999 {digits[:2]} 555 01{digits[:2]}", 2), "."], ["Quarrygate Road will be repaired over 40 kilometres."], [f"Some {digits[:3]},{digits[3:6]} families were registered."], [f"The stock holds {digits[:3]} lamps @ 80 dollars each."],
        ])
        text, pieces = "", []
        for x in parts:
            if isinstance(x, tuple):
                pieces.append((len(text), len(text) + len(x[0]), x[1]))
                x = x[0]
            text += x
        out.append((text, pieces))
    return out


def sample(n=400):
    return [t for t, _ in marked_sample(n)]


@pytest.fixture(scope="module")
def model():
    return pii.train(sample())


def found_in(model, texts):
    """(row, start, end, type) of the pieces a model finds."""
    row, start, end, kind = pii.Finder(model).find(pa.array(texts))
    return {(r, x, y, pii.settled_type(texts[r][x:y], k)) for r, s, e, k in zip(row.tolist(), start.tolist(), end.tolist(), kind.tolist(), strict=True) for x, y in pii.bounds(texts[r], s, e, k, model.names)}


def test_held_out_accuracy(model):
    held = marked_sample(900)[400:]
    got = found_in(model, [t for t, _ in held])
    want = {(i, *p) for i, (_, pieces) in enumerate(held) for p in pieces}
    hit = len(got & want)
    assert hit / len(want) > 0.97 and hit / len(got) > 0.97


def test_texts_labelled_by_hand(model):
    # Prose of other kinds than what the model was trained on.
    texts = [t for t, _ in hand_labelled.TEXTS]
    got = {(i, pii.TYPES[k], texts[i][a:b]) for i, a, b, k in found_in(model, texts)}
    want = {(i, k, p) for i, (_, pieces) in enumerate(hand_labelled.TEXTS) for k, p in pieces}
    hit = len(got & want)
    assert hit / len(want) > 0.8 and hit / len(got) > 0.8
    first = {(k, p) for i, k, p in got if i < 3}
    assert first == {(k, p) for i, k, p in want if i < 3}


def test_repeated_names_carry_over(model):
    # With the weight the model has learnt, a name no dictionary has is found in plain surroundings only where the text also has it in telling ones.
    plain = "In 2009 the note of Zorvelda Quimbrasch was read at length by the members of the panel in the old town hall."
    telling = "Contact: Zorvelda Quimbrasch, tel. 650.555.0123\n"
    assert model.skip > 0
    without = pii.Model(model.unary, model.step, 0.0, model.names)
    count = lambda m, text: sum(k == 0 for *_, k in found_in(m, [text]))
    assert count(model, telling + plain) == 2 and count(without, telling + plain) == 1 and count(model, plain) == 0
    texts = [t for t, _ in hand_labelled.TEXTS]
    assert found_in(without, texts) != found_in(model, texts)


def test_rims_of_pieces():
    cut = lambda t, k: [t[a:b] for a, b in pii.bounds(t, 0, len(t), k)]
    assert cut("VORISSEN, Oluwen, Hisao Zeph and", 0) == ["VORISSEN, Oluwen", "Hisao Zeph"] and cut("Prize", 0) == []
    assert cut("Yesterday Ahmed Khalil met Susan Porter", 0) == ["Ahmed Khalil", "Susan Porter"] and cut("Anouk M. Voroway\nSome", 0) == ["Anouk M. Voroway"] and pii.settled_type("078-05-1120", 2) == 3
    assert cut("+999 21 555 0154.", 2) == ["+999 21 555 0154"] and cut("102 in 2010", 2) == [] and cut("TR 5005995.", 3) == ["TR 5005995"]
    assert cut("362 Willowbank Ave.", 4) == ["362 Willowbank Ave."] and cut("7 Mast Lane.", 4) == ["7 Mast Lane"] and cut("Quarrygate Road", 4) == []


def test_marking_and_redacting(spark, model, rows):
    a = "Contact: Tomas Halsemont, tel. 650.555.0167\nContact: Tomas Halsemont, tel. 650.555.0167"
    df = spark.createDataFrame([(1, a, "p"), (2, None, "p"), (3, "", "p"), (4, "Nothing here.", "p"), (None, "é " + a, "p"), (5, "word " * 60_000 + a, "p")], "doc_id bigint, text string, pieces string")
    marked = pii.personal_information(df, model)
    found = rows(pii.found_pieces(marked).filter("doc_id in (1, 5) or doc_id is null"), "doc_id", "pii_type", "pii_text")
    each = [("person_name", "Tomas Halsemont"), ("phone", "650.555.0167")]
    assert found == sorted([(d, *x) for d in (1, 5) for x in each]) + [(None, *x) for x in each]
    texts = {r.doc_id: (r.text, r.n_replaced) for r in pii.redact(marked).collect()}
    line = "Contact: [PERSON_NAME], tel. [PHONE]"
    assert texts[1] == (f"{line}\n{line}", 4) and texts[2] == (None, 0) and texts[3] == ("", 0) and texts[4] == ("Nothing here.", 0) and texts[None][0] == f"é {line}\n{line}"
    assert texts[5][0] == "word " * 60_000 + f"{line}\n{line}"
    assert pii.personal_information(df.limit(0), model).count() == 0


def test_training_on_nothing(spark):
    empty = pii.fit(spark.createDataFrame([], "doc_id bigint, text string"))
    df = spark.createDataFrame([(1, "Contact: Tomas Halsemont")], "doc_id bigint, text string")
    assert pii.found_pieces(pii.personal_information(df, empty)).count() >= 0
    assert pii.fit(df.limit(0)).skip == 0.0


def test_copies_take_one_place_in_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "train", lambda texts, found: texts)
    texts = spark.createDataFrame([(f"Contact: Tomas Halsemont, file {i}.",) for i in range(200)], "text string")
    order = [r.text for r in texts.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).collect()]
    # The text with the smallest hash is a third of all rows, one with a hash in the middle another half of them.
    copies = spark.createDataFrame([(order[0],)] * 400 + [(order[100],)] * 600, "text string")
    long = spark.createDataFrame([("x" * 50 + str(i),) for i in range(300)], "text string")
    for rows in (texts, texts.unionByName(copies).unionByName(long)):
        assert pii.fit(rows.repartition(4), sample_docs=40, sample_chars=40) == order[:40]


FORMS = [
    ("Contact: Jan Smit, tel. +44 20 7946 0958.", ["Jan Smit", "+44 20 7946 0958"]), ("He gave the number +961 1 234567 and left.", ["+961 1 234567"]), ("Tel: (020) 7946 0958", ["(020) 7946 0958"]), ("Fax 212-736-5000; no answer", ["212-736-5000"]),
    ("phone: 01 42 68 53 00.", ["01 42 68 53 00"]), ("tel. 234567, mornings", ["234567"]), ("هاتف: +961 1 234567", ["+961 1 234567"]), ("telephone 00961 3 123456\n12. In 2009", ["00961 3 123456"]), ("write or call 415.736.5000 at night", ["415.736.5000"]),
    ("السيد أحمد خليل قدم التقرير", ["أحمد خليل"]), ("(توقيع) كريم منصور\nنص", ["كريم منصور"]), ("قال السيد محمد بن عبد الله إن", ["محمد بن عبد الله"]), ("الدكتورة نورا الحسن.", ["نورا الحسن"]), ("استمع الفريق إلى سمير حداد وإلى رنا خوري في", ["سمير حداد", "رنا خوري"]), ("Ambassador Jan Smit spoke", ["Jan Smit"]),
    ("السيد الأمين العام", []), ("an amount of 57 669 302 dollars; invoice 63-2750049-5; A/46/93087; section 46.64.61; 1999-2004", []), ("طلبت ثورالون 57 669 302 دولار", []),
]


@pytest.mark.parametrize(("text", "want"), FORMS)
def test_labels_of_any_country_and_family_name(text, want):
    assert [text[a:b] for a, b, _ in pii.label(text)] == want


def test_the_model_learns_other_forms():
    rng = random.Random(5)
    given, family = ["أحمد", "سمير", "كريم", "ليلى", "رنا"], ["خليل", "حداد", "منصور", "خوري", "قاسم"]

    def one():
        d = "".join(rng.choice("123456789") for _ in range(12))
        return rng.choice([f"For details call +44 {d[:2]} {d[2:6]} {d[6:10]} before noon.", f"Contact: Tomas Halsemont, tel. +961 {d[0]} {d[1:7]}.", f"قال السيد {rng.choice(given)} {rng.choice(family)} إن الجلسة {d[:3]} انتهت.", f"The stock holds {d[:3]},{d[3:6]} lamps."])

    held = ["For details call +44 20 7946 0958 before noon.", "Contact: Tomas Halsemont, tel. +961 1 234567.", "قال السيد وليد نجار إن الجلسة 120 انتهت."]
    got = [held[r][x:y] for r, x, y, _ in sorted(found_in(pii.train(sample() + [one() for _ in range(400)]), held))]
    assert got == ["+44 20 7946 0958", "Tomas Halsemont", "+961 1 234567", "وليد نجار"]


def test_names_by_dictionary():
    names = pii.Names(pii.GIVEN | {"petra", "dariel", "ليلى"}, frozenset({"zephetz", "الحداد"}), frozenset({"prize", "committee"}))
    cut = lambda t: [t[a:b] for a, b, k in pii.label(t, names) if k == 0]
    assert cut("the note of Petra Zephetz, Dariel M. Osteway and T. Zephetz") == ["Petra Zephetz", "Dariel M. Osteway", "T. Zephetz"]
    assert cut("the file of ZEPHETZ, Petra is closed; the Petra Prize; Petra left") == ["ZEPHETZ, Petra"] and cut("M. Zephetz, Petra Osteway") == ["M. Zephetz", "Petra Osteway"]
    assert cut("ترسل إلى ليلى السورفلي على العنوان") == ["ليلى السورفلي"] and cut("") == [] and cut("x" * 100_000) == []


def test_learning_names():
    texts = ["Contact: Zora Tellwick, tel. 650-555-0199."] * 3 + ["Zora left. zora@tell.example wrote to the committee."] * 4 + [""]
    names = pii.learn_names(texts, [pii.cued(t) for t in texts])
    assert "zora" in names.given and "tellwick" in names.family and "committee" in names.small and "zora" not in names.small
    assert pii.learn_names([], []).given == pii.GIVEN | pii.GIVEN_AR
