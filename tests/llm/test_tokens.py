import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qirtas.llm import bpe, budget, encode, flat

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_DIR), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    out = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(os.path.join(bpe.TOKENIZER_DIR, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        out[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return out


@pytest.fixture(scope="module")
def encoders():
    return {name: bpe.Encoder(bpe.load(name)) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}


ALPHABET = " \n\t\r'sabtrevmld12!é　ا٣٠ل\U0001f600\U000e0041́\x1c"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25) | st.text(max_size=25), max_size=6))
def test_ids_equal_the_public_tokenizer(reference, encoders, texts):
    for name, encoder in encoders.items():
        assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == [reference[name].encode_ordinary(t) for t in texts]


def test_long_runs_and_many_slices(reference, encoders, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 50)
    rng = random.Random(2)
    texts = ["a" * 4000, " " * 999, "é" * 700 + "\n" * 50, "", *("".join(rng.choice(ALPHABET) for _ in range(200)) for _ in range(60))]
    monkeypatch.setattr(flat, "slices", lambda text, limit=0: ((i, min(i + 7, len(text))) for i in range(0, len(text), 7)))
    assert encoders["byte_bpe_50k"].encode(pa.array(texts)).to_pylist() == [reference["byte_bpe_50k"].encode_ordinary(t) for t in texts]


def test_a_very_long_word(reference, encoders):
    rng = random.Random(9)
    for name, encoder in encoders.items():
        texts = ["".join(rng.choice("etaoinshrdluqzxjkvw") for _ in range(20_000)), "".join(rng.choice("مالكيرنتبةفع") for _ in range(5_000)), "ab" * 5_000]
        assert encoder.encode(pa.array(texts)).to_pylist() == [reference[name].encode_ordinary(t) for t in texts]
    pairs = bpe.byte_pairs([b"ab", b"c", b"bcd"])
    assert pairs.sum() == 3 and pairs[ord("a"), ord("b")] and pairs[ord("c"), ord("d")] and not pairs[ord("b"), ord("a")]


def test_special_token_strings_are_ordinary_text(reference, encoders):
    assert encoders["byte_bpe_50k"].encode(pa.array(["<|endoftext|>"])).to_pylist() == [reference["byte_bpe_50k"].encode_ordinary("<|endoftext|>")]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(flat, "span_hashes", lambda sums, start, end: (end - start).astype(np.uint64) * 0)
    first, kind = flat.distinct_spans(np.array([1, 2, 1, 2, 2]), np.array([0, 1, 2, 3]), np.array([1, 2, 3, 5]))
    assert kind.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_slices_cover_all_rows():
    text = pa.array(["x" * n for n in (5, 0, 50, 1, 1, 30)]).slice(1)
    got = list(flat.slices(text, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(5)) and (1, 2) in got


def test_encoding_a_table(spark, reference):
    rows = [(1, "In 2009 the council", "x"), (2, "", "x"), (3, None, "x"), (4, " \n ", "x"), (None, "وفي عام", "x"), (1, "In 2009 the council", "x"), (5, "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode.encode(df)
    assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    want = [(d, reference["byte_bpe_50k"].encode_ordinary(t or "")) for d, t, _ in rows]
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=key) == sorted(want, key=key)
    assert encode.encode(df.limit(0)).count() == 0
    keyed = spark.createDataFrame([("a", "x")], "key string, text string")
    assert encode.encode(keyed, key="key").columns == ["key", "ids"]


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_counts_are_exact_whatever_the_bound(spark, reference, hot):
    rng = random.Random(4)
    words = ["water", "plant", " 1,234", "تقرير", "\n", "école", "x'll"]
    texts = [("t", str(i), rng.choice(["en", "ar"]), "".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(40)]
    texts += [("t", "40", "en", None), ("t", "41", None, ""), texts[0], ("t", "0", texts[0][2], "other text"), ("t", None, None, "no key")]
    df = spark.createDataFrame(texts, "tbl string, record_id string, language string, text string").repartition(3)
    got = sorted(map(str, ((r.record_id, r.language, r.n_tokens) for r in budget.token_counts(df, ["tbl", "record_id", "language"], hot_pieces=hot).collect())))
    assert got == sorted(map(str, {(i, lang, len(reference["byte_bpe_50k"].encode_ordinary(t or "")), t) for _, i, lang, t in texts} and [(i, lang, n) for i, lang, n, _ in {(i, lang, len(reference["byte_bpe_50k"].encode_ordinary(t or "")), t) for _, i, lang, t in texts}]))
    assert budget.token_counts(df.limit(0), ["tbl", "record_id"]).count() == 0


def test_slices_and_ratios(spark, rows):
    documents = spark.createDataFrame([(1, "one two", " EN-gb", "s", None), (2, None, None, "s", "d"), (3, "deux", "fra", "s", "d")], "doc_id bigint, text string, lang string, source string, domain string")
    chunks = spark.createDataFrame([("c1", "one two", "واحد", "s", "d"), ("c1", "one two", "واحد", "s", "d"), ("c2", "one", None, "s", "d")], "chunk_id string, en string, ar string, source string, domain string")
    counts = budget.token_counts(budget.corpus_texts(documents, chunks), budget.KEYS)
    assert counts.count() == 7
    assert rows(budget.slice_totals(counts).filter("tbl = 'documents'"), "language", "domain", "n_texts", "n_tokens") == [("en", None, 1, 2), ("fr", "d", 1, 2), ("unknown", "d", 1, 0)]
    stats = spark.createDataFrame([("s", "d", 1, (1.5, 0.0)), ("s", "d", 2, (1.25, 0.0)), ("z", "d", 1, None)], "source string, domain string, built_at int, ar_to_en_token_ratio struct<median: double, mean: double>")
    got = {(r.source, r.domain): r for r in budget.slice_ratios(counts, stats).collect()}
    n = next(r.n_tokens for r in counts.filter("record_id = 'c1' and language = 'ar'").collect())
    assert got["s", "d"].published_median == 1.25 and got["s", "d"].n_chunks == 1 and got["s", "d"].median_ratio == n / 2
    assert got["z", "d"].n_chunks is None and got["z", "d"].published_median is None


def test_vocabularies_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.load("word_bpe_49k")
    import json

    with open(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    bpe.check(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {**file["model"], "end_of_word_suffix": "</w>"}}):
        with pytest.raises(ValueError):
            bpe.check({**file, **change})
