"""Building the aligned corpus: selection, citation closure, beads, chunks, repair and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, symbols
from ..functions import text as T
from .lineage import small_or_not
from .ordered import highest_before, neighbour

# Default thresholds of the selection and of chunks.
RULES = {"min_one_to_one_links": 30, "max_one_to_one_links": 400, "min_one_to_one_ratio": 0.85}
TARGET_TOKENS, MAX_TOKENS, TOKEN_LIMIT = 200, 350, 512


# --- pairs of documents ------------------------------------------------------------------------------------------


def pair_index(links: DataFrame) -> DataFrame:
    """(doc_id, doc_score, n_links, n_one_to_one) of links (ar_doc, en_doc, score, ar, en), where both sides name one document."""
    one = (F.size("ar") == 1) & (F.size("en") == 1)
    same = links.filter(F.col("ar_doc") == F.col("en_doc"))
    return same.groupBy(F.col("en_doc").alias("doc_id")).agg(F.max("score").alias("doc_score"), F.count("*").alias("n_links"), F.count_if(one).alias("n_one_to_one"))


def mismatched(links: DataFrame) -> DataFrame:
    """One row, n: the document pairs whose sides name different documents."""
    return links.select("ar_doc", "en_doc").distinct().agg(F.count_if(F.col("ar_doc") != F.col("en_doc")).alias("n"))


def ratio() -> Column:
    return F.coalesce(F.try_divide(F.col("n_one_to_one"), F.col("n_links")), F.lit(0.0))


def eligible(pairs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Pairs aligned one to one often enough, and neither too short nor too long; NULL counts are not eligible."""
    return pairs.filter(F.col("n_one_to_one").between(rules["min_one_to_one_links"], rules["max_one_to_one_links"]) & (ratio() >= rules["min_one_to_one_ratio"]))


def selection_key(doc_id: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), doc_id), 256)


def in_hash_order(docs: DataFrame, salt: str, n: int, key: str = "doc_id") -> DataFrame:
    """The first n distinct documents in the order of their salted hashes: adding others never reshuffles them."""
    return docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(selection_key(F.col(key), salt), key).limit(n)


def cited_closure(seeds: DataFrame, cited: DataFrame, filed: DataFrame, salt: str, most: int) -> DataFrame:
    """(doc_id) of at most `most` documents that seeds (doc_id) cite, in hash order; seeds themselves do not count.

    cited (doc_id, key) are the keys a document names, filed (key, doc_id) the documents under a key.
    """
    keys = cited.join(seeds, "doc_id", "left_semi").select("key").distinct()
    found = filed.join(keys, "key", "left_semi").select("doc_id").distinct().join(seeds, "doc_id", "left_anti")
    return in_hash_order(found, salt, most)


def cited_keys(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key column, symbol, key): the document symbols named in the texts and the keys they are filed under."""
    return texts.select(key, F.explode(symbols.references(F.coalesce(F.col(text), F.lit("")))).alias("symbol")).distinct().withColumn("key", symbols.symbol_key(F.col("symbol")))


def manifest(seeds: DataFrame, cited: DataFrame) -> DataFrame:
    return seeds.select("doc_id", F.lit("seed").alias("role")).unionByName(cited.select("doc_id", F.lit("cited").alias("role")))


def manifest_difference(ours: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows of one manifest that the other lacks, with the side they are on; equal manifests give no rows."""
    a, b = ours.select("doc_id", "role"), committed.select("doc_id", "role")
    return a.exceptAll(b).withColumn("side", F.lit("ours")).unionByName(b.exceptAll(a).withColumn("side", F.lit("committed")))


def symbol_match(docs: DataFrame) -> DataFrame:
    """(matches, n): how many documents' header symbols give the path they are filed under."""
    return docs.select((symbols.symbol_key(F.col("symbol")) == symbols.doc_key(F.col("doc_id"))).alias("matches")).groupBy("matches").agg(F.count("*").alias("n"))


# --- sentences, beads, chunks ------------------------------------------------------------------------------------


def newest_sentences(sentences: DataFrame) -> DataFrame:
    """Of each (doc_id, lang, sid) the version with the newest ingested_at (of equals the larger text)."""
    row = F.struct("ingested_at", "text", "pid", "pos")
    return sentences.groupBy("doc_id", "lang", "sid").agg(F.max(row).alias("v")).select("doc_id", "lang", "sid", "v.pid", "v.pos", "v.text")


def paragraph_ends(sentences: DataFrame) -> DataFrame:
    """Sentences with last: whether the next one of the document belongs to another paragraph, or there is none."""
    ahead = neighbour(sentences, ["doc_id", "lang"], "pos", "pid", "_next", ties=("sid",))
    return ahead.withColumn("last", F.coalesce(F.col("_next") != F.col("pid"), F.lit(True))).drop("_next")


def alignment_errors(beads: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, lang, error, n) of links (doc_id, bead_no, en, ar) that name missing sentences or go backwards.

    A sentence goes backwards if any before it stood at its place or further on.  A document with an error is dropped as a whole by its caller.
    """
    sides = [beads.select("doc_id", "bead_no", F.lit(x).alias("lang"), F.posexplode(x).alias("at", "sid")) for x in T.LANGS]
    named = sides[0].unionByName(sides[1]).join(sentences.select("doc_id", "lang", "sid", "pos"), ["doc_id", "lang", "sid"], "left")
    before = highest_before(named, ["doc_id", "lang"], "bead_no", "pos", "before", ties=("at",))
    told = before.select("doc_id", "lang", F.when(F.col("pos").isNull(), "missing").when(F.col("pos") <= F.col("before"), "not_monotonic").alias("error"))
    return told.filter("error IS NOT NULL").groupBy("doc_id", "lang", "error").agg(F.count("*").alias("n"))


def join_sentences(parts: Column) -> Column:
    """Text of an array of (pid, text): a blank within a paragraph, a line end between two; NULL and empty texts are skipped."""
    own = F.filter(parts, lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return F.aggregate(
        own,
        F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("pid")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.when(acc["pid"].isNull(), "").when(acc["pid"] == s["pid"], " ").otherwise("\n"), s["text"]).alias("text"), s["pid"].alias("pid")),
        lambda acc: acc["text"],
    )


def bead_texts(beads: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, bead_no, paragraph_end, one_to_one, en, ar): en and ar as arrays of (at, pid, text).

    One row per (doc_id, bead_no); NULL paragraph_end is false; sids without sentence are passed over.
    """
    one = beads.groupBy("doc_id", "bead_no").agg(F.max(F.struct("ingested_at", F.coalesce("paragraph_end", F.lit(False)).alias("e"), "en", "ar")).alias("b"))
    one = one.select("doc_id", "bead_no", F.col("b.e").alias("paragraph_end"), F.col("b.en").alias("en"), F.col("b.ar").alias("ar"))
    one = one.withColumn("one_to_one", F.coalesce((F.size("en") == 1) & (F.size("ar") == 1), F.lit(False)))
    sides = [one.select("doc_id", "bead_no", F.lit(x).alias("lang"), F.posexplode(x).alias("at", "sid")) for x in T.LANGS]
    named = sides[0].unionByName(sides[1]).join(newest_sentences(sentences), ["doc_id", "lang", "sid"])
    part = F.struct("at", "pid", "text")
    texts = named.groupBy("doc_id", "bead_no").agg(*(F.sort_array(F.collect_list(F.when(F.col("lang") == x, part))).alias(x) for x in T.LANGS))
    return one.drop("en", "ar").join(texts, ["doc_id", "bead_no"], "left").withColumns({x: F.coalesce(x, F.array().cast("array<struct<at:int,pid:string,text:string>>")) for x in T.LANGS})


def _closings(en: np.ndarray, ar: np.ndarray, ends: np.ndarray, held: tuple[int, int, bool], target: int, most: int) -> tuple[list[int], tuple[int, int, bool], bool]:
    """(places where a new chunk begins, what the last chunk holds, whether it is closed) of consecutive beads.

    `held` is what the chunk before them holds: tokens in both languages, and whether it has a bead.  From where a chunk
    begins, running totals tell by binary search where it would overflow, and where it reaches the target.
    """
    n = len(en)
    e, a = (np.concatenate(([0], np.cumsum(x))) for x in (en, ar))
    paragraph = np.append(np.where(ends, np.arange(n), n), n)
    paragraph = np.minimum.accumulate(paragraph[::-1])[::-1]  # the next paragraph end from each place on
    begins, at, some = [], 0, held[2]
    base_e, base_a = -held[0], -held[1]
    while True:
        over = min(int(np.searchsorted(e, base_e + most, side="right")), int(np.searchsorted(a, base_a + most, side="right"))) - 1
        over = over if some else max(over, at + 1)  # a bead alone is a chunk, however long
        reached = min(int(np.searchsorted(e, base_e + target)), int(np.searchsorted(a, base_a + target))) - 1
        closing = int(paragraph[min(max(reached, at), n)])
        begin = min(max(over, at), closing + 1)
        if begin >= n:
            closed = closing == n - 1 and over >= n
            return begins, (0, 0, False) if closed else (int(e[n] - base_e), int(a[n] - base_a), some or at < n), closed
        begins.append(begin)
        at, some, base_e, base_a = begin, False, int(e[begin]), int(a[begin])


def pack(beads: DataFrame, target: int = TARGET_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, bead_no, grp) of beads (doc_id, bead_no, paragraph_end, en_tokens, ar_tokens): which chunk each is in.

    A chunk closes before a bead that would take either language over `most`, and after one that ends a paragraph once
    either language has `target`; a bead above `most` is a chunk of its own.  NULL counts are 0, NULL paragraph_end is
    false; beads of one number stay in order of arrival.

    What a bead does depends on all before it, so a document's beads pass one after the other; they are streamed in
    order, never gathered, with three numbers of state from batch to batch, and a step for each chunk, not each bead.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held, grp = None, (0, 0, False), 0
        for frame in frames:
            if not len(frame):
                continue
            docs = frame["doc_id"].to_numpy()
            en, ar, ends = (frame[c].to_numpy() for c in ("en_tokens", "ar_tokens", "paragraph_end"))
            out = np.zeros(len(frame), np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
            for first, last in zip(cuts.tolist(), [*cuts[1:].tolist(), len(frame)], strict=True):
                if docs[first] != doc:
                    doc, held, grp = docs[first], (0, 0, False), 0
                own = slice(first, last)
                begins, held, closed = _closings(en[own], ar[own], ends[own].astype(bool), held, target, most)
                steps = np.zeros(last - first, np.int64)
                steps[begins] = 1
                out[own] = grp + np.cumsum(steps)
                grp += len(begins) + closed
            yield pd.DataFrame({"doc_id": docs, "bead_no": frame["bead_no"], "grp": out})

    whole = beads.filter("doc_id IS NOT NULL AND bead_no IS NOT NULL").select(
        "doc_id", F.col("bead_no").cast("bigint").alias("bead_no"), F.coalesce("paragraph_end", F.lit(False)).alias("paragraph_end"), *(F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("en_tokens", "ar_tokens"))
    )
    ordered = whole.repartition("doc_id").sortWithinPartitions("doc_id", "bead_no")
    return ordered.mapInPandas(run, "doc_id string, bead_no bigint, grp bigint")


def chunk_id(doc_id: Column, k: Column) -> Column:
    return F.concat(doc_id, F.lit("#"), F.when(k < 10_000, F.lpad(k.cast("string"), 4, "0")).otherwise(k.cast("string")))


def make_chunks(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, en, ar, n_beads, one_to_one_ratio) of `bead_texts` and the chunks `pack` put them in."""
    members = texts.join(groups, ["doc_id", "bead_no"])
    own = members.groupBy("doc_id", "grp").agg(
        F.sort_array(F.collect_list(F.struct("bead_no", "en", "ar"))).alias("b"), F.count("*").alias("n_beads"), F.avg(F.col("one_to_one").cast("double")).alias("one_to_one_ratio")
    )
    en, ar = (join_sentences(F.flatten(F.col(f"b.{x}"))) for x in T.LANGS)
    return own.select(chunk_id(F.col("doc_id"), F.col("grp")).alias("chunk_id"), "doc_id", en.alias("en"), ar.alias("ar"), "n_beads", "one_to_one_ratio")


def both_sides(chunks: DataFrame) -> DataFrame:
    """Chunks with text in both languages."""
    return chunks.filter((F.trim(F.coalesce("en", F.lit(""))) != "") & (F.trim(F.coalesce("ar", F.lit(""))) != ""))


def with_header(chunks: DataFrame, lang: str) -> Column:
    return F.concat_ws("\n", F.col("header"), F.col(lang))


def paragraphs(sentences: DataFrame) -> DataFrame:
    """(doc_id, lang, pid, first, text) of sentences (doc_id, lang, pid, pos, text): their texts in order, joined by a blank."""
    own = sentences.filter(F.coalesce("text", F.lit("")) != "").groupBy("doc_id", "lang", "pid").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("s"))
    return own.select("doc_id", "lang", "pid", "first", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


# --- repair and statistics ---------------------------------------------------------------------------------------


def audit_numbers(chunks: DataFrame, en: str = "en", normal_ar: str = "ar_normal") -> DataFrame:
    """(form, n): how the Arabic side (in normal form) writes each grouped number of the English side."""
    each = chunks.select(F.explode(numbers.english_numbers(F.coalesce(F.col(en), F.lit("")))).alias("x"), F.coalesce(F.col(normal_ar), F.lit("")).alias("t"))
    return each.select(numbers.written_as(F.col("x"), F.col("t")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def repair_numbers(chunks: DataFrame) -> DataFrame:
    """Chunks with ar repaired and numbers_corrected set; a chunk without one of its sides stays as it is."""
    fixed = F.when(F.col("en").isNotNull() & F.col("ar").isNotNull(), numbers.repair(F.col("en"), F.col("ar")))
    return chunks.withColumn("fixed", fixed).withColumns({"ar": F.coalesce("fixed.text", "ar"), "numbers_corrected": F.coalesce("fixed.n", F.lit(0))}).drop("fixed")


def truncation(chunks: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row: chunks over the limit, and on which side; NULL counts are not over it."""
    en, ar = (F.coalesce(F.col(c) > limit, F.lit(False)) for c in ("en_tokens", "ar_tokens"))
    return chunks.agg(F.count_if(en | ar).alias("total"), F.count_if(ar & ~en).alias("ar_only"), F.count_if(en & ~ar).alias("en_only"), F.count_if(en & ar).alias("both"))


def length_percentiles(chunks: DataFrame, by: list[str], column: str) -> DataFrame:
    """p50, p90, p99 (linear interpolation) and max of a whole-number column, from its value counts: bounded for groups of any size."""
    counts = chunks.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("times"))
    return counts.groupBy(*by).agg(*(F.round(F.expr(f"percentile(`{column}`, {p}, times)"), 4).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)), F.max(column).alias("max"))


def token_ratio(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Median and mean of Arabic to English tokens per chunk, where both are counted and English is not 0."""
    each = chunks.filter("en_tokens > 0 AND ar_tokens IS NOT NULL").select(*by, (F.col("ar_tokens") / F.col("en_tokens")).alias("r"))
    counts = each.groupBy(*by, "r").agg(F.count("*").alias("times"))
    return counts.groupBy(*by).agg(F.round(F.expr("percentile(r, 0.5, times)"), 6).alias("median"), F.round(F.sum(F.col("r") * F.col("times")) / F.sum("times"), 6).alias("mean"))


def keep_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted: a semi-join that writes the keys once and broadcasts them only if they are proven few."""
    return rows.join(small_or_not(wanted.select(key).distinct()), key, "left_semi")
