"""Lexical retrieval: analyzers, postings, BM25, top-k."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from .lineage import materialize

K1, B = 1.2, 0.75
ANALYZERS = ("raw", "norm", "light")
#: So many queries are searched for at a time, and fewer if they may have more results than BLOCK_RESULTS; this bounds what is broadcast and what a task holds.
BLOCK_QUERIES, BLOCK_RESULTS = 20_000, 500_000
#: Queries of a block that share a matrix have so many distinct terms at most; a matrix has so many cells.
MATRIX_TERMS, MATRIX_CELLS = 2_000, 4_000_000
#: Results found are brought down to the k best when there are so many.
HELD_RESULTS = 2_000_000
#: Distinct words whose stems a Python worker remembers.
STEMS = 200_000


def analyze(texts: DataFrame, analyzer: str, lang: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """`texts` with a column of tokens: raw (composed, lower case), norm (normal form), light (normal form, stemmed).

    A NULL text has no tokens.  The light form is taken in Arrow batches, once per distinct word that a worker remembers.
    """
    if analyzer not in ANALYZERS:
        raise ValueError(f"no analyzer {analyzer!r}")
    if lang not in T.LANGS:
        raise ValueError(f"no analyzer for language {lang!r}")
    value = F.coalesce(F.col(text), F.lit(""))
    if analyzer == "raw":
        return texts.withColumn(out, T.words(F.lower(T.unicode_form(value, "NFC"))))
    if analyzer == "norm":
        return texts.withColumn(out, T.tokens(value, lang))
    return texts.withColumn(out, _light(lang, _newer_letters(texts.sparkSession.sparkContext))(value))


# Words as they stand before Arabic marks are taken out: `\w` has just the letters, digits and underscores of `T.WORD`.
_WORDS = {"en": re.compile(r"\w+"), "ar": re.compile(r"[\w\u064b-\u065f\u0670]+")}


@functools.cache
def _newer_letters(context: SparkContext) -> str:
    """Letters and digits of Python's Unicode that the older one of the JVM, and so `T.words`, does not count as such."""
    known = "".join(x for x in map(chr, range(0x80, 0x110000)) if x.isalnum())
    return context._jvm.java.util.regex.Pattern.compile(r"[\p{L}\p{N}]").matcher(known).replaceAll("")


class _Stems(dict):
    """Stems of the lower-case words of a language asked for so far; of words that `newer` letters part, with blanks between."""

    def __init__(self, lang: str, newer: str):
        self.lang, self.parted = lang, False
        self.cut = re.compile(f"[{newer}]").split if newer else lambda word: [word]

    def stem(self, word: str) -> str:
        word = word if word.isascii() else word.translate(T.DIGIT_MAP)
        if self.lang == "ar":
            return stemming.light_arabic(T.fold_arabic(word))
        return word if word.isdecimal() else stemming.porter2(word)

    def __missing__(self, word: str) -> str:
        stem = self.stem(word) if word.isascii() else " ".join(filter(None, map(self.stem, self.cut(word))))
        self.parted |= " " in stem
        self[word] = stem
        return stem


_stems = functools.cache(_Stems)


def light_tokens(texts: pa.Array, lang: str, newer: str = "") -> pa.Array:
    """Stemmed words of the normal form of each text; letters of `newer` are none."""
    stems, find = _stems(lang, newer), _WORDS[lang].findall
    if len(stems) > STEMS:
        stems.clear()
    flat, ends = [], [0]
    for x in texts.to_pylist():
        words = list(map(stems.__getitem__, find((x if x.isascii() else unicodedata.normalize("NFKC", x)).lower())))
        flat.extend(" ".join(words).split() if stems.parted else filter(None, words))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


def _light(lang: str, newer: str):
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return light_tokens(texts, lang, newer)

    return run


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of documents (doc, tokens): in how many documents a term stands, and how often altogether."""
    places = docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return places.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top_k(scores: DataFrame, k: int, by: str = "qid", score: str = "score", item: str = "doc") -> DataFrame:
    """The k best per `by`, ranked from 1; ties go to the smaller item.  Fewer rows than k are all kept."""
    w = W.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score > 0) of documents (doc, tokens) for queries (qid, tokens), every pair, in joins and aggregates.

    A query term counts once.  Lengths average over all documents, also those without tokens; unknown terms and
    queries without terms give no rows.  Of a repeated document or query id, the caller keeps one row.

    Only occurrences of query terms are ever shuffled: the distinct terms prune the exploded tokens first, and
    one exchange by document serves both the term frequencies and the scores.
    """
    wanted = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    terms = wanted.select("term").distinct()
    sized = docs.select("doc", F.size("tokens").alias("dl"), "tokens")
    n, avgdl = sized.agg(F.count("*"), F.avg("dl")).first()
    places = sized.select("doc", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").repartition("doc")
    tf = places.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", _idf(F.lit(n), F.col("df")).alias("idf"))
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))
    weighted = tf.join(idf, "term").select("doc", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm) * F.col("idf")).alias("w"))
    return weighted.join(wanted, "term").groupBy("qid", "doc").agg(F.sum("w").alias("score"))


def _idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, block: int = BLOCK_QUERIES) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each query, by the scores of `bm25_scores`.

    The queries are the stated set: they go out in blocks of `block`.  The documents are analyzed once: what they hold of
    the block's terms is written as numbers, counted, and then scored (`_search`).  Only the k best of each task and
    query are shuffled, so that pairs of documents and queries never become rows.
    """
    spark = docs.sparkSession
    asked = materialize(queries.select("qid", F.array_sort(F.array_distinct("tokens")).alias("terms")).filter(F.size("terms") > 0))
    sized = docs.select("doc", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    doc_kind = docs.schema["doc"].dataType.simpleString()
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {doc_kind}, score double"
    out = None
    blocks = -(-asked.count() // max(1, min(block, BLOCK_RESULTS // k)))
    if blocks > 1:
        sized = materialize(sized)
    for i in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        rows = part.collect()  # about `block` short queries
        terms = sorted({t for r in rows for t in r.terms if t is not None})
        if not terms:
            continue
        coded = materialize(_coded(sized, terms, doc_kind))
        n, avgdl = coded.agg(F.count("*"), F.avg("dl")).first()
        if not avgdl:
            break
        found = coded.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        held = {r.term: (r.df, r.idf) for r in found.select("term", "df", _idf(F.lit(n), F.col("df")).alias("idf")).collect()}
        number = {terms[j]: j for j in held}
        weight = np.zeros(len(terms))
        weight[list(held)] = [idf for _, idf in held.values()]
        owners: dict[tuple, list] = {}
        for r in rows:
            # common terms first: queries in this order share the sums over them
            own = tuple(sorted((number[t] for t in r.terms if t in number), key=lambda j: (-held[j][0], j)))
            if own:
                owners.setdefault(own, []).append(r.qid)
        if owners:
            best = coded.mapInArrow(_search(spark, owners, {j: df for j, (df, _) in held.items()}, weight, avgdl, k, k1, b), kinds)
            out = best if out is None else out.unionByName(best)
    return top_k(spark.createDataFrame([], kinds) if out is None else out, k)


def _coded(sized: DataFrame, terms: list[str], doc_kind: str) -> DataFrame:
    """(doc, dl, terms, tfs) of documents (doc, tokens): length, and numbers and frequencies of those of `terms` they hold."""
    shared = sized.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            tokens = batch.column(1)
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            hit = found >= 0
            row = np.repeat(np.arange(len(length)), length)[hit]
            cell, tf = np.unique(row * len(known) + found[hit], return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(len(length) + 1) * len(known)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell % len(known), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length.astype(np.int32)), *lists], ["doc", "dl", "terms", "tfs"])

    return sized.mapInArrow(run, f"doc {doc_kind}, dl int, terms array<int>, tfs array<int>")


def _matrices(owned: list[tuple], df: dict[int, int]) -> list[tuple[np.ndarray, list]]:
    """Runs of the queries in order of their terms, each with few distinct terms: (terms, [(query, terms shared with the one before, places of its terms)])."""
    out: list[tuple[dict, list]] = []
    before: tuple = ()
    for q, own in sorted(enumerate(owned), key=lambda x: [(-df[j], j) for j in x[1]]):
        if not out or len(out[-1][0]) + sum(j not in out[-1][0] for j in own) > MATRIX_TERMS:
            out.append(({}, []))
            before = ()
        place, members = out[-1]
        same = next((d for d, (x, y) in enumerate(zip(before, own, strict=False)) if x != y), min(len(before), len(own)))
        members.append((q, same, [place.setdefault(j, len(place)) for j in own]))
        before = own
    return [(np.array(list(place), np.int64), members) for place, members in out]


def _search(spark, owners: dict[tuple, list], df: dict[int, int], weight: np.ndarray, avgdl: float, k: int, k1: float, b: float):
    """The Arrow function that gives the k best (qid, doc, score) of a task's coded documents, with those that rounding may tie with them.

    A batch becomes a small matrix of terms and documents.  A query's scores are the sum of its few rows, in order of how
    common the terms are; the next query goes on from the terms it shares with the one before.  Once k documents are
    known, only scores that reach the last of them are looked at.
    """
    shared = spark.sparkContext.broadcast((list(owners.values()), _matrices(list(owners), df), weight))

    def run(batches):
        qids, matrices, weight = shared.value
        step = MATRIX_CELLS // max(len(its) for its, _ in matrices)
        best = None
        for whole in batches:
            best = best or _Best(len(qids), k, whole.column(0).slice(0, 0))
            whole = whole.take(pc.sort_indices(whole.column(0)))
            for at in range(0, whole.num_rows, max(1, step)):
                batch = whole.slice(at, max(1, step))
                n, dl = batch.num_rows, batch.column(1).to_numpy()
                row = np.repeat(np.arange(n), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
                term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl)) * weight[term]
                for its, members in matrices:
                    place = np.full(len(weight), -1)
                    place[its] = np.arange(len(its))
                    line = place[term]
                    inside = line >= 0
                    matrix = np.zeros((len(its), n))
                    matrix[line[inside], row[inside]] = value[inside]
                    lines, sums = list(matrix), list(np.zeros((1 + max(len(own) for _, _, own in members), n)))
                    for q, same, own in members:
                        for d in range(same, len(own)):
                            np.add(sums[d], lines[own[d]], out=sums[d + 1])
                        best.offer(q, sums[len(own)], batch.column(0))
                best.settle(batch.column(0))
        if best is not None and len(best.query):
            each = np.array([len(x) for x in qids])
            start = np.cumsum(each) - each
            times = each[best.query]
            owner = np.repeat(start[best.query] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row = np.repeat(np.arange(len(times)), times)
            flat = pa.array([x for own in qids for x in own])
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(owner)), best.names.take(pa.array(best.doc[row])), pa.array(best.score[row])], ["qid", "doc", "score"])

    return run


class _Best:
    """The k best documents of each query so far: arrays `query`, `score` and `doc` (places in `names`)."""

    LEAST = 5e-324

    def __init__(self, queries: int, k: int, names: pa.Array):
        self.queries, self.k, self.names = queries, k, names
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.limit = [self.LEAST] * queries  # what a score must reach
        self.offered, self.waiting = [], 0

    def offer(self, q: int, score: np.ndarray, docs: pa.Array) -> None:
        """The scores of a query over documents in their order; those of 0 are none."""
        limit, k = self.limit[q], self.k
        if limit == self.LEAST and len(score) >= 8 * k:
            # of the best of each of 4 k groups, k reach the k-th: so do k documents
            width = len(score) // (4 * k)
            tops = score[: 4 * k * width].reshape(4 * k, width).max(axis=1)
            limit = max(limit, np.partition(tops, 3 * k)[3 * k] - 2e-9)
        hit = np.flatnonzero(score >= limit)
        if not len(hit):
            return
        if len(hit) > 4 * k:
            hit = hit[_kept(np.zeros(len(hit), np.int64), score[hit], hit, 1, k)[0]]
        self.offered.append((q, score[hit], hit))
        self.waiting += len(hit)
        if self.waiting > HELD_RESULTS:
            self.settle(docs)

    def settle(self, docs: pa.Array) -> None:
        """Bring what was offered of `docs` and what was held down to the k best."""
        if not self.offered:
            return
        times = [len(x[2]) for x in self.offered]
        query = np.concatenate([self.query, np.repeat([x[0] for x in self.offered], times)])
        score = np.concatenate([self.score, *(x[1] for x in self.offered)])
        doc = np.concatenate([self.doc, *(x[2] + len(self.names) for x in self.offered)])
        self.offered, self.waiting = [], 0
        names = pa.concat_arrays([self.names, docs])
        rank = pc.rank(names, "ascending", tiebreaker="dense").to_numpy()
        kept, last = _kept(query, score, rank[doc], self.queries, self.k)
        self.query, self.score = query[kept], score[kept]
        used, self.doc = np.unique(doc[kept], return_inverse=True)
        self.names = names.take(pa.array(used))
        self.limit = np.maximum((last - 1) * 1e-9, self.LEAST).tolist()


def _kept(query: np.ndarray, score: np.ndarray, rank: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each query by score to nine digits, then rank, and each query's k-th such score in billionths.

    Scores that stand so near the middle between two that rounding may go either way are not counted, and kept if they
    may reach the k-th: what is kept always holds the k that `top_k` takes.
    """
    scaled = score * 1e9
    whole = np.floor(scaled + 0.5)
    sure = np.abs(scaled + 0.5 - np.rint(scaled + 0.5)) > 1e-3
    counted = np.flatnonzero(sure)
    order = counted[np.lexsort((rank[counted], -whole[counted], query[counted]))]
    own, at = query[order], np.arange(len(order))
    place = at - np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0)) if len(order) else at
    last = np.full(queries, -np.inf)
    last[own[place == k - 1]] = whole[order[place == k - 1]]
    return np.concatenate([order[place < k], np.flatnonzero(~sure & (whole + 1 >= last[query]))]), last


def every(df: DataFrame, number: Column, step: int = 20) -> DataFrame:
    """The stated query set of searches: rows whose number is divisible by `step`."""
    return df.filter(F.pmod(number, F.lit(step)) == 0)
