"""Which chunks questions are written from: content rules, and candidates in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, symbols
from ..functions import text as T

# Default rules for prose, and the shape of a line of a table of contents.
RULES = {"min_chars": 400, "min_one_to_one_ratio": 0.6, "min_letter_ratio": 0.6, "max_toc_line_ratio": 0.2, "min_paragraph_words": 25}
TOC_LINE = r"(?:\.\s*){2,}\d+\s*$|\s\.\s+\d+\s*$"


def is_content(rules: dict = RULES) -> Column:
    """Whether a chunk is prose that states facts, in both languages; NULLs are none."""
    en = F.coalesce("en", F.lit(""))
    lines = F.filter(F.split(en, "\n"), lambda x: F.trim(x) != "")
    letters = F.length(F.regexp_replace(en, r"[^\p{L}]", ""))
    toc = F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE))), F.size(lines))
    words = F.array_max(F.transform(lines, lambda x: F.size(F.split(F.trim(x), r"\s+"))))
    rule = (
        ~F.coalesce("truncated_e5", F.lit(False)) & (F.trim(F.coalesce("ar", F.lit(""))) != "") & (F.length(en) >= rules["min_chars"]) & (F.col("one_to_one_ratio") >= rules["min_one_to_one_ratio"])
        & (F.try_divide(letters, F.length(en)) >= rules["min_letter_ratio"]) & (toc <= rules["max_toc_line_ratio"]) & (words >= rules["min_paragraph_words"])
    )
    return F.coalesce(rule, F.lit(False))


def _order(seed: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *what), 256)


def _one_per(df: DataFrame, by: str, seed: str, *what: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(_order(seed, *map(F.col, what)), *what)
    return df.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def single_candidates(chunks: DataFrame, seed: str, rules: dict = RULES, numeric: bool = False) -> DataFrame:
    """(doc_id, chunk_id, place): one content chunk a document, documents in hash order.

    With `numeric`, only chunks with a grouped number whose Arabic form was repaired.
    """
    own = chunks.filter(is_content(rules))
    if numeric:
        own = own.filter((F.coalesce("numbers_corrected", F.lit(0)) > 0) & numbers.has_thousands(F.col("en")))
    picked = _one_per(own.select("doc_id", "chunk_id").distinct(), "doc_id", seed, "chunk_id")
    return picked.withColumn("place", _order(seed, F.col("doc_id")))


def subject_term(keyword: Column) -> Column:
    """A subject heading without its subdivision and without a qualifier in brackets."""
    return F.trim(F.regexp_replace(F.substring_index(keyword, "--", 1), r"\s*\([^)]*\)", ""))


def comparison_options(chunks: DataFrame, most_docs: int = 20, rules: dict = RULES) -> DataFrame:
    """(term, n_docs, doc_id, chunk_id): content chunks that mention a subject term their document shares with 1 to most_docs - 1 others."""
    terms = chunks.select("doc_id", F.explode("keywords").alias("k")).select("doc_id", subject_term(F.col("k")).alias("term")).filter("term <> ''").distinct()
    shared = terms.groupBy("term").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs").between(2, most_docs))
    content = chunks.filter(is_content(rules)).select("doc_id", "chunk_id", T.tokens(F.col("en"), "en").alias("tokens")).dropDuplicates(["chunk_id"])
    named = terms.join(shared, "term").select("term", "n_docs", "doc_id", T.tokens(F.col("term"), "en").alias("needle"))
    return content.join(named, "doc_id").filter(T.contains_span(F.col("tokens"), F.col("needle"))).select("term", "n_docs", "doc_id", "chunk_id")


def comparison_pairs(options: DataFrame, seed: str) -> DataFrame:
    """(term, doc_1, chunk_1, doc_2, chunk_2): pairs of documents that share a term, each document at most once.

    Rarer terms come first, then the hash order of the documents.  Which pairs stand depends on those before, so pairs
    are chosen in rounds: of all that are left, those that come first for both of their documents; then their
    documents go.  The result is that of taking them one by one.
    """
    from .lineage import materialize

    one = options.groupBy("term", "n_docs", "doc_id").agg(F.min_by("chunk_id", _order(seed, F.col("chunk_id"))).alias("chunk_id"))
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, "term").filter("a.doc_id < b.doc_id").select(
        "term", "a.n_docs", F.col("a.doc_id").alias("doc_1"), F.col("a.chunk_id").alias("chunk_1"), F.col("b.doc_id").alias("doc_2"), F.col("b.chunk_id").alias("chunk_2")
    )  # a term has at most most_docs documents
    left = materialize(pairs.withColumn("key", F.struct("n_docs", "term", _order(seed, F.col("doc_1"), F.col("doc_2")).alias("o"))))
    chosen = None
    while not left.isEmpty():
        ends = left.select(F.col("doc_1").alias("d"), "key").unionByName(left.select(F.col("doc_2").alias("d"), "key")).groupBy("d").agg(F.min("key").alias("best"))
        won = left.join(ends.select(F.col("d").alias("doc_1"), F.col("best").alias("b1")), "doc_1").join(ends.select(F.col("d").alias("doc_2"), F.col("best").alias("b2")), "doc_2").filter("key = b1 AND key = b2")
        won = materialize(won.select("term", "doc_1", "chunk_1", "doc_2", "chunk_2"))
        gone = won.select(F.col("doc_1").alias("d")).union(won.select("doc_2"))
        left = materialize(left.join(gone.select(F.col("d").alias("doc_1")), "doc_1", "left_anti").join(gone.select(F.col("d").alias("doc_2")), "doc_2", "left_anti").select(*left.columns))
        chosen = won if chosen is None else chosen.unionByName(won)
    return chosen if chosen is not None else pairs.select("term", "doc_1", "chunk_1", "doc_2", "chunk_2")


def bridge_candidates(chunks: DataFrame, seed: str, options: int = 5, rules: dict = RULES) -> DataFrame:
    """(doc_a, chunk_a, symbol, doc_b, chunk_b): a content chunk that cites another document, and one of that document's first content chunks.

    One citation for each citing document, in hash order.
    """
    content = chunks.filter(is_content(rules)).select("doc_id", "chunk_id", "en").dropDuplicates(["chunk_id"])
    docs = content.select("doc_id").distinct().withColumn("key", symbols.doc_key(F.col("doc_id")))
    cites = content.select(F.col("doc_id").alias("doc_a"), F.col("chunk_id").alias("chunk_a"), F.explode(symbols.references(F.col("en"))).alias("symbol")).withColumn("key", symbols.symbol_key(F.col("symbol")))
    linked = cites.join(docs.select(F.col("doc_id").alias("doc_b"), "key"), "key").filter("doc_a <> doc_b").drop("key")
    first = _one_per(linked, "doc_a", seed, "chunk_a", "symbol", "doc_b")
    w = W.partitionBy("doc_id").orderBy("chunk_id")
    early = content.select("doc_id", "chunk_id").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= options)
    target = _one_per(early.select(F.col("doc_id").alias("doc_b"), F.col("chunk_id").alias("chunk_b")), "doc_b", seed, "chunk_b")
    return first.join(target, "doc_b").select("doc_a", "chunk_a", "symbol", "doc_b", "chunk_b")
