"""The passages an answering model sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5


def _order(seed: str, *what: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *what), 256)


def closed_book(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.array().cast("array<string>").alias("context_ids"))


def rag_context(run: DataFrame, k: int = K) -> DataFrame:
    """(qid, context_ids): the first k of each ranking (qid, doc, rank), in order."""
    top = run.filter(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc"))).alias("r"))
    return top.select("qid", F.transform("r", lambda x: x["doc"]).alias("context_ids"))


def oracle_context(questions: DataFrame, pool: DataFrame, k: int = K, seed: str = "0") -> DataFrame:
    """(qid, context_ids): the gold chunks and k - n others from the pool (doc) that no relevance group names, shuffled by hash.

    A question with more than k gold chunks fails.  Distractors are drawn without pairing questions with the pool: the
    pool stands in hash order on a ring, a question begins at its own place, and as many chunks are offered as it can
    have to refuse; they are joined by their numbers.  A pool that is too small gives shorter contexts.
    """
    gold = questions.select("qid", F.array_distinct(F.coalesce("gold_chunks", F.array().cast("array<string>"))).alias("gold"), F.coalesce("relevant_groups", F.array().cast("array<array<string>>")).alias("groups"))
    gold = gold.withColumn("gold", F.when(F.size("gold") <= k, F.col("gold")).otherwise(F.raise_error(F.concat(F.col("qid"), F.lit(": its gold chunks do not fit in the context")).cast("string")).cast("array<string>")))
    gold = gold.withColumn("barred", F.array_distinct(F.array_compact(F.concat("gold", F.flatten(F.transform("groups", lambda g: F.coalesce(g, F.array().cast("array<string>"))))))))
    numbered = _numbered(pool.select("doc").filter("doc IS NOT NULL").distinct(), seed)
    size = pool.select("doc").filter("doc IS NOT NULL").distinct().count()
    if not size:
        return gold.select("qid", F.col("gold").alias("context_ids"))
    start = F.pmod(F.conv(F.substring(_order(seed, F.lit("start"), "qid"), 1, 12), 16, 10).cast("bigint"), F.lit(size))
    wanted = F.least(F.size("barred") + k, F.lit(size))
    offers = gold.select("qid", "barred", start.alias("s"), F.explode(F.sequence(F.lit(0), wanted - 1)).alias("i")).select("qid", "barred", "i", F.pmod(F.col("s") + F.col("i"), F.lit(size)).alias("number"))
    free = offers.join(numbered, "number").filter(~F.array_contains("barred", F.col("doc"))).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "doc"))).alias("f"))
    both = gold.join(free, "qid", "left")
    fill = F.transform(F.slice(F.coalesce("f", F.array().cast("array<struct<i:int,doc:string>>")), F.lit(1), F.lit(k) - F.size("gold")), lambda x: x["doc"])
    mixed = F.array_sort(F.transform(F.concat("gold", fill), lambda d: F.struct(_order(seed, F.lit("mix"), F.col("qid"), d).alias("o"), d.alias("d"))))
    return both.select("qid", F.transform(mixed, lambda x: x["d"]).alias("context_ids"))


def _numbered(pool: DataFrame, seed: str) -> DataFrame:
    """(doc, number): the pool in hash order, numbered from 0 in two steps: within hash ranges, then by what stands before them."""
    keyed = pool.withColumn("o", _order(seed, F.lit("pool"), "doc")).withColumn("r", F.conv(F.substring("o", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("r").agg(F.count("*").alias("n"))  # at most 4096 rows
    before = sizes.select("r", (F.sum("n").over(W.orderBy("r")) - F.col("n")).alias("before"))
    w = W.partitionBy("r").orderBy("o", "doc")
    return keyed.withColumn("at", F.row_number().over(w)).join(before, "r").select("doc", (F.col("before") + F.col("at") - 1).alias("number"))


def gold_positions(contexts: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, grp, position): place of each group's first member in the context, from 1; NULL if it is not there."""
    places = contexts.select("qid", F.posexplode("context_ids").alias("i", "doc")).groupBy("qid", "doc").agg((F.min("i") + 1).alias("p"))
    return qrels.join(contexts.select("qid"), "qid", "left_semi").join(places, ["qid", "doc"], "left").groupBy("qid", "grp").agg(F.min("p").alias("position"))


def retrieved_all(positions: DataFrame) -> DataFrame:
    """(qid, retrieved): whether every group of a question is in its context."""
    return positions.groupBy("qid").agg(F.bool_and(F.col("position").isNotNull()).alias("retrieved"))


def passages_of(contexts: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    """(qid, passages): the texts of each context in its order, from a corpus (chunk_id, text column) that may be another than the context's own.

    Chunks the corpus lacks are left out; an empty context has no passages; of a repeated chunk_id the larger text counts.
    """
    one = chunks.groupBy("chunk_id").agg(F.max(text).alias("_text"))
    placed = contexts.select("qid", F.posexplode_outer("context_ids").alias("i", "chunk_id")).join(one, "chunk_id", "left")
    own = placed.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("i", "_text")))).alias("p"))
    return own.select("qid", F.transform("p", lambda x: x["_text"]).alias("passages"))


def format_passages(texts: Column) -> Column:
    """Passages of an array of texts, numbered and fenced, a blank line between them."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(":\n<<<\n"), t, F.lit("\n>>>"))), "\n\n")


def render(template: str, **values: Column) -> Column:
    """A template with $name and ${name} filled in; a name without value fails, "$$" is a dollar sign."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit("$") if m[1] else values[m[2] or m[3]])
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
