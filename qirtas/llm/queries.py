"""The registered queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import ship
from ..plans import sqltext as S
from . import budget, canon, encode, groups, leakage, neardup, pairs, pii, splitting


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(*pairs.question_pairs(_read(spark, folder, "generation"), _read(spark, folder, "questions")))


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    return p1_found(spark, folder).groupBy("tbl", "lang", "defect").agg(F.count("*").alias("n"))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return budget.token_counts(budget.corpus_texts(_read(spark, folder, "documents"), _read(spark, folder, "chunks")), budget.KEYS)


def p2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each text: both sides of each chunk, and each document."""
    return _counts(spark, folder)


def p2_slice_totals(spark: SparkSession, folder: str) -> DataFrame:
    return budget.slice_totals(_counts(spark, folder))


def p2_slice_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return budget.slice_ratios(_counts(spark, folder), _read(spark, folder, "stats"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_read(spark, folder, "sentences"), _read(spark, folder, "beads"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # An item over its limit has a first piece: one row an item, without a shuffle.
    return p3_pieces(spark, folder).filter("piece_no = 0").select("unit", "doc_id", "lang", "item_key")


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _read(spark, folder, "chunks")
    return chunks.select(F.col("chunk_id").alias("id"), F.lit("en").alias("lang"), F.col("en").alias("text")).unionAll(chunks.select("chunk_id", F.lit("ar"), "ar"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.pairs_of_ids(*neardup.near_duplicates(_chunk_texts(spark, folder))).select(F.col("id_1").alias("chunk_id_1"), F.col("id_2").alias("chunk_id_2"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk and language: its class of equal texts, how many share it, and the group of near classes."""
    own = neardup.classes(*neardup.near_groups(_chunk_texts(spark, folder)))
    return own.withColumnRenamed("id", "chunk_id").withColumns({"class": F.hex("class"), "near": F.hex("near")})


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk: the group of chunks it is near to, in either language, directly or through others."""
    members, links = neardup.near_groups(_chunk_texts(spark, folder))
    first = members.groupBy("class").agg(F.min("id").alias("rep"))
    star = members.join(first, "class").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    ends = links.join(first.select(F.col("class").alias("class_1"), F.col("rep").alias("a")), "class_1").join(first.select(F.col("class").alias("class_2"), F.col("rep").alias("b")), "class_2")
    return groups.connected(star.unionByName(ends.select("a", "b"))).select(F.col("node").alias("chunk_id"), F.col("label").alias("group_id"))


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct value in its consistent form, with what it was found to be."""
    stored = canon.stored_values(_read(spark, folder, "generation"), _read(spark, folder, "questions"), _read(spark, folder, "chunks"))
    return canon.canonicalize(stored, ["tbl", "record_id", "lang"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_values(spark, folder).filter("changed").select("tbl", "record_id", "lang").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.connected(groups.question_links(_read(spark, folder, "questions"))).select(F.col("node").alias("chunk_id"), F.col("label").alias("group_id"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(_read(spark, folder, "documents"))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an item within the error budget: the edits of the closest, and the longest run of words they share."""
    return leakage.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    # Of the verified passages, those that stand there word for word.
    return p8_leaks(spark, folder).filter((F.col("n_edits") == 0) & (F.col("n_words") >= leakage.WORDS)).select("doc_id", "item_id")


def p8_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an item with edits, and none without."""
    return p8_leaks(spark, folder).filter("n_edits > 0").select("doc_id", "item_id", "n_edits")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each test item, in how many documents it stands; 0 for those that did not leak, NULL for those too short to hold a passage."""
    items = _read(spark, folder, "eval_items").groupBy("item_id", "suite", "kind").agg(F.max(leakage.has_passage(F.col("text"))).alias("checked"))
    hits = p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", "kind", F.when(F.col("checked"), F.coalesce("n", F.lit(0))).alias("n_documents"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    return pii.personal_information(documents, pii.fit(documents))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found_pieces(_marked(spark, folder))


def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redact(_marked(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p2_token_counts, p2_slice_totals, p2_slice_ratios, p3_found, p3_pieces, p4_found, p4_classes, p4_groups, p5_found, p5_values, p6_found, p7_ids, p8_found, p8_leaks, p8_edited, p8_items, p9_found, p9_texts)}

P3_FOUND_SQL = """
WITH newest AS (
  SELECT s.doc_id, s.lang, s.sid, max(length(s.text)) AS n FROM sentences s
  JOIN (SELECT doc_id, lang, sid, max(ingested_at) AS t FROM sentences GROUP BY ALL) m ON s.doc_id = m.doc_id AND s.lang = m.lang AND s.sid = m.sid AND s.ingested_at = m.t GROUP BY ALL),
b AS (SELECT DISTINCT doc_id, bead_no, en, ar, coalesce(paragraph_end, false) AS pe FROM beads),
r AS (SELECT *, min(CASE WHEN pe THEN bead_no END) OVER (PARTITION BY doc_id ORDER BY bead_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run_end FROM b),
x AS (SELECT doc_id, 'en' AS lang, run_end, unnest(en) AS sid FROM r UNION ALL SELECT doc_id, 'ar', run_end, unnest(ar) FROM r)
SELECT 'sentence' AS unit, doc_id, lang, sid AS item_key FROM newest WHERE n > 800
UNION ALL
SELECT 'run', x.doc_id, x.lang, CAST(x.run_end AS VARCHAR) FROM x JOIN newest w ON x.doc_id = w.doc_id AND x.lang = w.lang AND x.sid = w.sid
WHERE w.n > 0 AND x.run_end IS NOT NULL GROUP BY ALL HAVING sum(w.n) + count(*) - 1 > 2000
"""

P6_FOUND_SQL = """
WITH RECURSIVE q AS (SELECT DISTINCT gold_chunks AS g, relevant_groups AS r FROM questions),
p AS (SELECT g, r, unnest(range(1, greatest(coalesce(len(g), 0), coalesce(len(r), 0)) + 1)) AS i FROM q),
m AS (SELECT list_filter(list_concat([g[i]], coalesce(r[i], [])), lambda x: x IS NOT NULL) AS c FROM p),
e AS (SELECT DISTINCT list_min(c) AS a, unnest(c) AS b FROM m WHERE len(c) > 0),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, label) AS (SELECT a, a FROM both_ways UNION SELECT both_ways.b, reach.label FROM reach JOIN both_ways ON reach.node = both_ways.a WHERE both_ways.b >= reach.label)
SELECT node AS chunk_id, min(label) AS group_id FROM reach GROUP BY node
"""


P4_FOUND_SQL = "WITH " + ", ".join(
    f"""{x} AS (SELECT chunk_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) <= 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS s
  FROM (SELECT DISTINCT chunk_id, {S.tokens(x, x)} AS t FROM chunks)), u{x} AS (SELECT chunk_id, len(s) AS n, unnest(s) AS x FROM {x}),
j{x} AS (SELECT a.chunk_id AS chunk_id_1, b.chunk_id AS chunk_id_2, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM u{x} a JOIN u{x} b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL)"""
    for x in ("en", "ar")
) + " SELECT chunk_id_1, chunk_id_2 FROM jen WHERE k / (m + n - k) >= 0.8 UNION SELECT chunk_id_1, chunk_id_2 FROM jar WHERE k / (m + n - k) >= 0.8"

P4_GROUPS_SQL = f"""
WITH RECURSIVE p AS MATERIALIZED ({P4_FOUND_SQL}), n AS (SELECT DISTINCT chunk_id FROM chunks WHERE len({S.tokens('en', 'en')}) > 0 OR len({S.tokens('ar', 'ar')}) > 0),
e AS (SELECT chunk_id_1 AS a, chunk_id_2 AS b FROM p UNION SELECT chunk_id_2, chunk_id_1 FROM p),
reach(node, label) AS (SELECT chunk_id, chunk_id FROM n UNION SELECT e.b, reach.label FROM reach JOIN e ON reach.node = e.a WHERE e.b >= reach.label)
SELECT node AS chunk_id, min(label) AS group_id FROM reach GROUP BY node
"""

_LATIN, _OTHER = "A-Za-z\\x{c0}-\\x{24f}", "\\x{370}-\\x{52f}"
_HIDDEN = "\\x{ad}\\x{34f}\\x{61c}\\x{180b}-\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{feff}"
_FORMS = "\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\x{ff01}-\\x{ffee}\\x{fb00}-\\x{fb4f}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{fefc}\\x{2160}-\\x{217f}"
P5_FOUND_SQL = f"""
WITH v AS (SELECT 'generation' AS tbl, CAST(gen_id AS VARCHAR) AS record_id, lang, answer AS x FROM generation UNION ALL SELECT 'questions', qid, 'en', answer.en FROM questions
  UNION ALL SELECT 'questions', qid, 'ar', answer.ar FROM questions UNION ALL SELECT 'chunks', chunk_id, 'ar', ar FROM chunks)
SELECT DISTINCT tbl, record_id, lang FROM v WHERE regexp_matches(x, '[{_HIDDEN}{_FORMS}{canon.PERSIAN_FROM}]') OR length(nfc_normalize(x)) <> length(x)
  OR regexp_matches(x, '[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]') OR regexp_matches(x, '(^|[^\\p{{L}}\\p{{M}}])[{canon.LOOKALIKES_FROM}]+($|[^\\p{{L}}\\p{{M}}])')
"""


def _words(expr: str) -> str:
    bare = f"regexp_replace(lower({expr}), '[\\x{{64b}}-\\x{{65f}}\\x{{670}}\\x{{640}}]', '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({bare}, '[\\s\\x{{a0}}\\x{{85}}]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


def _runs(table: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE text IS NOT NULL))"


P8_FOUND_SQL = f"SELECT DISTINCT d.doc_id, i.item_id FROM {_runs('documents', 'doc_id')} d JOIN {_runs('eval_items', 'item_id')} i USING (r)"
P8_ITEMS_SQL = f"""SELECT i.item_id, i.suite, i.kind, CASE WHEN i.checked THEN n_documents END AS n_documents FROM (SELECT i.item_id, i.suite, i.kind, i.checked, count(f.doc_id) AS n_documents
  FROM (SELECT item_id, suite, kind, max(len({_words('text')}) >= 12) AS checked FROM eval_items GROUP BY ALL) i LEFT JOIN ({P8_FOUND_SQL}) f USING (item_id) GROUP BY ALL) i"""

SQL = {"p3_found": P3_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p4_groups": P4_GROUPS_SQL, "p5_found": P5_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p8_found": P8_FOUND_SQL, "p8_items": P8_ITEMS_SQL}
