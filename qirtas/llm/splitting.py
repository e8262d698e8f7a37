"""Cutting oversized items at natural boundaries (problem 3).

A text is cut by one bounded regular expression: its alternatives, ordered by
how strong the boundary is, each consume as much as the limit allows, and the
last one falls back to characters.  The overlap is looked back for in the piece
before.  Everything stays in built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import drop_table, materialize, small_or_not

SENTENCE_LIMIT, RUN_LIMIT, OVERLAP = 800, 2000, 80
#: Beads are put in order in groups of so many bead numbers, never a whole document at once.
BUCKET = 4096

# Where a text may be cut, the strongest boundary first.
BOUNDARIES = (r"(?<=\n)", r"(?<=[.!?؟…][\"'”’»)\]]{0,2}\s)", r"(?<=[;:؛]\s)", r"(?<=[,،)–—]\s)", r"(?<=\s)", r"(?!\p{M})")


def pattern(limit: int, overlap: int) -> str:
    """The expression whose matches are the pieces' own parts, each at most limit - overlap code points.

    A boundary in the second half of what the limit allows comes first, so that pieces do not get needlessly short; then
    any other, so that characters are cut only inside a run that does not fit whole.
    """
    most = limit - overlap
    if overlap < 0 or most < 2:
        raise ValueError("the limit must exceed the overlap by two at least")
    least = max(1, most // 2)
    return "(?s)" + "|".join([rf".{{1,{most}}}\z", *(rf".{{{n},{most}}}{b}" for n in (least, 1) for b in BOUNDARIES[:-1]), rf".{{{least},{most}}}{BOUNDARIES[-1]}", rf".{{1,{most}}}"])


def parts(text: Column, limit: int, overlap: int = OVERLAP) -> Column:
    """Array of (overlap, part): joined, the parts are the text; overlap with part is a piece within the limit.

    The overlap is the end of the part before, from the first word that begins in its last `overlap` code points (or
    just those, if none does).  NULL gives NULL, the empty text no parts; lengths count code points.
    """
    own = F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0))
    if overlap == 0:
        return F.transform(own, lambda x: F.struct(F.lit("").alias("overlap"), x.alias("part")))

    def tail(x: Column) -> Column:
        word = F.regexp_extract(F.right(x, F.lit(overlap + 1)), r"(?s)\s(\S.*)\z", 1)
        return F.when(word != "", word).otherwise(F.right(x, F.lit(overlap)))

    return F.transform(own, lambda x, i: F.struct(F.when(i == 0, "").otherwise(tail(F.get(own, i - 1))).alias("overlap"), x.alias("part")))


def split(items: DataFrame, keys: list[str], limit: int, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """(keys, piece_no, overlap_chars, piece) of the items longer than `limit`; shorter, empty and NULL ones give no rows.

    piece_no counts from 0.  Repeated items give repeated pieces.
    """
    own = items.filter(F.length(text) > limit).select(*keys, F.posexplode(parts(F.col(text), limit, overlap)).alias("piece_no", "p"))
    return own.select(*keys, "piece_no", F.length("p.overlap").alias("overlap_chars"), F.concat("p.overlap", "p.part").alias("piece"))


def run_ends(beads: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The beads (doc_id, bead_no, en, ar) with run_end: the number of the bead that closes their run.

    Of beads of one number the newest counts (of those, the one that closes, if any).  NULL paragraph_end counts as
    false, beads without number or document are left out, and those that no later bead closes belong to no run.

    Bead numbers are put in order in buckets; what closes a bucket's last run is looked up among the buckets.
    """
    one = beads.filter("doc_id IS NOT NULL AND bead_no IS NOT NULL").select(
        "doc_id", F.floor(F.col("bead_no") / bucket).cast("bigint").alias("bucket"), "bead_no", "en", "ar", F.coalesce("paragraph_end", F.lit(False)).alias("ends"), "ingested_at"
    )
    same = W.partitionBy("doc_id", "bucket").orderBy("bead_no", F.desc("ingested_at"), F.desc("ends"), F.xxhash64("en", "ar"))
    one = one.withColumn("before", F.lag("bead_no").over(same)).filter(F.col("before").isNull() | (F.col("before") != F.col("bead_no")))
    on = W.partitionBy("doc_id", "bucket").orderBy("bead_no").rowsBetween(0, W.unboundedFollowing)
    one = one.withColumn("near", F.min(F.when(F.col("ends"), F.col("bead_no"))).over(on))
    later = W.partitionBy("doc_id").orderBy("bucket").rowsBetween(1, W.unboundedFollowing)
    first = one.groupBy("doc_id", "bucket").agg(F.min(F.when(F.col("ends"), F.col("bead_no"))).alias("first"))
    first = first.select("doc_id", "bucket", F.min("first").over(later).alias("far")).filter("far IS NOT NULL")
    return one.join(first, ["doc_id", "bucket"], "left").select("doc_id", "bead_no", "en", "ar", F.coalesce("near", "far").alias("run_end")).filter("run_end IS NOT NULL")


def oversized_items(sentences: DataFrame, beads: DataFrame, sentence_limit: int = SENTENCE_LIMIT, run_limit: int = RUN_LIMIT, used: list[DataFrame] | None = None) -> DataFrame:
    """(unit, doc_id, lang, item_key, text) of the sentences and runs of sentences over their limit.

    Of each (doc_id, lang, sid) the version with the newest ingested_at counts (NULL is oldest; of equal ones the
    longest).  A run is what `run_ends` gives; its texts stand in bead and array order, NULL and '' left out, joined by
    a space; sids without sentence and NULL sids are passed over.

    Lengths travel first; only the texts of oversized items are ever moved.  An item is one value, so a run's texts meet
    in one task, however long the run is.  Tables written on the way are added to `used`, for the caller to remove.
    """
    keys = ["doc_id", "lang", "sid"]
    version = F.struct("ingested_at", F.length("text").alias("n"), F.xxhash64("text").alias("mark"))
    newest = sentences.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND sid IS NOT NULL").groupBy(*keys).agg(F.max(version).alias("v")).filter("v.n > 0")
    newest = materialize(newest.select(*keys, "v.ingested_at", "v.n", "v.mark"))
    ends = materialize(run_ends(beads))

    def named(by: DataFrame) -> DataFrame:
        sides = [by.select("doc_id", F.lit(x).alias("lang"), "run_end", "bead_no", F.posexplode(x).alias("at", "sid")) for x in ("en", "ar")]
        return sides[0].unionByName(sides[1]).filter("sid IS NOT NULL")

    totals = named(ends).join(newest.select(*keys, "n"), keys).groupBy("doc_id", "lang", "run_end").agg((F.sum("n") + F.count("*") - 1).alias("total"))
    long_runs = materialize(totals.filter(F.col("total") > run_limit).select("doc_id", "lang", "run_end"))
    long = small_or_not(long_runs)
    members = materialize(named(ends).join(long, ["doc_id", "lang", "run_end"]).join(newest, keys).select(*keys, "run_end", "bead_no", "at", "ingested_at", "n", "mark"))
    long_sentences = newest.filter(F.col("n") > sentence_limit).select(*keys, "ingested_at", "n", "mark")
    wanted = materialize(long_sentences.unionByName(members.select(*keys, "ingested_at", "n", "mark")).distinct())
    v = wanted.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), F.col("sid").alias("s"), F.col("ingested_at").alias("t"), F.col("n").alias("m"), F.col("mark").alias("k"))
    found = sentences.join(
        small_or_not(v),
        (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")) & (F.col("sid") == F.col("s")) & F.col("ingested_at").eqNullSafe(F.col("t")) & (F.length("text") == F.col("m")) & (F.xxhash64("text") == F.col("k")),
    ).select(*keys, "text")
    texts = materialize(found.dropDuplicates(keys))
    alone = texts.filter(F.length("text") > sentence_limit).select(F.lit("sentence").alias("unit"), "doc_id", "lang", F.col("sid").alias("item_key"), "text")
    runs = members.select(*keys, "run_end", "bead_no", "at").join(texts, keys).groupBy("doc_id", "lang", "run_end").agg(F.sort_array(F.collect_list(F.struct("bead_no", "at", "text"))).alias("s"))
    joined = runs.select(F.lit("run").alias("unit"), "doc_id", "lang", F.col("run_end").cast("string").alias("item_key"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
    if used is not None:
        used += [newest, ends, long_runs, members, wanted, texts]
    return alone.unionByName(joined)


def split_oversized(sentences: DataFrame, beads: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(unit, doc_id, lang, item_key, piece_no, overlap_chars, piece) of every oversized sentence and run."""
    used: list[DataFrame] = []
    items = materialize(oversized_items(sentences, beads, used=used))
    drop_table(*used)
    keys = ["unit", "doc_id", "lang", "item_key"]
    return split(items.filter("unit = 'sentence'"), keys, SENTENCE_LIMIT, overlap).unionByName(split(items.filter("unit = 'run'"), keys, RUN_LIMIT, overlap))
