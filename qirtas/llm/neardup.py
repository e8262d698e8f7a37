"""Near-duplicate texts across a collection (problem 4).

MinHash samples are cut into bands; texts that share a band are candidates.
The samples are also folded into an odd sketch, a parity bitmap: the number of
ones in the XOR of two sketches estimates a high similarity closely, and sorts
out candidates that are far below the threshold.  What is left is checked
exactly on the shingles.  Copies of one text are one class throughout.

Bands and classes belong to one language.  Groups are found without pairing the
members of a band: each band is a star around its smallest class, and only what
the verified stars leave apart is compared further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import drop_table, materialize, small_or_not, spread
from . import flat
from .groups import connected
from .shingles import shingles

SIMILARITY = 0.8
#: 20 bands of 4 samples: a pair at similarity 0.8 is missed with a chance of 3e-5, at 0.85 of 4e-7.
BANDS, BAND_ROWS = 20, 4
SKETCH_BITS = 256
#: The sketch may estimate this much below the threshold (five standard deviations) before a candidate is dropped.
MARGIN = 0.25
#: Members of a band meet in blocks of about so many, so that no task pairs a whole band.
BLOCK = 512

SAMPLES = BANDS * BAND_ROWS
_rng = np.random.default_rng(20240607)
_ODD = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def signatures(value: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, odd sketches) of rows given by their distinct shingle hashes; every row has at least one."""
    rows = len(before) - 1
    low = (value >> np.uint64(32)).astype(np.uint32)
    at = before[:-1]
    buffer = np.empty_like(low)
    bands = np.zeros((rows, BANDS), np.uint64)
    sketch = np.zeros((rows, SKETCH_BITS // 64), np.uint64)
    every = np.arange(rows)
    for j in range(SAMPLES):
        np.multiply(low, _ODD[j], out=buffer)
        np.add(buffer, _ADD[j], out=buffer)
        least = np.minimum.reduceat(buffer, at).astype(np.uint64)
        mixed = flat.mix(least ^ _SALT[j])
        bit = mixed % np.uint64(SKETCH_BITS)
        sketch[every, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
        bands[:, j // BAND_ROWS] = flat.mix(bands[:, j // BAND_ROWS] * np.uint64(31) + mixed)
    return bands, sketch


def estimate(ones: np.ndarray) -> np.ndarray:
    """Similarity by the number of ones in the XOR of two odd sketches."""
    odd = np.maximum(1 - 2 * ones / SKETCH_BITS, 1 / SKETCH_BITS)
    return 1 - np.log(odd) / np.log(1 - 2 / SKETCH_BITS) / 2 / SAMPLES


def longs(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1).view(np.int64)))


def by_language(ids: pa.Array, langs: pa.Array, text: pa.Array):
    """(language, ids, texts) for each language of a batch."""
    coded = langs.dictionary_encode()
    code = np.asarray(coded.indices)
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        mine = pa.array(np.flatnonzero(code == k))
        yield lang, ids.take(mine), flat.strings(text.take(mine))


def sign(texts: DataFrame) -> DataFrame:
    """(id, lang, mark, class, sketch, bands) of the rows (id, lang, mark, text) that have a word.

    Rows of one language are of one class if they have the same shingles.  Classes and bands of different languages
    differ: the whole language tag is hashed into both.
    """

    def run(batches):
        for batch in batches:
            at = pa.array(np.arange(batch.num_rows))
            for lang, place, text in by_language(at, batch.column(1), batch.column(3)):
                tag = flat.mix(np.array([xxhash.xxh3_64_intdigest(lang)], np.uint64))
                for a, b in flat.slices(text):
                    value, before = shingles(text.slice(a, b - a), lang)
                    some = np.flatnonzero(np.diff(before))
                    if not len(some):
                        continue
                    bands, sketch = signatures(value, np.append(before[some], before[-1]))
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(flat.mix(value), out=total[1:])
                    size = np.diff(before)[some].astype(np.uint64)
                    kind = flat.mix((total[before[some + 1]] - total[before[some]] + size * np.uint64(0xD6E8FEB86659FD93)) ^ tag)
                    rows = place.slice(a, b - a).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(rows) for k in range(3)), pa.array(kind.view(np.int64)), longs(sketch), longs(flat.mix(bands ^ tag))],
                        ["id", "lang", "mark", "class", "sketch", "bands"],
                    )

    return texts.select("id", "lang", "mark", "text").mapInArrow(run, "id string, lang string, mark bigint, class bigint, sketch array<bigint>, bands array<bigint>")


def _similar_sketches(pairs: DataFrame, threshold: float) -> DataFrame:
    ones = sum((F.bit_count(F.col("sketch_1")[k].bitwiseXOR(F.col("sketch_2")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    most = next(n for n in range(SKETCH_BITS, -1, -1) if estimate(np.array([float(n)]))[0] >= threshold - MARGIN)
    return pairs.filter(ones <= most)


def _sets(texts: DataFrame) -> DataFrame:
    """(class, shingles) of rows (class, lang, text): the distinct shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for lang, kind, text in by_language(batch.column(0), batch.column(1), batch.column(2)):
                for a, b in flat.slices(text):
                    value, before = shingles(text.slice(a, b - a), lang)
                    sets = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(before * 8), pa.py_buffer(value)])
                    yield pa.RecordBatch.from_arrays([kind.slice(a, b - a), sets.cast(pa.binary())], ["class", "shingles"])

    return texts.select("class", "lang", "text").mapInArrow(run, "class bigint, shingles binary")


def _exact(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets are similar, with their similarity."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out.append(shared / (len(x) + len(y) - shared))
            found = np.array(out, np.float64)
            keep = pa.array(np.flatnonzero(found >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(found).take(keep)], ["class_1", "class_2", "similarity"])

    return pairs.select("class_1", "class_2", "shingles_1", "shingles_2").mapInArrow(run, "class_1 bigint, class_2 bigint, similarity double")


class _Signed:
    """Signed texts, written: each row's class, a row for each class, and the bands that classes share."""

    def __init__(self, texts: DataFrame):
        named = texts.select(*(F.col(c).cast("string").alias(c) for c in ("id", "lang", "text")))
        self.texts = named.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
        signed = materialize(sign(spread(self.texts)))
        self.members = signed.select("id", "lang", "class").distinct()
        # Copies have equal bands: they are merged here before anything is compared.
        first = signed.groupBy("class").agg(F.min(F.struct("id", "lang", "mark", "sketch", "bands")).alias("m"))
        self.classes = materialize(first.select("class", "m.*"))
        banded = self.classes.select("class", F.explode("bands").alias("band"))
        shared = materialize(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
        # A band that one class alone has goes no further.
        self.banded = materialize(banded.join(small_or_not(shared), "band"))
        drop_table(shared)

    def verified(self, pairs: DataFrame, threshold: float) -> DataFrame:
        """(class_1, class_2, similarity) of the written pairs that are similar; the sketches first sort out most others."""
        kept = pairs.select("class_1", "class_2")
        for side in ("1", "2"):
            kept = kept.join(self.classes.select(F.col("class").alias(f"class_{side}"), F.col("sketch").alias(f"sketch_{side}")), f"class_{side}")
        kept = materialize(_similar_sketches(kept, threshold).select("class_1", "class_2"))
        wanted = kept.select(F.col("class_1").alias("class")).union(kept.select("class_2")).distinct()
        chosen = materialize(self.classes.select("class", "id", "lang", "mark").join(wanted, "class", "left_semi"))
        # A class's text is fetched by its hash too: an id may have several texts.
        sets = materialize(_sets(self.texts.join(small_or_not(chosen), ["id", "lang", "mark"]).dropDuplicates(["class"])))
        checked = kept
        for side in ("1", "2"):
            checked = checked.join(sets.select(F.col("class").alias(f"class_{side}"), F.col("shingles").alias(f"shingles_{side}")), f"class_{side}")
        links = materialize(_exact(checked, threshold))
        drop_table(kept, chosen, sets)
        return links


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _block(n: Column) -> Column:
    """The block of a band of n members that a class belongs to (a class is a hash)."""
    return F.pmod(F.col("class"), _blocks(n)).cast("int")


def _band_pairs(banded: DataFrame) -> DataFrame:
    """(class_1, class_2), class_1 < class_2, of the classes that share a band: block by block, so that a band of any size is spread over tasks."""
    n = F.col("n")
    left = banded.select("band", F.col("class").alias("x"), _block(n).alias("i"), F.explode(F.sequence(_block(n), _blocks(n) - 1)).alias("j"))
    right = banded.select("band", F.col("class").alias("y"), F.explode(F.sequence(F.lit(0), _block(n))).alias("i"), _block(n).alias("j"))
    met = left.join(right, ["band", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("class_1"), F.greatest("x", "y").alias("class_2")).distinct()


def near_duplicates(texts: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the rows (id, lang, text), texts compared within their language.

    members (id, lang, class): the class of each text; texts with the same shingles of five words share one.
    links (class_1, class_2, similarity), class_1 < class_2: each pair of classes at the threshold or above.

    NULL, empty and wordless texts belong to no class; a text of fewer than five words is one shingle.  A repeated row
    counts once; an id may have several texts and then belongs to several classes; equal texts of two languages are like
    nothing of each other.  A pair at similarity 0.8 gets lost with a chance of 3e-5 (no band shared), a more
    similar one far more rarely.
    """
    signed = _Signed(texts)
    pairs = materialize(_band_pairs(signed.banded))
    links = signed.verified(pairs, threshold)
    drop_table(pairs, signed.banded)
    return signed.members, links


def near_groups(texts: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) like `near_duplicates`, but with only so many links that the groups they connect are the same.

    In each band, every class is compared with the band's smallest.  What that connects is one group; then, in bands
    that still hold several groups, the classes outside the band's largest group are compared with the classes of other
    groups.  A band of m texts that are all alike makes m - 1 comparisons, never m * m.
    """
    signed = _Signed(texts)
    banded = signed.banded
    least = banded.groupBy("band").agg(F.min("class").alias("class_1"))
    star = materialize(banded.join(least, "band").filter("`class` <> class_1").select("class_1", F.col("class").alias("class_2")).distinct())
    links = signed.verified(star, threshold)
    labels = connected(links.select(F.col("class_1").alias("a"), F.col("class_2").alias("b")))
    grouped = materialize(banded.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")))
    sizes = grouped.groupBy("band", "label").agg(F.count("*").alias("k"))
    split = materialize(sizes.groupBy("band").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("groups")).filter("groups > 1").select("band", "major"))
    open_ = grouped.join(small_or_not(split), "band")
    n = F.col("n")
    minor = open_.filter("label <> major").select("band", F.col("class").alias("x"), F.col("label").alias("p"), F.explode(F.sequence(F.lit(0), _blocks(n) - 1)).alias("i"))
    other = open_.select("band", F.col("class").alias("y"), F.col("label").alias("q"), _block(n).alias("i"))
    apart = minor.join(other, ["band", "i"]).filter("p <> q").select(F.least("x", "y").alias("class_1"), F.greatest("x", "y").alias("class_2")).distinct()
    rest = materialize(apart.join(star, ["class_1", "class_2"], "left_anti"))
    more = signed.verified(rest, threshold)
    drop_table(star, grouped, split, rest, banded)
    return signed.members, links.unionByName(more)


def pairs_of_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: every pair of ids with similar texts in some language.

    The size of this result is that of its definition: n copies make n * (n - 1) / 2 rows.
    `classes` holds the same in one row per id.
    """
    left = members.select(F.col("id").alias("x"), F.col("class").alias("class_1"))
    right = members.select(F.col("id").alias("y"), F.col("class").alias("class_2"))
    within = left.join(right, left.class_1 == right.class_2)
    between = links.join(left, "class_1").join(right, "class_2")
    both = within.select("x", "y").filter("x < y").unionByName(between.select("x", "y").filter("x <> y"))
    return both.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, lang, class, n_copies, near): one row per text; near is the smallest of the classes it is linked to, directly or through others."""
    labels = connected(links.select(F.col("class_1").alias("a"), F.col("class_2").alias("b"))).withColumnRenamed("node", "class")
    size = members.groupBy("class").agg(F.count("*").alias("n_copies"))
    return members.join(size.join(labels, "class", "left"), "class").select("id", "lang", "class", "n_copies", F.coalesce("label", "class").alias("near"))
