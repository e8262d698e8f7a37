"""Evaluation texts inside training text (problem 8).

Texts are compared on their letters and digits alone.  A passage is twelve
consecutive words of an item, with at most `budget` edits: cut into budget + 1
pieces, one piece must stand in the document unchanged.  Every item is
therefore cut into pieces so short that any twelve of its words hold budget + 1
whole ones, each position of a document is looked up among the pieces by a
rolling hash, and what stands around a hit is verified with Myers' bit-parallel
edit distance: first half a passage on either side, then every passage that
holds the piece, whole.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import spread
from . import flat

WORDS = 12
#: So many letters of a passage may be changed, added or left out.
BUDGET = 2
#: Hits are verified so many at a time, and matrices of characters hold at most so many.
BLOCK_HITS, BLOCK_CELLS = 20_000, 4_000_000
#: Items are broadcast in blocks of about this many characters (4 bytes each, and as much again for their pieces).
BLOCK_CHARS = 4_000_000

_FILTER_BITS = 20


@functools.lru_cache(1)
def fold_table() -> np.ndarray:
    """What each character becomes: a letter or digit without case, width and accents, or 0 for everything else."""
    out = np.zeros(flat.TABLE, np.uint32)
    for i in range(flat.TABLE):
        ch = chr(i)
        if 0xD800 <= i < 0xE000 or i == 0x640:
            continue
        ch = unicodedata.normalize("NFKC", ch).casefold()
        if len(ch) == 1:
            base = unicodedata.normalize("NFD", ch)[0] if i < 0x600 else ch
            if base.isalnum():
                out[i] = ord(base)
        elif ch[:1].isalnum():
            out[i] = ord(ch[0])
    return out


@functools.lru_cache(1)
def space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(flat.TABLE)), bool, flat.TABLE)


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters and digits of all rows, row offsets, where white space stands before, where anything else stands before)."""
    points, rows = flat.code_points(text)
    value = flat.look_up(fold_table(), points)
    kept = np.flatnonzero(value)
    spaces = np.concatenate(([0], np.cumsum(flat.look_up(space_table(), points))))[kept]
    rows = np.searchsorted(kept, rows)
    word = np.ones(len(kept) + 1, bool)
    edge = np.ones(len(kept) + 1, bool)
    if len(kept):
        word[1:-1] = spaces[1:] != spaces[:-1]
        edge[1:-1] = np.diff(kept) > 1
    word[rows] = True
    edge[rows] = True
    return value[kept], rows, word, edge


@dataclass
class Items:
    """Items as flat arrays, and the pieces (of one length) of those cut alike, in hash order."""

    ids: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    word_starts: np.ndarray
    size: int
    side: int
    beyond: int
    reach: int
    hashes: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    around: tuple[np.ndarray, np.ndarray] | None = None

    def surroundings(self) -> tuple[np.ndarray, np.ndarray]:
        """What stands `side` characters after and before each piece, a column for each; made where it is first used."""
        if self.around is None:
            item = np.searchsorted(self.rows, self.places, side="right") - 1
            low, high, steps = self.rows[item], self.rows[item + 1], np.arange(self.side)
            self.around = _window(self.value, self.places + self.size, None, high, steps, 0), _window(self.value, self.places - 1, low, None, -steps, 0)
        return self.around


def piece_size(width: int, budget: int) -> int:
    """The length of pieces for an item whose narrowest passage has `width` characters, rounded down to few different ones.

    A passage of n characters holds budget + 1 whole pieces if n >= (budget + 2) * size - 1.
    """
    size = max(1, (width + 1) // (budget + 2))
    return size if size < 8 else size - size % 2 if size < 16 else size - size % 4


def prepare(ids: list[int], texts: list[str], words: int = WORDS, budget: int = BUDGET) -> list[Items]:
    """The pieces of the items, those of one piece length together; items with fewer than `words` words have none.

    An item of short words makes short pieces of itself alone, not of the others.
    """
    value, rows, word, _ = folded(pa.array(texts, pa.string()))
    starts = np.flatnonzero(word[:-1])
    before = np.searchsorted(starts, rows)
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for i, (a, b, end) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), rows[1:].tolist(), strict=True)):
        if b - a >= words:
            width = np.append(starts[a + words : b], end) - starts[a : b - words + 1]
            groups.setdefault(piece_size(int(width.min()), budget), []).append((i, int(width.min()), int(width.max())))
    out = []
    sums = flat.prefix_hashes(value)
    for size, members in sorted(groups.items()):
        places = np.concatenate([np.arange(rows[i], rows[i + 1] - size + 1, size) for i, _, _ in members])
        hashes = flat.span_hashes(sums, places, places + size)
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        narrow, wide = min(w for _, w, _ in members), max(w for _, _, w in members)
        side = min(60, max(1, (narrow - size + 1) // 2))
        out.append(Items(np.array(ids, np.int64), value, rows, starts, size, side, narrow - size, wide + 8, hashes[order], places[order], seen))
    return out


def myers(pattern: np.ndarray, text: np.ndarray, budget: int) -> np.ndarray:
    """Least edit distance of each pattern (up to 64 long) to a prefix of its text: bit-parallel, all columns at once.

    pattern and text are matrices of code points with a column for each pair; distances above `budget` may come out
    larger than they are, as only matches that a path within the budget can use are looked at.
    """
    m, n = pattern.shape
    one = np.uint64(1)
    mask = np.uint64((1 << m) - 1)
    top = np.uint64(m - 1)
    plus = np.full(n, mask, np.uint64)
    minus = np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(len(text)):
        match = np.zeros(n, np.uint64)
        for k in range(max(0, j - budget), min(m, j + budget + 1)):
            match |= (pattern[k] == text[j]).astype(np.uint64) << np.uint64(k)
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        score += ((up >> top) & one).astype(np.int64)
        score -= ((down >> top) & one).astype(np.int64)
        # the text's start is fixed: row 0 of the matrix grows by one each step
        up = (up << one) | one
        down = down << one
        plus = (down | ~(vertical | up)) & mask
        minus = up & vertical & mask
        np.minimum(best, score, out=best)
    return best


def distances(pattern: np.ndarray, text: np.ndarray, wanted: np.ndarray, budget: int) -> np.ndarray:
    """Least edit distance of prefixes of each pattern to a prefix of its text, by prefix length: the lengths where `wanted` holds.

    pattern, text and wanted are matrices with a column for each pair, wanted with a row for each length from 0.  Myers' blocks of
    64 rows pass their horizontal differences on to the next; what is above `budget` comes out as budget + 1 or more.
    """
    m, n = pattern.shape
    one, none = np.uint64(1), np.zeros(n, np.uint64)
    blocks = max(1, -(-m // 64))
    plus, minus = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    best = np.full((m + 1, n), budget + 1, np.int64)
    asked = {k: np.flatnonzero(wanted[k]) for k in np.flatnonzero(wanted.any(axis=1)).tolist()}
    for k in range(min(m, budget) + 1):
        best[k] = k  # nothing of the text
    for j in range(len(text)):
        match = np.zeros((blocks, n), np.uint64)
        for k in range(max(0, j - budget), min(m, j + budget + 1)):
            match[k >> 6] |= (pattern[k] == text[j]).astype(np.uint64) << np.uint64(k & 63)
        grows, falls = none + one, none  # row 0 grows by one each step: the text's start is fixed
        for w in range(blocks):
            p, q = plus[w], minus[w]
            vertical = match[w] | q
            eq = match[w] | falls
            horizontal = (((eq & p) + p) ^ p) | eq
            up = q | ~(horizontal | p)
            down = p & horizontal
            next_grows, next_falls = up >> np.uint64(63), down >> np.uint64(63)
            up, down = (up << one) | grows, (down << one) | falls
            plus[w] = down | ~(vertical | up)
            minus[w] = up & vertical
            grows, falls = next_grows, next_falls
        for length in range(max(1, j + 1 - budget), min(m, j + 1 + budget) + 1):
            some = asked.get(length)
            if some is not None:
                score = np.full(len(some), j + 1, np.int64)
                for w in range(-(-length // 64)):
                    mask = np.uint64((1 << min(64, length - 64 * w)) - 1)
                    score += np.bitwise_count(plus[w, some] & mask).astype(np.int64) - np.bitwise_count(minus[w, some] & mask)
                best[length, some] = np.minimum(best[length, some], score)
    return best


def _window(value: np.ndarray, at: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, offsets: np.ndarray, nothing: int) -> np.ndarray:
    """value[at + offset] where low <= at + offset < high, else `nothing`; a bound that cannot be passed may be left out."""
    where = offsets[:, None] + at[None, :]
    outside = where >= high if low is None else where < low if high is None else (where < low) | (where >= high)
    out = value.take(where, mode="clip") if len(value) else np.zeros(where.shape, np.uint32)
    out[outside] = nothing
    return out


def _in_blocks(count: np.ndarray, most: int):
    """Ranges of places whose counts are about `most` together; one with more is a range of its own."""
    total = np.concatenate(([0], np.cumsum(count)))
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield a, b
        a = b


def hits(text: pa.Array, groups: list[Items], words: int = WORDS, budget: int = BUDGET) -> tuple[np.ndarray, ...]:
    """(row, item number, words of the longest exact run, edits of the closest passage) of each pair with a verified hit."""
    value, rows, _, edge = folded(text)
    sums = flat.prefix_hashes(value)
    found = []
    for items in groups:
        size = items.size
        at = np.arange(max(0, len(value) - size + 1))
        if not len(at):
            continue
        hashes = flat.span_hashes(sums, at, at + size)
        at = np.flatnonzero(items.filter[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        left = np.searchsorted(items.hashes, hashes[at], side="left")
        count = np.searchsorted(items.hashes, hashes[at], side="right") - left
        some = np.flatnonzero((count > 0) & (at + size <= rows[np.searchsorted(rows, at, side="right")]))
        at, left, count = at[some], left[some], count[some]
        near = []
        for a, b in _in_blocks(count, BLOCK_HITS):
            piece = flat.ranges(left[a:b], count[a:b])
            where = np.repeat(at[a:b], count[a:b])
            for c in range(0, len(where), BLOCK_HITS):  # a position may hit very many equal pieces
                near.append(_near(value, rows, where[c : c + BLOCK_HITS], piece[c : c + BLOCK_HITS], items, budget))
        if near:
            found.append(_passages(value, rows, edge, *(np.concatenate(x) for x in zip(*near, strict=True)), items, words, budget))
    row, item, n, edits = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((item, row))
    row, item, n, edits = row[order], item[order], n[order], edits[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else [])
    if not len(first):
        return row, item, n, edits
    return row[first], item[first], np.maximum.reduceat(n, first), np.minimum.reduceat(edits, first)


def _near(value, rows, at, piece, items, budget):
    """The hits beside which, on one side, half of what a passage has beyond the piece agrees within the budget."""
    size = items.size
    row = np.searchsorted(rows, at, side="right") - 1
    low, high = rows[row], rows[row + 1]
    longer = np.arange(items.side + budget)
    after, before = items.surroundings()
    keep = myers(after.take(piece, axis=1), _window(value, at + size, None, high, longer, 1), budget) <= budget
    rest = np.flatnonzero(~keep)
    left = myers(before.take(piece[rest], axis=1), _window(value, at[rest] - 1, low[rest], None, -longer, 1), budget)
    keep[rest[left <= budget]] = True
    place = items.places[piece[keep]]
    return at[keep], row[keep], np.searchsorted(items.rows, place, side="right") - 1, place


def _passages(value, rows, edge, at, row, item, place, items, words, budget):
    """(row, item, words of the exact run, edits) of the hits that stand in a passage within the budget."""
    size, reach = items.size, items.reach
    if not len(at):
        return row, item, row, row
    # Pieces that follow each other on both sides are of one run, which is followed from its first and its last.
    order = np.lexsort((place, at - place, item, row))
    at, row, item, place = (x[order] for x in (at, row, item, place))
    low, high, item_low, item_high = rows[row], rows[row + 1], items.rows[item], items.rows[item + 1]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(place) != size) | (np.diff(at) != size) | (np.diff(item) != 0) | (np.diff(row) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    ahead = _agreement(value, items.value, at[last] + size, place[last] + size, low[last], high[last], item_low[last], item_high[last], 1, reach)
    behind = _agreement(value, items.value, at[first] - 1, place[first] - 1, low[first], high[first], item_low[first], item_high[first], -1, reach)
    begin, end = place[first] - behind, place[last] + size + ahead
    shift = (at - place)[first]
    ends = np.append(items.word_starts[1:], items.rows[-1])
    w, z = np.searchsorted(items.word_starts, begin), np.searchsorted(ends, end, side="right")
    # The run begins and ends with whole words of the document too.
    while (some := np.flatnonzero(w < z)[~edge[(items.word_starts[w[w < z]] + shift[w < z])]]).size:
        w[some] += 1
    while (some := np.flatnonzero(w < z)[~edge[(ends[z[w < z] - 1] + shift[w < z])]]).size:
        z[some] -= 1
    n = np.maximum(z - w, 0)
    # A run of that many words is a passage without edits; around others, each passage is measured.
    edits = np.where(n >= words, 0, budget + 1)
    short = np.flatnonzero(n < words)
    more = short[first[short] < last[short]]
    run, anchor = np.concatenate((short, more)), np.concatenate((first[short], last[more]))
    likely = _split(value, at[anchor], place[anchor], low[anchor], high[anchor], item_low[anchor], item_high[anchor], items, budget)
    run, anchor = run[likely], anchor[likely]
    np.minimum.at(edits, run, _edits(value, at[anchor], place[anchor], low[anchor], high[anchor], item_low[anchor], item_high[anchor], items, ends, words, budget))
    kept = edits <= budget
    return row[first][kept], item[first][kept], n[kept], edits[kept]


def _both_sides(value, at, place, low, high, item_low, item_high, items, wanted, budget):
    """`distances` to the left and to the right of the pieces, by prefix length; wanted holds the lengths of both sides."""
    longest = wanted.shape[1] - 1
    steps, longer = np.arange(longest), np.arange(longest + budget)
    pattern = np.hstack((_window(items.value, place - 1, item_low, None, -steps, 0), _window(items.value, place + items.size, None, item_high, steps, 0)))
    text = np.hstack((_window(value, at - 1, low, None, -longer, 1), _window(value, at + items.size, None, high, longer, 1)))
    both = distances(pattern, text, np.hstack((wanted[0], wanted[1])), budget)
    return both[:, : len(at)], both[:, len(at) :]


def _split(value, at, place, low, high, item_low, item_high, items, budget):
    """Which hits a passage can hold: it goes beyond the piece by `beyond` at least, so by some quarters of that on the left and the rest, less one, on the right."""
    quarter = items.beyond // 4
    left, right = [k * quarter for k in range(4)], [max(0, items.beyond - (k + 1) * quarter) for k in range(4)]
    out = np.zeros(len(at), bool)
    step = max(1, BLOCK_CELLS // max(1, 2 * items.beyond))
    for a in range(0, len(at), step):
        part = [x[a : a + step] for x in (at, place, low, high, item_low, item_high)]
        wanted = np.zeros((2, max(*left, *right) + 1, len(part[0])), bool)
        wanted[0, left], wanted[1, right] = True, True
        before, after = _both_sides(value, *part, items, wanted, budget)
        out[a : a + step] = (before[left] + after[right] <= budget).any(axis=0)
    return out


def _edits(value, at, place, low, high, item_low, item_high, items, ends, words, budget):
    """Edits of the closest passage of `words` words that holds the piece at `place`; at least 1, as none is an exact run."""
    out = np.full(len(at), budget + 1, np.int64)
    starts, size = items.word_starts, items.size
    step = max(1, BLOCK_CELLS // max(1, 2 * items.reach))
    for a in range(0, len(at), step):
        part = where, here, lo, hi, ilo, ihi = [x[a : a + step] for x in (at, place, low, high, item_low, item_high)]
        n = len(where)
        word = np.searchsorted(starts, here, side="right") - 1
        s = word[None, :] - np.arange(words)[:, None]  # the passages' first words
        fits = (s >= np.searchsorted(starts, ilo)) & (s + words <= np.searchsorted(starts, ihi))
        s = np.clip(s, 0, max(0, len(starts) - words))
        before, after = here - starts[s], ends[s + words - 1] - (here + size)
        fits &= after >= 0
        longest = int(max(before[fits].max(), after[fits].max())) if fits.any() else 0
        wanted = np.zeros((2, longest + 1, n), bool)
        col = np.broadcast_to(np.arange(n), s.shape)
        wanted[0, before[fits], col[fits]] = True
        wanted[1, after[fits], col[fits]] = True
        left, right = _both_sides(value, *part, items, wanted, budget)
        both = np.where(fits, left[np.where(fits, before, 0), col] + right[np.where(fits, after, 0), col], budget + 1)
        out[a : a + step] = np.maximum(both.min(axis=0), 1)
    return out


def _agreement(value, item_value, at, place, low, high, item_low, item_high, sign, step):
    """How many characters agree from at and place on: in steps, to the first mismatch or the end of the item or document."""
    out = np.zeros(len(at), np.int64)
    steps = sign * np.arange(step)
    on = np.arange(len(at))
    while len(on):
        done = sign * out[on]
        same = _window(item_value, place[on] + done, item_low[on], item_high[on], steps, 0) == _window(value, at[on] + done, low[on], high[on], steps, 1)
        n = np.where(same.all(axis=0), step, np.argmin(same, axis=0))
        out[on] += n
        on = on[n == step]
    return out


def has_passage(text: Column, words: int = WORDS) -> Column:
    """Whether an item has enough words to hold a passage; NULL is false."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\s\u00a0\u0085]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))) >= words, F.lit(False))


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, budget: int = BUDGET, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key, n_words, n_edits): the documents that hold a passage of `words` consecutive item words within `budget` edits.

    n_edits is that of the closest passage: letters or digits changed, added or left out, without regard to case,
    punctuation, spacing, line breaks, vowel marks and kashida; 0 if its words stand there as whole words.
    n_words is the longest run of whole item words around such a passage that the document holds exactly, however long.
    A pair with n_words >= `words` holds them for certain (n_edits is then 0), and every such pair is found.

    A word is what stands between white space and has a letter or digit.  NULL and empty texts give no rows, nor do
    items of fewer than `words` words, of which no passage exists; a NULL key is kept for documents, items without id
    are passed over; repeated rows count once.

    Items are the smaller, stated side.  They are read in blocks of `block_chars` characters; each block is broadcast
    and the documents pass it once, so no block grows with the data.
    """
    spark = documents.sparkSession
    stated = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = stated.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    narrow = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = narrow.schema["key"].dataType.simpleString()
    out = None
    for k in range(blocks):
        block = stated if blocks == 1 else stated.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        rows = block.orderBy("i", "t").collect()  # bounded by block_chars
        shared = spark.sparkContext.broadcast(prepare([r.i for r in rows], [r.t for r in rows], words, budget))

        def run(batches, shared=shared):
            mine = shared.value
            for batch in batches if mine else ():
                text = flat.strings(batch.column(1))
                for a, b in flat.slices(text):
                    row, item, n, edits = hits(text.slice(a, b - a), mine, words, budget)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(mine[0].ids[item]), pa.array(n.astype(np.int32)), pa.array(edits.astype(np.int32))], ["key", "item", "n_words", "n_edits"])

        part = narrow.mapInArrow(run, f"key {kind}, item bigint, n_words int, n_edits int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("key").alias(key), F.col("item").alias(item_key)).agg(F.max("n_words").alias("n_words"), F.min("n_edits").alias("n_edits"))
