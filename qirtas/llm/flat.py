"""Columnar text work for Arrow batches.

A batch of strings becomes one flat array of code points plus offsets, and
every step here (classifying, cutting, hashing, looking up) is one numpy pass
over that array, with no Python statement per character, per word or per row.
What its users do with single values (a regular expression for each answer of
`pairs`, the closer look of `canon`, the rims of `pii`) runs in Python for each
distinct value or found piece.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of the two planes that hold text get table entries; the rest count as "other".
TABLE = 0x20000
#: A slice holds about this many code points, so working memory is a few dozen MB whatever the rows' length.
SLICE_CHARS = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array with NULL read as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(text: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts are about `limit` bytes together; one longer row is a range of its own."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    at = 0
    while at < len(text):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(text))
        yield at, end
        at = end


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the row offsets into them."""
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]].tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets - offsets[0]
    head = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(head)))
    return points, before[offsets - offsets[0]]


def look_up(table: np.ndarray, points: np.ndarray, other: int = 0) -> np.ndarray:
    if len(points) == 0 or points.max() < len(table):
        return table[points]
    out = table[np.minimum(points, len(table) - 1)]
    out[points >= len(table)] = other
    return out


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _MULT, np.uint64)
    up[0] = 1
    down = np.full(n + 1, _INV, np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n + 1 of each."""
    return _powers(1 << max(12, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """sums[i] = sum over j < i of values[j] * MULT**j, modulo 2**64."""
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + l)."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)


def distinct_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span of each kind, the kind of each span).  Equal hashes are checked against the values."""
    hashes = span_hashes(prefix_hashes(values), start, end)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    length = end - start
    same = length == length[first][kind]
    if same.all():
        same = values[ranges(start, length)] == values[ranges(start[first][kind], length)]
    if not same.all():  # two different spans share a hash: compare them as strings
        seen: dict[bytes, int] = {}
        kinds = [seen.setdefault(values[a:b].tobytes(), len(seen)) for a, b in zip(start, end, strict=True)]
        kind = np.array(kinds, np.int64)
        _, first = np.unique(kind, return_index=True)
    return first, kind


def by_category(prefixes: tuple[str, ...]) -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i)).startswith(prefixes) for i in range(TABLE)), bool, TABLE)


@functools.lru_cache(1)
def word_table() -> np.ndarray:
    """True for the characters of words: letters, digits, underscore."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(TABLE)), bool, TABLE)
