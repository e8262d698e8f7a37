"""Normalised words and word shingles of whole batches, as 64-bit hashes."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from ..functions import text as project
from . import flat

WORDS = 5


@functools.lru_cache(2)
def fold_table(lang: str) -> tuple[np.ndarray, np.ndarray]:
    """(what each character becomes, 0 for nothing; which characters need the whole text to be normalised)."""
    fold = np.zeros(flat.TABLE, np.uint32)
    hard = np.zeros(flat.TABLE, bool)
    for i in range(flat.TABLE):
        ch = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        out = unicodedata.normalize("NFKC", ch).translate(project.DIGIT_MAP).lower()
        if lang == "ar":
            out = project.fold_arabic(out)
            if not out and i not in (0x653, 0x654, 0x655):
                continue
        if len(out) == 1 and not unicodedata.combining(ch) and i != 0x3A3:
            fold[i] = ord(out)
        else:
            fold[i], hard[i] = i, True
    return fold, hard


def words(text: pa.Array, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, how many words stand before each row's start), words as in the project's normalisation."""
    fold, hard = fold_table(lang)
    points, rows = flat.code_points(text)
    need = flat.look_up(hard, points)
    if need.any():
        which = np.unique(np.searchsorted(rows, np.flatnonzero(need), side="right") - 1)
        values = text.to_pylist()
        for i in which.tolist():
            values[i] = project.normalize(values[i], lang)
        points, rows = flat.code_points(pa.array(values, pa.string()))
    folded = flat.look_up(fold, points, 0x20)
    keep = folded != 0
    if not keep.all():
        rows = np.concatenate(([0], np.cumsum(keep)))[rows]
        folded = folded[keep]
    n = len(folded)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    inside = flat.look_up(flat.word_table(), folded)
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    start = np.flatnonzero(inside & (cut[:n] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return flat.span_hashes(flat.prefix_hashes(folded), start, end), np.searchsorted(start, rows)


def shingles(text: pa.Array, lang: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row, sorted; row offsets).  A text of fewer words is one shingle; no words, none."""
    hashes, before = words(text, lang)
    count = np.diff(before)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(len(before), np.int64)
    start = flat.ranges(before[:-1], n)
    length = np.repeat(np.minimum(count, size), n)
    row = np.repeat(np.arange(len(count)), n)
    value = flat.span_hashes(flat.prefix_hashes(hashes), start, start + length)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
    value, row = value[first], row[first]
    return value, np.searchsorted(row, np.arange(len(count) + 1))
