"""Byte-pair encoding with a public tokenizer, in batched numpy rounds.

Text is cut by the tokenizer's own pre-splitting rule, each distinct piece of
a batch is merged once, and the ids are gathered back for every occurrence.
In a round, the symbols of all unfinished pieces stand in one flat array; the
rank of each adjacent pair is found by binary search over the sorted pair
keys, and each piece merges all occurrences of its lowest-ranked pair.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from . import flat

TOKENIZER_DIR = os.environ.get("QIRTAS_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: A worker remembers the ids of at most this many pieces, then starts anew.
MEMORY_PIECES = 200_000

# The White_Space property of Unicode, and the endings the pre-splitting rule cuts off after an apostrophe.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


@dataclass
class Model:
    """Arrays of fixed size (about 1 MB), small enough to broadcast whatever the data."""

    byte_id: np.ndarray
    inside: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    classes: np.ndarray
    size: int
    name: str = DEFAULT
    special: dict = field(default_factory=dict)


# What the file of a byte-level BPE says, where it says anything; no normalizer, the pre-splitting rule of `pieces`.
EXPECTED = {"type": "BPE", "dropout": None, "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": False, "ignore_merges": False}
PRE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_pairs(tokens: list[bytes]) -> np.ndarray:
    """For two bytes, whether some token holds them side by side; no token reaches across any other pair."""
    data = np.frombuffer(b"".join(tokens), np.uint8)
    last = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) - 1
    within = np.ones(len(data), bool)
    within[last] = False
    at = np.flatnonzero(within)
    out = np.zeros((256, 256), bool)
    out[data[at], data[at + 1]] = True
    return out


def check(file: dict) -> None:
    """Refuse a vocabulary file whose normalizer, pre-splitting or merging is not that of byte-level BPE."""

    def differs(found: dict, wanted: dict) -> list[str]:
        return [k for k, v in wanted.items() if k in found and found[k] not in (v if isinstance(v, tuple) else (v,))]

    wrong = differs(file["model"], EXPECTED)
    if file.get("normalizer") is not None:
        wrong.append("normalizer")
    split = file.get("pre_tokenizer") or {}
    if any(split.get(k) != v for k, v in PRE_SPLIT.items()):
        wrong.append("pre_tokenizer")
    if wrong:
        raise ValueError(f"no byte-level BPE of the known kind: {', '.join(wrong)}")


def load(name: str = DEFAULT, folder: str | None = None) -> Model:
    """Read a byte-level BPE vocabulary (a `.json` of tokenizers or a `.tiktoken` of ranks); one of another kind fails."""
    folder = folder or TOKENIZER_DIR
    path = os.path.join(folder, f"{name}.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check(file)
        model = file["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        byte_id = np.zeros(256, np.int64)
        for ch, b in letters.items():
            byte_id[b] = vocab[ch]
        inside = byte_pairs([bytes(map(letters.__getitem__, t)) for t in vocab if t and all(ch in letters for ch in t)])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        size = max(vocab.values()) + 1
    else:
        import base64

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        rank, size = merged, max(ranks.values()) + 1
        inside = byte_pairs(list(ranks))
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    classes = np.zeros(flat.TABLE, np.uint8)
    classes[flat.by_category(("L",))] = LETTER
    classes[flat.by_category(("N",))] = NUMBER
    classes[list(WHITE_SPACE)] = SPACE
    return Model(byte_id, inside, keys[order], rank[order], merged[order], classes, size, name)


def pieces(points: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets of the pre-split pieces, and how many pieces stand before each row's start.

    The rule: an apostrophe ending; an optional blank with letters, digits or other signs;
    white space, of which the last character goes to what follows.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    kind = flat.look_up(classes, points, OTHER)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    run = row_start[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = np.zeros(n + 1, bool)
    space = kind == SPACE
    blank = points == 0x20
    # Runs of letters, digits, signs: they begin at the run, or one earlier where a blank stands before it.
    begin = np.flatnonzero(run & ~space)
    inside = ~row_start[begin]
    glued = np.zeros(len(begin), bool)
    glued[inside] = blank[begin[inside] - 1]
    start[begin[~glued]] = True
    # White space: the run begins a piece; its last character begins another if text of the row follows.
    start[:n] |= run & space
    last = np.flatnonzero(space[: n - 1] & ~space[1:] & ~row_start[1:n])
    start[last] = True
    # Apostrophe endings.
    at = begin[~glued]
    at = at[points[at] == 0x27]
    if len(at):
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        row_end = rows[np.searchsorted(rows, at, side="right")]
        for ending in ENDINGS:
            fits = at + len(ending) < row_end
            for k, ch in enumerate(ending, 1):
                fits &= padded[at + k] == ord(ch)
            hit = at[fits]
            if len(hit):
                start[hit + 1] = False
                start[hit + 1 + len(ending)] = True
    where = np.flatnonzero(start[:n])
    return where, np.searchsorted(where, rows)


def merge(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, offsets).

    A word falls apart between bytes that no token holds side by side: its parts are merged at the same time, so that a
    very long word without blanks does not wait for its own pairs one by one.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = model.byte_id[raw]
    apart = np.ones(len(raw), bool)
    if len(raw):
        apart[1:] = ~model.inside[raw[:-1], raw[1:]]
    begin = np.cumsum(lengths) - lengths
    apart[begin[lengths > 0]] = True
    owner = np.cumsum(apart) - 1
    first_part = np.append(owner, owner[-1] + 1 if len(owner) else 0)[np.append(begin, len(raw))]
    done_owner, done_ids = [], []
    while len(symbols):
        same = owner[1:] == owner[:-1]
        key = symbols[:-1] * model.size + symbols[1:]
        at = np.searchsorted(model.keys, key)
        at[at == len(model.keys)] = 0
        known = same & (model.keys[at] == key)
        rank = np.where(known, model.ranks[at], np.iinfo(np.int64).max)
        # the lowest rank within each word
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        rank = np.append(rank, np.iinfo(np.int64).max)
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(symbols)))
        alive = low != np.iinfo(np.int64).max
        if not alive.all():
            keep = np.repeat(alive, size)
            done_owner.append(owner[~keep])
            done_ids.append(symbols[~keep])
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = np.append(at, 0)[keep]
            low, size = low[alive], size[alive]
            if not len(symbols):
                break
        else:
            at = np.append(at, 0)
        hit = rank == np.repeat(low, size)
        # In a run such as "aaa" the pairs overlap: every second one counts, from the left.
        if (hit[1:] & hit[:-1]).any():
            run = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
            ends = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
            length = ends - run + 1
            where = flat.ranges(run, length)
            hit[where] = (where - np.repeat(run, length)) % 2 == 0
        symbols[hit] = model.merged[at[hit]]
        keep = np.ones(len(symbols), bool)
        keep[np.flatnonzero(hit) + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if done_owner:
        owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
    else:
        owner, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ids.astype(np.int32), np.searchsorted(owner, first_part)


class Encoder:
    """Ids of whole texts; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """The slot of each word; new words are merged, all in one go."""
        if len(self.known) + len(words) > MEMORY_PIECES and self.known:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            ids, offsets = merge([w.encode("utf-8") for w in new], self.model)
            n = len(self.known)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while n + len(new) + 1 > len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.starts[n : n + len(new) + 1] = self.used + offsets
            self.used += len(ids)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def split(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct pieces, the piece at each place, how many places stand before each row)."""
        points, rows = flat.code_points(text)
        start, before = pieces(points, rows, self.model.classes)
        if not len(start):
            return [], np.zeros(0, np.int64), before
        end = np.append(start[1:], len(points))
        first, kind = flat.distinct_spans(points, start, end)
        lengths = (end - start)[first]
        joined = points[flat.ranges(start[first], lengths)].tobytes().decode("utf-32-le")
        cuts = np.concatenate(([0], np.cumsum(lengths))).tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], kind, before

    def encode(self, text: pa.Array) -> pa.ListArray:
        """The ids of each row; an empty list for an empty text."""
        if not len(text):
            return pa.array([], pa.list_(pa.int32()))
        values, sizes = [], []
        for a, b in flat.slices(text):
            words, kind, before = self.split(text.slice(a, b - a))
            if not words:
                sizes.append(np.zeros(b - a, np.int64))
                continue
            slot = self.look_up(words)
            begin, length = self.starts[slot][kind], (self.starts[slot + 1] - self.starts[slot])[kind]
            values.append(self.pool[flat.ranges(begin, length)])
            total = np.concatenate(([0], np.cumsum(length)))
            sizes.append(np.diff(total[before]))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        ids = np.concatenate(values) if values else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
