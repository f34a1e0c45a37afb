"""Substring dedup by recompression.

Each document is a sequence of words, and in rounds its symbols are renamed: first a run of one
symbol becomes one, then a symbol of the left half of the alphabet and a following one of the right
half become one; which half a symbol is in, and what the new symbol is called, follows from hashes
of what it stands for.  So names are the same everywhere without a table of them, and inside equal
substrings the parse is the same but for a few symbols at both ends.  For every symbol it is known
on which words its making depended.

A window of words that occurs twice holds, wherever it lies in full, the same symbols.  Spark counts
for each window the widest symbol that depends on its words alone; windows whose symbol occurs once
are unique, and only the others are verified: counted by 128 bits of hashes of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import column, lean
from .blocks import ASKED, answer, answered, ask, distinct, n_buckets, rows_of, write_blocks
from .shared import free_name
from .words import hash_slices, join_hashes, mix64, split, utf8, windows

WIDTH = 35
ROUNDS = 4
SECOND = 0x5851F42D4C957F2D  # seed of the second hash of words and windows


class Symbols:
    """Symbols of texts in order: name, words [start, end) that they stand for, words [low, high) that they depend on, text."""

    def __init__(self, keys: np.ndarray, first: np.ndarray):
        n = len(keys)
        self.name, self.first = keys, first
        self.start = np.arange(n)
        self.end = self.start + 1
        self.low, self.high = self.start, self.end
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols in front depend on from, and those behind up to; a text's end lies beyond all its windows."""
        low, high = np.empty_like(self.low), np.empty_like(self.high)
        low[1:], high[:-1] = self.low[:-1], self.high[1:]
        head = np.concatenate([[True], self.text[1:] != self.text[:-1]])
        tail = np.concatenate([head[1:], [True]])
        low[head] = self.first[self.text[head]] - 1
        high[tail] = self.first[self.text[tail] + 1] + 1
        return low, high

    def _keep(self, head: np.ndarray, last: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.start, self.end, self.low, self.high, self.text = name, self.start[head], self.end[last], low, high, self.text[head]

    def runs(self, salt: int) -> None:
        same = np.zeros(len(self.name), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        low, high = self._neighbours()
        if not same.any():
            self.low, self.high = low, high
            return
        head = np.flatnonzero(~same)
        last = np.append(head[1:], len(same)) - 1
        size = last - head + 1
        name = self.name[head]
        several = size > 1
        name[several] = mix64(join_hashes(name[several], size[several].astype(np.uint64) + np.uint64(salt)))
        self._keep(head, last, name, low[head], high[last])

    def pairs(self, salt: int) -> None:
        right = (mix64(self.name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(self.name), bool)
        joins[:-1] = ~right[:-1] & right[1:] & (self.text[:-1] == self.text[1:])
        joined = np.zeros(len(self.name), bool)
        joined[1:] = joins[:-1]
        before, behind = self._neighbours()
        low = np.where(joined | ~right, self.low, before)  # a lone right symbol had no left one in front
        high = np.where(joins | right, self.high, behind)
        head = np.flatnonzero(~joined)
        last = head + joins[head]
        name = self.name[head]
        two = np.flatnonzero(joins[head])
        name[two] = mix64(join_hashes(name[two] + np.uint64(salt), self.name[head[two] + 1]))
        self._keep(head, last, name, low[head], high[last])


def recompress(keys: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    s = Symbols(keys, first)
    for r in range(rounds):
        if len(s.name):
            s.runs(2 * r + 1)
            s.pairs(2 * r + 2)
    return s


def anchors(s: Symbols, n_words: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, anchor): of the window at each word, the widest symbol that depends on its words alone, or -1."""
    at = np.arange(n_words)
    low = np.searchsorted(s.low, at).astype(np.int64)
    count = np.searchsorted(s.high, at + width, "right") - low
    # Width first, then name: an order that equal windows share; of equal symbols the leftmost.
    names = (np.minimum(s.end - s.start, 255).astype(np.uint64) << np.uint64(56)) | (s.name >> np.uint64(8))
    out = np.full(n_words, -1)
    best, size = np.arange(len(names)), 1
    todo = count > 0
    while todo.any():
        here = np.flatnonzero(todo & (count < 2 * size))
        if len(here):
            a, b = best[low[here]], best[low[here] + count[here] - size]
            out[here] = np.where(names[b] > names[a], b, a)
            todo[here] = False
        if len(best) <= size:
            break
        a, b = best[:-size], best[size:]
        best = np.where(names[b] > names[a], b, a)
        size *= 2
    return names, out


class Block:
    """Words of a block's texts and what is asked about them."""

    def __init__(self, rows: pa.RecordBatch, text_col: str, width: int):
        self.data, self.offsets = utf8(column(rows, text_col))
        self.starts, self.ends, self.first = split(self.data, self.offsets)
        self.keys = hash_slices(self.data, self.starts, self.ends)
        self.width = width
        n = len(self.keys)
        at = np.arange(n)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.whole = at + width <= self.first[text + 1]  # a window starts here
        self.names, self.anchor = anchors(recompress(self.keys, self.first), n, width)
        self.anchor[~self.whole] = -1

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the windows' symbols, and whether a name is that of two symbols."""
        chosen = np.unique(self.anchor[self.anchor >= 0])
        keys, counts = np.unique(self.names[chosen], return_counts=True)
        return keys, counts > 1

    def doubtful(self, keys: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows whose symbol occurs elsewhere, or that have none."""
        ok = self.whole.copy()
        has = np.flatnonzero(self.anchor >= 0)
        ok[has] = shared[np.searchsorted(keys, self.names[self.anchor[has]])]
        return np.flatnonzero(ok)

    def hashed(self, where: np.ndarray) -> np.ndarray:
        """128 bits of the windows that start there: two hashes of their words, each from hashes of its own."""
        if not len(where):
            return np.zeros((0, 2), np.uint64)
        words = np.flatnonzero(self.covered(where))
        other = np.zeros_like(self.keys)
        other[words] = hash_slices(self.data, self.starts[words], self.ends[words], SECOND)
        return np.stack([windows(k, self.first, self.width, seed)[0][where] for k, seed in ((self.keys, 0), (other, SECOND))], 1)

    def covered(self, where: np.ndarray) -> np.ndarray:
        """Words in the windows that start there."""
        n = np.zeros(len(self.keys) + 1, np.int32)
        n[where] += 1
        np.subtract.at(n, where + self.width, 1)
        return np.cumsum(n)[:-1] > 0

    def kept(self, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each text's kept words, joined by one space, and their offsets."""
        size = len(self.data)
        edge = np.zeros(size + 1, np.int32)
        k = np.flatnonzero(~removed)
        edge[self.starts[k]] += 1
        edge[self.ends[k]] -= 1
        inside = np.cumsum(edge)[:-1] > 0
        # The byte behind a kept word becomes the space, if another kept word of the text follows.
        text = np.searchsorted(self.first, k, "right") - 1
        gap = self.ends[k[:-1]][text[1:] == text[:-1]] if len(k) else k
        data = self.data.copy()
        data[gap] = 32
        inside[gap] = True
        at = np.concatenate([[0], np.cumsum(inside)])
        return data[inside], at[self.offsets]


def _blocks_of(batches, text_col: str, width: int):
    for batch in batches:
        for part, number, rows in rows_of(batch):
            yield part, number, rows, Block(rows, text_col, width)


def repeated_windows(docs: DataFrame, text_col: str = "text", width: int = WIDTH):
    """(blocks, mark): the written blocks, and a function that gives the removed words of a block."""
    blocks = write_blocks(docs, text_col)
    buckets = n_buckets(blocks)

    @lean
    def ask_names(batches):
        for part, number, _, b in _blocks_of(batches, text_col, width):
            yield ask(part, number, *b.named(), buckets)

    names = answer(blocks.mapInArrow(ask_names, ASKED), buckets)

    def doubtful(part: int, number: int, b: Block) -> np.ndarray:
        keys, _ = b.named()
        return b.doubtful(keys, answered(names, part, number, keys, buckets))

    @lean
    def ask_windows(batches):
        for part, number, _, b in _blocks_of(batches, text_col, width):
            keys, _, counts = distinct(b.hashed(doubtful(part, number, b)))
            yield ask(part, number, keys, counts > 1, buckets)

    found = answer(blocks.mapInArrow(ask_windows, ASKED), buckets)

    def mark(part: int, number: int, b: Block) -> np.ndarray:
        where = doubtful(part, number, b)
        keys, inverse, _ = distinct(b.hashed(where))
        return b.covered(where[answered(found, part, number, keys, buckets)[inverse]])

    return blocks, mark


def dedup_substrings(docs: DataFrame, text_col: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """Removes every word that lies in ``width`` consecutive words that also start anywhere else.

    Returns all rows of ``docs`` with their columns; where words were removed, the text is what is
    left, joined by single spaces, and else it is unchanged.  Added: n_words, n_removed and, if
    ``digest``, kept_sha256 (of the kept words joined by single spaces) instead of the text.

    Windows are judged on the input.  A null text has no words and stays null; documents of fewer
    than ``width`` words keep all; of equal documents all lose what they share, repeated rows
    included.  Where ``docs`` has columns of the added names, underscores are added to the new ones.
    """
    blocks, mark = repeated_windows(docs, text_col, width)
    added = [free_name(docs, x) for x in ("n_words", "n_removed", "kept_sha256")[: 3 if digest else 2]]
    kept_fields = [f for f in docs.schema.fields if not (digest and f.name == text_col)]
    schema = T.StructType([*kept_fields, *(T.StructField(n, T.LongType()) for n in added[:2]), *(T.StructField(n, T.StringType()) for n in added[2:])])

    @lean
    def run(batches):
        for part, number, rows, b in _blocks_of(batches, text_col, width):
            removed = mark(part, number, b)
            n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[b.first])
            data, at = b.kept(removed)
            raw, cuts = data.tobytes(), at.tolist()
            out = []
            for f in kept_fields:
                c = column(rows, f.name)
                if f.name == text_col:
                    old = c.to_pylist()
                    c = pa.array([raw[cuts[i] : cuts[i + 1]].decode("utf-8") if n else old[i] for i, n in enumerate(n_removed.tolist())], pa.string())
                out.append(c)
            out += [pa.array(np.diff(b.first), pa.int64()), pa.array(n_removed, pa.int64())]
            if digest:
                out.append(pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(cuts[:-1], cuts[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return blocks.mapInArrow(run, schema)
