r"""Byte-level BPE; texts are split into pieces without regular expressions.

Pre-tokenisation works on whole batches: every code point gets a class, every class is a function
from states to states, and as the composition of functions is associative, the state in front of
each code point follows from a prefix scan over blocks.  State, class and next class say where
pieces begin.  Equal pieces are merged once; their token ids are kept in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .batches import chunks, column, lean
from .shared import free_name, ship
from .words import hash_slices, utf8

# Classes of code points.  APOS1 and APOS2: an apostrophe with a contraction of 1 or 2 letters behind it.
LETTER, NUMBER, OTHER, BLANK, SPACE, APOS1, APOS2 = range(7)
# States: what the code point in front belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE, CONTRACTED = range(9)

# Code points with the property White_Space, and the contractions, of the pattern
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

BLOCK = 128


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point, from its Unicode category."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))  # no surrogates
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def _step(state: int, kind: int) -> int:
    if kind == LETTER:
        return {TWO_MORE: ONE_MORE, ONE_MORE: CONTRACTED}.get(state, IN_LETTERS)
    if kind in (APOS1, APOS2) and state not in (IN_OTHER, AFTER_SPACE):
        return ONE_MORE if kind == APOS1 else TWO_MORE
    return {NUMBER: IN_NUMBERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}.get(kind, IN_OTHER)


@lru_cache(1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the classes' functions give.

    Returns (functions: their values by state, product: the number of "first a, then b" by a and b,
    of_class: number of a class's function; of 7 + class: of the same at the start of a text).
    """
    base = [tuple(_step(s, k) for s in range(9)) for k in range(7)]
    base += [(f[START],) * 9 for f in base]
    functions = list(dict.fromkeys(base))
    for f in functions:  # grows
        for g in base:
            h = tuple(g[f[s]] for s in range(9))
            if h not in functions:
                functions.append(h)
    at = {f: i for i, f in enumerate(functions)}
    product = np.array([[at[tuple(g[f[s]] for s in range(9))] for g in functions] for f in functions], np.uint16)
    assert len(functions) ** 2 <= 256  # products are looked up by one byte
    return np.array(functions, np.uint8), product, np.array([at[f] for f in base], np.uint8)


def _lookup(table: bytes, index: np.ndarray) -> np.ndarray:
    """table[index] for unsigned bytes."""
    return np.frombuffer(index.tobytes().translate(table), np.uint8)


def _table(values: np.ndarray) -> bytes:
    return values.astype(np.uint8).ravel().tobytes().ljust(256, b"\0")


def states_before(f: np.ndarray) -> np.ndarray:
    """State in front of each function's code point, by a scan: totals of blocks, their prefixes (the same scan), then within blocks."""
    functions, product, of_class = transition_monoid()
    k = np.uint8(len(functions))
    then, step = _table(product), _table(functions.T)  # by first and second function; by state and function
    n = len(f)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, of_class[OTHER], np.uint8)  # what is behind the end doesn't matter
    grid[:n] = f
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    state = np.full(1, START, np.uint8)
    if blocks > 1:
        total = columns[0]
        for j in range(1, BLOCK):
            total = _lookup(then, total * k + columns[j])
        state = states_before(total)
    out = np.empty((BLOCK, blocks), np.uint8)
    for j in range(BLOCK):
        out[j] = state
        state = _lookup(step, state * k + columns[j])
    return np.ascontiguousarray(out.T).ravel()[:n]


# By state: whether a code point of the class starts a piece there (white space: see pieces()).
_STARTS = np.ones((9, 7), bool)
for _kind, _in in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (APOS1, IN_OTHER), (APOS2, IN_OTHER)):
    _STARTS[_in, _kind] = _STARTS[AFTER_SPACE, _kind] = False
_STARTS[[ONE_MORE, TWO_MORE], LETTER] = False
for _kind in (BLANK, SPACE):
    _STARTS[[AFTER_BLANK, AFTER_SPACE], _kind] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each piece of the texts in ``data`` (UTF-8), and the index of each text's first piece (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ascii_only = not (data & 0x80).any()
    if ascii_only:
        at, points = None, data
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(at) != len(points):
            raise ValueError("text is not valid UTF-8")
    n = len(points)
    kinds = class_table()[points]
    first = np.zeros(n + 1, bool)
    bounds = offsets if ascii_only else np.searchsorted(at, offsets)
    first[bounds] = True
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        ahead = np.zeros((2, len(marks)), np.uint32)
        inside = np.ones(len(marks), bool)
        for d in range(2):
            ok = marks + d + 1 < n
            inside &= ok & ~first[np.minimum(marks + d + 1, n)]
            ahead[d] = np.where(inside, points[np.minimum(marks + d + 1, n - 1)], 0)
        for c in CONTRACTIONS:
            hit = ahead[0] == ord(c[0])
            if len(c) == 2:
                hit &= ahead[1] == ord(c[1])
            kinds[marks[hit]] = APOS1 if len(c) == 1 else APOS2
    of_class = transition_monoid()[2]
    before = states_before(_lookup(_table(of_class), kinds + np.uint8(7) * first[:n].view(np.uint8)))
    before[first[:n]] = START
    starts = _lookup(_table(_STARTS), before * np.uint8(7) + kinds).astype(bool)
    # Of white space with something behind it, the last code point stands alone (or leads the next piece).
    white = (kinds == SPACE) | (kinds == BLANK)
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:] & ~first[1:n]
    starts |= white & follows
    where = np.flatnonzero(starts)
    firsts = np.searchsorted(where, bounds)
    return (where if ascii_only else at[where]), firsts


def spread(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at ``offsets`` and have ``counts`` elements, one after the other."""
    total = np.cumsum(counts)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(offsets - (total - counts), counts)


class Ragged:
    """Values of many rows in one array: row i is values[offsets[i]:offsets[i + 1]]."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets

    def take(self, rows: np.ndarray) -> "Ragged":
        counts = self.offsets[rows + 1] - self.offsets[rows]
        return Ragged(self.values[spread(self.offsets[rows], counts)], np.concatenate([[0], np.cumsum(counts)]))


class PieceCache:
    """Ids of the pieces seen so far, by hash, in sorted segments of growing size; beyond ``most`` pieces it starts anew."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.segments: list[tuple[np.ndarray, Ragged]] = []

    def add(self, keys: np.ndarray, ids: Ragged) -> None:
        if sum(len(k) for k, _ in self.segments) + len(keys) > self.most:
            self.segments = []
        if len(keys) > self.most or not len(keys):
            return
        self.segments.append((keys, ids))
        while len(self.segments) > 1 and len(self.segments[-2][0]) < 2 * len(self.segments[-1][0]):
            (a, x), (b, y) = self.segments[-2:]
            every = np.concatenate([a, b])
            order = np.argsort(every, kind="stable")
            both = Ragged(np.concatenate([x.values, y.values]), np.concatenate([x.offsets, x.offsets[-1] + y.offsets[1:]]))
            self.segments[-2:] = [(every[order], both.take(order))]


class ByPiece:
    """Encodes batches of texts piece by piece; ``encode_pieces(data, starts, ends) -> Ragged`` does the distinct new ones.

    Pieces are told apart by 64-bit hashes, among those of a batch and a cache.
    """

    def __init__(self, encode_pieces, most: int = 1 << 20):
        self.encode_pieces, self.cache = encode_pieces, PieceCache(most)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Ragged, np.ndarray, np.ndarray]:
        """Ids of each text; first byte of each piece (with the end), and the number of ids of each piece."""
        starts, firsts = pieces(data, offsets)
        if not len(starts):
            return Ragged(np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)), np.zeros(1, np.int64), np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        keys = hash_slices(data, starts, ends)
        unique, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        counts, got, todo = np.zeros(len(unique), np.int64), [], np.arange(len(unique))
        for known, ids in self.cache.segments:
            at = np.minimum(np.searchsorted(known, unique[todo]), len(known) - 1)
            hit = known[at] == unique[todo]
            got.append((todo[hit], ids.take(at[hit])))
            todo = todo[~hit]
        fresh = self.encode_pieces(data, starts[sample[todo]], ends[sample[todo]])
        got.append((todo, fresh))
        self.cache.add(unique[todo], fresh)
        for rows, ids in got:
            counts[rows] = np.diff(ids.offsets)
        at = np.concatenate([[0], np.cumsum(counts)])
        values = np.empty(at[-1], np.uint32)
        for rows, ids in got:
            values[spread(at[rows], counts[rows])] = ids.values
        out = Ragged(values, at).take(inverse)
        return Ragged(out.values, out.offsets[firsts]), np.append(starts, len(data)), np.diff(out.offsets)


class Bpe:
    """Byte-pair merging by ranks (the rank is the id): of all adjacent pairs the lowest, leftmost first."""

    NONE = np.uint32(0xFFFFFFFF)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.ranks.values()) + 1
        if n > 1 << 16:
            raise ValueError("ids must be below 65,536")
        words = [b""] * n
        for word, i in self.ranks.items():
            words[i] = word
        self.bytes = Ragged(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in words])]))
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        pairs = [(self.ranks[a], self.ranks[b], i) for word, i in self.ranks.items() for cut in range(1, len(word)) if (a := word[:cut]) in self.ranks and (b := word[cut:]) in self.ranks]
        p = np.array(pairs, np.uint64).reshape(-1, 3)
        self.bits = int(len(p) * 4).bit_length()
        self.slot_key = np.full(1 << self.bits, self.NONE, np.uint32)
        self.slot_rank = np.full(1 << self.bits, self.NONE, np.uint32)
        keys, ranks = (p[:, 0] << np.uint64(16) | p[:, 1]).astype(np.uint32), p[:, 2].astype(np.uint32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # open addressing: of those that want a free slot, one gets it
            free = todo[self.slot_key[at[todo]] == self.NONE]
            self.slot_key[at[free]] = keys[free]
            won = free[self.slot_key[at[free]] == keys[free]]
            self.slot_rank[at[won]] = ranks[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.by_piece = ByPiece(self._encode_pieces)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << np.uint32(16)) | right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != self.NONE))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found != self.NONE)]
        return out

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        length = ends - starts
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = data.tobytes()
        whole = np.array([self.ranks.get(raw[s:e], -1) for s, e in zip(starts.tolist(), ends.tolist())], np.int64).reshape(-1)
        known = np.flatnonzero(whole >= 0)
        counts[known] = 1
        done.append((known, whole[known].astype(np.uint32), np.ones(len(known), np.int64)))
        rest = np.flatnonzero(whole < 0)
        for n in np.unique(length[rest]).tolist():
            rows = rest[length[rest] == n]
            if n > 64:
                for r in rows.tolist():
                    ids = np.array(self._merge_long(raw[starts[r] : ends[r]]), np.uint32)
                    counts[r] = len(ids)
                    done.append((np.array([r]), ids, np.array([len(ids)])))
                continue
            step = max(1, (1 << 18) // n)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, lens = self._merge_equal(self.byte_id[data[starts[part][:, None] + np.arange(n)]])
                counts[part] = lens
                done.append((part, ids, lens))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        values = np.empty(offsets[-1], np.uint32)
        for rows, ids, lens in done:
            values[spread(offsets[rows], lens)] = ids
        return Ragged(values, offsets)

    def _merge_equal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of one length together: in each round every row merges its best pair."""
        m, n = ids.shape
        lens = np.full(m, n)
        out = np.zeros((m, n), np.uint32)
        rows = np.arange(m)
        while len(rows):
            width = ids.shape[1]
            if width > 1:
                ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
                ranks[np.arange(width - 1) >= (lens[rows] - 1)[:, None]] = self.NONE
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(rows)), best]
                more = rank != self.NONE
            else:
                more = np.zeros(len(rows), bool)
            out[rows[~more], :width] = ids[~more]
            ids, rows = ids[more], rows[more]
            if not len(rows):
                break
            best, rank = best[more], rank[more]
            at = np.arange(width)
            ids = np.where(at > best[:, None], np.concatenate([ids[:, 1:], ids[:, -1:]], 1), ids)
            ids[np.arange(len(rows)), best] = rank
            lens[rows] -= 1
            ids = ids[:, : lens[rows].max()]
        return out[np.arange(n) < lens[:, None]], lens

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of pairs over a linked list."""
        words: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        before, after = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
        heap = [(r, i, 2) for i in range(len(piece) - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if words[i] is None or (j := after[i]) < 0 or len(words[i]) + len(words[j]) != size:
                continue
            words[i], words[j] = words[i] + words[j], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.ranks.get(both := words[a] + words[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(both)))
        return [self.ranks[x] for x in words if x is not None]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Ragged:
        """Token ids of each text."""
        return self.by_piece.encode(data, offsets)[0]

    def decode(self, ids: Ragged) -> Ragged:
        """Bytes of each row of ids."""
        got = self.bytes.take(ids.values.astype(np.int64))
        return Ragged(got.values, got.offsets[ids.offsets])


@lru_cache(2)
def tokenizer(path: str) -> Bpe:
    """One for each Python worker, with its cache."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ids (array of int) and ends (for each id, the byte of the text where it ends) to the columns of ``df``.

    A null text counts as empty: no ids.  Where ``df`` has columns of these names, underscores are
    added to the new ones.  Texts of any length are encoded whole; rows keep their partition.
    """
    ship(df.sparkSession)
    ids_col, ends_col = free_name(df, "ids"), free_name(df, "ends")
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(ends_col, T.ArrayType(T.IntegerType(), False))])

    @lean
    def run(batches):
        b = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, text_col):
                data, offsets = utf8(column(part, text_col))
                ids = b.encode(data, offsets)
                sizes = np.diff(b.bytes.offsets)[ids.values.astype(np.int64)]
                ends = np.cumsum(sizes) - np.repeat(offsets[:-1], np.diff(ids.offsets))
                at = pa.array(ids.offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(ids.values.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int32)))], names=[*part.schema.names, ids_col, ends_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary) to the columns of ``df``; null ids decode to no bytes."""
    ship(df.sparkSession)
    name = free_name(df, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    @lean
    def run(batches):
        b = tokenizer(path)
        for batch in batches:
            lists = column(batch, ids_col)
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            ids = Ragged(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.concatenate([[0], np.cumsum(counts)]))
            out = b.decode(ids)
            raw = out.values.tobytes()
            at = out.offsets.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:])], pa.binary())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, and its ids are decoded.

    A null text counts as empty, so that both digests are those of no bytes.  No row is left out,
    repeated or null ids included.
    """
    ship(df.sparkSession)
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digests(values: np.ndarray, offsets: np.ndarray) -> list[str]:
        view = memoryview(values).cast("B") if len(values) else memoryview(b"")
        at = offsets.tolist()
        return [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(at[:-1], at[1:])]

    @lean
    def run(batches):
        b = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = b.encode(*utf8(column(part, "text")))
                back = b.decode(ids)
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), pa.array(np.diff(ids.offsets), pa.int64()),
                    pa.array(digests(np.ascontiguousarray(ids.values.astype("<u4")), ids.offsets * 4), pa.string()), pa.array(digests(np.ascontiguousarray(back.values), back.offsets), pa.string()),
                ], names=schema.names)

    return d.mapInArrow(run, schema)
