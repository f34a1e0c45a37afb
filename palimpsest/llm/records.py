"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: length of the payload (8 bytes, little-endian), masked CRC-32C of those 8 bytes (4),
payload, masked CRC-32C of the payload (4).  A payload is the document's id (8 bytes, signed; the
smallest for null), then its ids in 2 or 4 bytes each.  The index file has, for each record, its
offset in the file and its number of ids (8 bytes each), so that records can be read in any order.

Files are written under names of their own for each attempt, and only the manifest, the table that
the job returns, says which of them count: a lost or repeated task leaves no trace in it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .batches import chunks, column, filesystem, lean
from .bpe import ByPiece, Ragged, spread
from .shared import qualified, scratch, ship, stored
from .words import utf8

POLYNOMIAL = 0x82F63B78  # CRC-32C, bits reversed
MASK_DELTA = 0xA282EAD8
BLOCK = 256
#: Bytes of text encoded at once, and pieces that a worker keeps: beside the sort of texts there is little room.
CHUNK, PIECES = 1 << 20, 1 << 19
#: Bytes of text for one file, and files at most (then they grow).
FILE_BYTES, MOST_FILES = 12 << 20, 100_000
NULL_ID = -(1 << 63)
SCHEMA = "part int, path string, index_path string, width int, n_records long, n_tokens long"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(by distance from a block's end and byte: its part of the checksum; by power of two: the advance over so many zero bytes)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(BLOCK - 1):
        rows.append(one[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    byte = np.arange(256, dtype=np.uint32)
    advance = []
    step = [one[(byte << (8 * k)) & 0xFF] ^ ((byte << np.uint32(8 * k)) >> 8) for k in range(4)]
    for _ in range(40):
        advance.append(np.stack(step))
        step = [_advance(x, advance[-1]) for x in step]
    return np.stack(rows[::-1]), np.stack(advance)


def _advance(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[0][crc & 0xFF] ^ by[1][(crc >> 8) & 0xFF] ^ by[2][(crc >> 16) & 0xFF] ^ by[3][crc >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice.  Slices are cut into blocks from their ends; zeros in front of a slice don't count."""
    table, advance = _tables()
    size = ends - starts
    n_blocks = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), n_blocks)
    left = n_blocks[row] - spread(np.zeros(len(size), np.int64), n_blocks)  # blocks from the end, 1 for the last
    padded = np.concatenate([np.zeros(BLOCK, np.uint8), data])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)
    at = ends[row] - left * BLOCK + BLOCK
    before = np.maximum(starts[row] + BLOCK - at, 0)  # bytes of a first block that lie in front of the slice
    part = np.empty(len(row), np.uint32)
    offset = np.arange(BLOCK, dtype=np.int32) * 256
    flat = table.ravel()
    for i in range(0, len(row), 1024):
        got = blocks[at[i : i + 1024]]
        short = np.flatnonzero(before[i : i + 1024])
        got[short] *= np.arange(BLOCK) >= before[i : i + 1024][short][:, None]
        part[i : i + 1024] = np.bitwise_xor.reduce(flat[got + offset], axis=1)
    crc = np.zeros(len(size), np.uint32)
    first = np.cumsum(n_blocks) - n_blocks
    by_block = advance[BLOCK.bit_length() - 1]
    todo, k = np.flatnonzero(n_blocks > 0), 0
    while len(todo):
        crc[todo] = _advance(crc[todo], by_block) ^ part[first[todo] + k]
        k += 1
        todo = todo[n_blocks[todo] > k]
    start = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0)).bit_length()):
        bit = ((size >> k) & 1).astype(bool)
        start[bit] = _advance(start[bit], advance[k])
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(doc_ids: np.ndarray, ids: Ragged, width: int) -> tuple[bytes, np.ndarray]:
    """Bytes of the records of these documents, and the size of each record."""
    counts = np.diff(ids.offsets)
    payload = 8 + counts * width
    size = payload + 16
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)

    def put(where: np.ndarray, values: np.ndarray, n: int) -> None:
        out[where[:, None] + np.arange(n)] = values.view(np.uint8).reshape(-1, n)

    put(at, payload.astype("<u8"), 8)
    put(at + 12, doc_ids.astype("<i8"), 8)
    out.view(f"<u{width}")[spread((at + 20) // width, counts)] = ids.values  # records are whole numbers of ids long
    put(at + 8, masked(crc32c(out, at, at + 8)).astype("<u4"), 4)
    put(at + 12 + payload, masked(crc32c(out, at + 12, at + 12 + payload)).astype("<u4"), 4)
    return out.tobytes(), size


def parse(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, Ragged]:
    """Document ids and token ids of the records at these offsets; both checksums of each are verified."""
    lanes = lambda where, kind, n: data[where[:, None] + np.arange(n)].copy().view(kind).reshape(-1)
    payload = lanes(offsets, "<u8", 8).astype(np.int64)
    if (masked(crc32c(data, offsets, offsets + 8)) != lanes(offsets + 8, "<u4", 4)).any():
        raise ValueError("a record's length doesn't match its checksum")
    if (masked(crc32c(data, offsets + 12, offsets + 12 + payload)) != lanes(offsets + 12 + payload, "<u4", 4)).any():
        raise ValueError("a record doesn't match its checksum")
    counts = (payload - 8) // width
    values = data.view(f"<u{width}")[spread((offsets + 20) // width, counts)].astype(np.uint32)
    return lanes(offsets + 12, "<i8", 8), Ragged(values, np.concatenate([[0], np.cumsum(counts)]))


@lru_cache(2)
def _library(path: str) -> ByPiece:
    """The tokenizers library, given each distinct piece of a batch once (its pre-tokenizer splits no piece further).

    Pieces of a blank and a run of what isn't white space can stand side by side in one text: the
    library begins a new piece at each blank.  Where its tokens end says which piece they are of.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    vocabulary = t.get_vocab()
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    n_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # one character stands for a byte

    def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x.ids, np.uint32) for x in t.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(got) if got else np.zeros(0, np.uint32), np.array([len(x) for x in got], np.int64)

    def side_by_side(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = ["".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in t.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(n_bytes[ids])
        last = np.searchsorted(ends, np.cumsum(sizes))
        if len(ends) != last[-1] + 1 or (ends[last] != np.cumsum(sizes)).any():
            raise RuntimeError("a token crosses the end of a piece")
        return ids, np.diff(np.concatenate([[0], last + 1]))

    def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        raw = data.tobytes()
        words = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist())]
        plain = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words], bool)
        counts, parts = np.zeros(len(words), np.int64), []
        for rows in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if len(rows):
                some = [words[r] for r in rows.tolist()]
                ids, counts[rows] = side_by_side(some, (ends - starts)[rows]) if plain[rows[0]] else one_by_one(some)
                parts.append((rows, ids))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        values = np.empty(offsets[-1], np.uint32)
        for rows, ids in parts:
            values[spread(offsets[rows], counts[rows])] = ids
        return Ragged(values, offsets)

    return ByPiece(encode, PIECES)


@lru_cache(2)
def _added(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """A pattern of the strings that the library takes out of a text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    known = model.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in known) or model.get("normalizer"):
        raise ValueError("added tokens that take spaces or whole words only, and normalizers, are not supported")
    ids = {t["content"].encode("utf-8"): t["id"] for t in known}
    longest_first = sorted(ids, key=len, reverse=True)
    return (re.compile(b"|".join(map(re.escape, longest_first))) if ids else None), ids


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> Ragged:
    """Ids of each text as by the library without its post-processing; strings of added tokens in a text get their ids."""
    pattern, known = _added(path)
    by_piece = _library(path)
    found: list[tuple[int, int, int]] = []  # (start, end, id)
    raw = data.tobytes()
    if pattern and pattern.search(raw):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [(m.start(), m.end(), known[m.group()]) for m in pattern.finditer(raw, a, b)]
    if not found:
        return by_piece.encode(data, offsets)[0]
    # Texts are cut at both ends of each such string; the parts are encoded by themselves, as the library does.
    at = np.array(found, np.int64)
    cuts = np.sort(np.concatenate([offsets, at[:, 0], at[:, 1]]), kind="stable")
    parts = by_piece.encode(data, cuts)[0]
    counts, values = np.diff(parts.offsets), parts.values
    # Of parts that begin there the last isn't empty: it is the string itself.
    special = np.searchsorted(cuts, at[:, 0], "right") - 1
    keep = np.ones(len(values), bool)
    keep[spread(parts.offsets[special], counts[special])] = False
    new = counts.copy()
    new[special] = 1
    out_at = np.concatenate([[0], np.cumsum(new)])
    out = np.empty(out_at[-1], np.uint32)
    plain = counts.copy()
    plain[special] = 0
    out[spread(out_at[:-1], plain)] = values[keep]
    out[out_at[special]] = at[:, 2]
    # Where a text begins: the first part of those that begin there which comes after the text in front.
    ends = np.searchsorted(cuts, offsets, "left")
    first = out_at[ends]
    first[-1] = out_at[-1]
    return Ragged(out, first)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, add ``end_id`` to each, and write record files in ascending order of ids; returns the manifest.

    Ids are those of the library with its own settings: the string of a special token in a text gets
    that token's id.  An id that doesn't fit into ``width`` bytes is an error.

    A null text counts as empty: it has the end id alone.  Null ids come first; rows with one id
    follow one another in the order of their texts' hashes.  ``width``: bytes of an id in the files.
    """
    import os

    spark = docs.sparkSession
    ship(spark)
    out, most = qualified(spark, out), CHUNK
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    d = d.repartitionByRange(min(MOST_FILES, size // FILE_BYTES + 1), *keys).sortWithinPartitions(*keys)

    @lean
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:12]}"
        index, n_tokens, at, sink = [], 0, 0, None
        for batch in batches:
            for piece in chunks(batch, "text", most):
                if sink is None:
                    sink = fs.open_output_stream(f"{name}.records")
                ids = encode_texts(tokenizer_path, *utf8(column(piece, "text")))
                counts = np.diff(ids.offsets)
                offsets = np.concatenate([[0], np.cumsum(counts + 1)])
                values = np.full(offsets[-1], end_id, np.uint32)
                values[spread(offsets[:-1], counts)] = ids.values
                if len(values) and values.max() >> (8 * width):
                    raise ValueError(f"an id doesn't fit into {width} bytes")
                doc_ids = column(piece, "doc_id").fill_null(NULL_ID).to_numpy()
                raw, sizes = frame(doc_ids, Ragged(values, offsets), width)
                sink.write(raw)
                index.append(np.stack([at + np.cumsum(sizes) - sizes, counts + 1], 1))
                at += len(raw)
                n_tokens += len(values)
        if sink is not None:
            sink.close()
            rows = np.concatenate(index).astype("<u8")
            with fs.open_output_stream(f"{name}.index") as f:
                f.write(rows.tobytes())
            uri = f"{out}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (f"{uri}.records", pa.string()), (f"{uri}.index", pa.string()), (width, pa.int32()), (len(rows), pa.int64()), (n_tokens, pa.int64()))], names=["part", "path", "index_path", "width", "n_records", "n_tokens"])

    return stored(d.mapInArrow(run, SCHEMA), "token-manifest")


def read_token_files(manifest: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, place) of every record, read back from the files.

    start: ids of all records before it.  Files are read in stretches of about ``most_bytes``.
    """
    ship(manifest.sparkSession)
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    files = files.repartition(max(1, manifest.count()))  # a number that is asked for isn't coalesced

    @lean
    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                fs, index_path = filesystem(f["index_path"])
                with fs.open_input_stream(index_path) as s:
                    index = np.frombuffer(s.read(), "<u8").reshape(-1, 2).astype(np.int64)
                fs, path = filesystem(f["path"])
                size = fs.get_file_info(path).size
                ends = np.append(index[1:, 0], size)
                first = f["before"] + np.cumsum(index[:, 1]) - index[:, 1]
                with fs.open_input_file(path) as s:
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(ends, index[i, 0] + most_bytes, "right")))
                        data = np.frombuffer(s.read_at(int(ends[j - 1] - index[i, 0]), int(index[i, 0])), np.uint8)
                        doc_ids, ids = parse(data, index[i:j, 0] - index[i, 0], f["width"])
                        raw = memoryview(np.ascontiguousarray(ids.values.astype("<u4"))).cast("B")
                        at = (ids.offsets * 4).tolist()
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(first[i:j], pa.int64()), pa.array(np.diff(ids.offsets), pa.int64()),
                            pa.array(crc, pa.int64()), pa.array(np.full(j - i, f["part"]), pa.int32()), pa.array(np.arange(i, j), pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "place"])
                        i = j

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, place long")


def read_records(path: str, index_path: str, rows: list[int], width: int = 2) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of chosen records of a file, in any order: one read each."""
    fs, p = filesystem(index_path)
    with fs.open_input_stream(p) as s:
        index = np.frombuffer(s.read(), "<u8").reshape(-1, 2).astype(np.int64)
    fs, p = filesystem(path)
    out = []
    with fs.open_input_file(p) as s:
        for r in rows:
            data = np.frombuffer(s.read_at(int(24 + (index[r, 1]) * width), int(index[r, 0])), np.uint8)
            doc_ids, ids = parse(data, np.zeros(1, np.int64), width)
            out.append((None if doc_ids[0] == NULL_ID else int(doc_ids[0]), ids.values))
    return out


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to the shared folder, then read back."""
    out = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, out, **options))
