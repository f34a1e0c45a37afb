import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import records
from palimpsest.llm.bpe import Ragged
from palimpsest.llm.shared import scratch
from palimpsest.llm.words import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")


def crc_bitwise(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_checksums(parts):
    data = np.frombuffer(b"".join(parts) + b"xx", np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = records.crc32c(data, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [crc_bitwise(p) for p in parts]


def test_known_checksum():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9])).tolist() == [0xE3069283]


def test_frames_and_damage():
    ids = Ragged(np.array([1, 2, 3, 50256], np.uint32), np.array([0, 3, 3, 4]))
    raw, sizes = records.frame(np.array([7, -1, 9]), ids, 2)
    data = np.frombuffer(raw, np.uint8)
    at = np.cumsum(sizes) - sizes
    doc_ids, back = records.parse(data, at, 2)
    assert doc_ids.tolist() == [7, -1, 9] and back.values.tolist() == ids.values.tolist() and back.offsets.tolist() == ids.offsets.tolist()
    for place in (0, 9, 21, len(raw) - 1):
        bad = data.copy()
        bad[place] ^= 1
        with pytest.raises((ValueError, IndexError)):
            records.parse(bad, at, 2)


def test_against_the_library(docs, rows, spark):
    t = Tokenizer.from_file(PATH)
    out = sorted(records.token_files(docs, PATH).collect(), key=lambda r: (r["part"], r["place"]))
    start = 0
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want


SPECIAL = "<|endoftext|>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([SPECIAL, "<|endof", "text|>", " ", "\n", "a", " don't", "été", "<", "12"]), max_size=9).map("".join), min_size=1, max_size=6))
def test_special_tokens_in_texts(texts):
    """At the head, the end, doubled, inside words, and cut in two by the end of a text."""
    t = Tokenizer.from_file(PATH)
    got = records.encode_texts(PATH, *utf8(pa.array(texts)))
    assert [got.values[a:b].tolist() for a, b in zip(got.offsets[:-1], got.offsets[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_tokens_in_files(spark):
    texts = [SPECIAL, f"a {SPECIAL} b", f"{SPECIAL}{SPECIAL}x", f"word{SPECIAL}word", "", None, f"end{SPECIAL}"]
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in records.token_files(df, PATH).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_chunks_and_stretches(spark, monkeypatch):
    """Texts far beyond what is encoded and read at once."""
    monkeypatch.setattr(records, "CHUNK", 512)
    t = Tokenizer.from_file(PATH)
    texts = ["word été " * 4000, "x" * 30_000, "short", None] + [f"some text {i} {SPECIAL}" * 50 for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    manifest = records.write_token_files(df, PATH, scratch(spark, "tokens"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in records.read_token_files(manifest, 2000).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_shuffled_reads(docs, spark):
    manifest = records.write_token_files(docs, PATH, scratch(spark, "tokens"))
    rows = {(r["part"], r["place"]): r for r in records.read_token_files(manifest).collect()}
    for f in manifest.collect():
        order = list(range(f["n_records"]))[::-1]
        for place, (doc_id, ids) in zip(order, records.read_records(f["path"], f["index_path"], order)):
            r = rows[f["part"], place]
            assert (doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (r["doc_id"], r["n_tokens"], r["ids_crc32"])


def test_empty(empty):
    assert records.token_files(empty, PATH).count() == 0
