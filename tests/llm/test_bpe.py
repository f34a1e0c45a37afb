import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from palimpsest.llm import bpe
from palimpsest.llm.words import utf8

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(PATH)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def encoded(ours, texts):
    r = ours.encode(*utf8(pa.array(texts, pa.string())))
    return [r.values[a:b].tolist() for a, b in zip(r.offsets[:-1], r.offsets[1:])]


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "9", "!", "　", "\xa0", "中", "🙂", "'s", "'ll", "<|endoftext|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=8))
def test_like_tiktoken(ours, theirs, texts):
    assert encoded(ours, texts) == [theirs.encode_ordinary(x) for x in texts]


def test_long_pieces_and_batches(ours, theirs):
    texts = ["", "a" * 5000, " " * 2000, "=-" * 700 + "\n" * 70, "xyzzy" * 400, "'" * 33]
    assert encoded(ours, texts) == [theirs.encode_ordinary(x) for x in texts]


def test_scan_agrees_with_steps():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 14, 1000)
    functions, _, of_class = bpe.transition_monoid()
    state, want = bpe.START, []
    for k in of_class[f]:
        want.append(state)
        state = functions[k][state]
    assert bpe.states_before(of_class[f]).tolist() == want


def test_cache_starts_anew(theirs):
    b = bpe.Bpe(PATH)
    b.by_piece.cache.most = 5
    for _ in range(3):
        assert encoded(b, ["some words of a text", "other words"]) == [theirs.encode_ordinary(x) for x in ("some words of a text", "other words")]


def test_round_trip(docs, rows, theirs):
    got = Counter(tuple(r) for r in bpe.round_trip(docs, PATH).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(theirs.encode_ordinary(text or ""), "<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want


def test_encode_and_decode_keep_columns(docs, empty, theirs):
    out = bpe.encode(docs, PATH)
    assert out.columns == [*docs.columns, "ids_", "ends"]  # ``ids`` is taken
    for r in bpe.decode(out, PATH, "ids_").collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw and r["ids_"] == theirs.encode_ordinary(r["text"] or "")
        assert [theirs.decode_single_token_bytes(i) for i in r["ids_"]] == [raw[a:b] for a, b in zip([0, *r["ends"]], r["ends"])]
    assert bpe.encode(empty, PATH).count() == bpe.round_trip(empty, PATH).count() == 0
