import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from palimpsest.llm import blocks, substrings
from palimpsest.llm.words import hash_slices, split, utf8, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, width):
    ws = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in ws for k in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_against_brute_force(docs, rows):
    out = substrings.dedup_substrings(docs.select("doc_id", "text"), digest=True).collect()
    want = Counter((r[0], n, k, hashlib.sha256(t.encode()).hexdigest()) for r, (n, k, t) in zip(rows, brute([r[1] for r in rows], 35)))
    assert Counter(tuple(r) for r in out) == want
    assert sum(n for _, n, *_ in out) > sum(k for *_, k, _ in out) > 1000


def test_across_blocks_and_buckets(spark, monkeypatch):
    """Texts beyond a block, several blocks a partition and several stretches of answers."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(blocks, "STRETCH", 2)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([20, 60, 300, 3000])) + passage * (i % 3 == 0)) for i in range(90)]
    texts += [texts[4], texts[5][100:], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = substrings.dedup_substrings(df, digest=True).collect()
    want = Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in enumerate(brute(texts, 35)))
    assert Counter(tuple(r) for r in out) == want


def test_distinct_keys():
    rng = np.random.default_rng(6)
    for keys in (rng.integers(0, 9, (300, 2)).astype(np.uint64), np.stack([np.arange(200) % 70, np.arange(200) % 70], 1).astype(np.uint64), np.zeros((0, 2), np.uint64)):
        unique, at, counts = blocks.distinct(keys)
        want = Counter(map(tuple, keys.tolist()))
        assert dict(zip(map(tuple, unique.tolist()), counts.tolist())) == want and (unique[at] == keys).all()


def test_texts_and_clashing_columns(docs, rows, empty):
    out = substrings.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "n_words_", "n_removed"]
    want = Counter()
    for r, (n, k, kept) in zip(rows, brute([r[1] for r in rows], 35)):
        want[(*r[:1], kept if k else r[1], *r[2:], n, k)] += 1
    assert Counter(tuple(r) for r in out.collect()) == want
    assert substrings.dedup_substrings(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60).map(" ".join), min_size=1, max_size=5), st.integers(3, 12))
def test_equal_windows_have_equal_anchors(texts, width):
    data, offsets = utf8(pa.array(texts))
    starts, ends, first = split(data, offsets)
    keys = hash_slices(data, starts, ends)
    names, anchor = substrings.anchors(substrings.recompress(keys, first), len(keys), width)
    h, whole = windows(keys, first, width)
    seen = {}
    for i in np.flatnonzero(whole):
        value = None if anchor[i] < 0 else int(names[anchor[i]])
        assert seen.setdefault(int(h[i]), value) == value


def test_windows_hash_content_only():
    keys = np.arange(50, dtype=np.uint64)
    h, ok = windows(np.concatenate([keys, keys[::-1], keys]), np.array([0, 100, 150]), 35)
    assert (h[:16] == h[100:116]).all() and len(set(h[:16].tolist())) == 16 and not ok[70:100].any()
