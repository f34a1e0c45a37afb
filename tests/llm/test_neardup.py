import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import blocks, components, neardup
from palimpsest.llm.bpe import Ragged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [shingles(r[1]) for r in rows]
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            a = s[todo.pop()]
            for j, b in enumerate(s):
                if j not in seen and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(s[k]), min(ids) if ids else None))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_against_brute_force(docs, rows, empty):
    same(neardup.near_duplicates(docs)[1].collect(), brute(rows))
    assert neardup.near_duplicates(empty)[1].count() == neardup.dedup(empty).count() == 0


@pytest.mark.parametrize("cell", [(1 << 20, 1024), (3000, 8)])
def test_a_large_group_of_near_copies(spark, monkeypatch, cell):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(neardup, "CELL_SHINGLES", cell[0])
    monkeypatch.setattr(neardup, "CELL_SETS", cell[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(neardup.near_duplicates(df)[1].collect(), brute(rows))


def near_copies(rng, base, changed):
    t = list(base)
    for i in rng.sample(range(len(t)), changed):
        t[i] = f"x{rng.randrange(10**9)}"
    return t


def test_members_apart_from_the_lead(spark, monkeypatch):
    """Cells of few members: what hangs together with the lead only through members of other cells, or not at all, is found as well."""
    monkeypatch.setattr(neardup, "CELL_SETS", 4)
    rng = random.Random(12)
    rows, t = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):  # a chain: neighbours are similar, ends are not
        rows.append((i, " ".join(t)))
        t = t[1:] + [f"n{i}"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(neardup.near_duplicates(df)[1].collect(), brute(rows))
    # All in one group, whose lead is far from the rest; sets of numbers link when they are next to each other.
    nodes = [(0, n, 0, 40, 10, n) for n in range(40)]
    far = spark.createDataFrame(nodes, "grp long, node long, lead long, n long, n_cells int, value long")
    send = lambda m: m.select("grp", F.explode("cells").alias("c"), "node", F.col("value").cast("string").cast("binary").alias("payload")).select("grp", "c.*", "node", "payload")

    def next_to(a, b):
        x, y = (np.array([int(v) for v in w]) for w in (a, a if b is None else b))
        return np.nonzero((np.abs(x[:, None] - y[None, :]) == 1) & (x[:, None] > 0) & (y[None, :] > 0))

    got = {r["node"]: r["root"] for r in neardup.connected(far, send, next_to).collect()}
    assert got == {n: 1 for n in range(2, 40)}


def test_pairs_beyond_the_radius_are_dropped(spark):
    """A chain of neighbours at similarity 0.4: keys connect some of them, distances none."""
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(70 + 30 * 400)], []
    sets = [np.unique(neardup.hash_slices(*utf8_words(words[30 * i : 30 * i + 70]))) for i in range(400)]
    sig, _, _ = neardup.signatures(Ragged(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])))
    rows = [(i, s.tobytes()) for i, s in enumerate(sig)]
    classes = spark.createDataFrame(rows, "node long, sig binary").repartition(3).cache()
    assert neardup.shared_keys(classes).count() > 100
    assert neardup.candidate_groups(classes).count() == 0
    twins = spark.createDataFrame([*rows[:50], *((1000 + i, s) for i, s in rows[:50])], "node long, sig binary")
    assert neardup.candidate_groups(twins).count() == 50


def utf8_words(words):
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return data, ends - [len(w) for w in words], ends


@pytest.mark.parametrize("similarity,least", [(0.85, 0.999), (0.8, 0.99)])
def test_recall_at_the_limit(similarity, least):
    rng = np.random.default_rng(1)
    n, common = 2000, round(400 * similarity / (1 + similarity))
    a = [np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(n)]
    b = [np.unique(np.concatenate([x[:common], rng.integers(0, 1 << 62, 200 - common).astype(np.uint64)])) for x in a]
    sig = [neardup.signatures(Ragged(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])])))[0] for s in (a, b)]
    found = (neardup.chunk_keys(sig[0]) == neardup.chunk_keys(sig[1])).any(1) & ((sig[0] != sig[1]).sum(1) <= neardup.RADIUS)
    assert found.mean() >= least


def test_several_blocks_and_stretches(spark, monkeypatch, docs, rows):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "STRETCH", 2)
    monkeypatch.setattr(neardup, "PACK", 5)
    same(neardup.near_duplicates(docs)[1].collect(), brute(rows))
    assert neardup.dedup(docs).count() == neardup.near_duplicates(docs)[1].filter("leads").count()


def test_a_folder_that_is_not_there(tmp_path):
    with pytest.raises(FileNotFoundError):
        neardup._side(f"file://{tmp_path}/none", 0)
    for path in ("/no/scheme", "wasbs://x@y/z"):
        with pytest.raises(ValueError):
            neardup._side(path, 0)


def test_one_row_of_each_component(docs, rows):
    out = neardup.dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()
    leads = neardup.near_duplicates(docs)[1].filter("leads").collect()
    assert len(got) == len(leads) and len(got) < len(rows)
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r["doc_id"] for r in leads), key=key)


def test_keys_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.permutation(neardup.SYMBOLS)[: neardup.RADIUS]
        row[at] ^= 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(1).all()


def test_exact_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(90)]
    r = Ragged(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*(x.tolist() for x in neardup.linked(r, None, 60)))) == want
    left, right = r.take(np.arange(40)), r.take(np.arange(40, 90))
    across = {(i, j + 40) for i, j in zip(*(x.tolist() for x in neardup.linked(left, right, 60)))}
    assert across == {(i, j) for i, j in want if i < 40 <= j}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(90), 1000 + rng.randrange(90)) for _ in range(60)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
