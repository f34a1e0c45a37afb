import numpy as np
import pytest

from palimpsest.llm import vectors


def brute(rows, t=0.9):
    ok = {k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    by_length = {}
    for k in sorted(ok):
        by_length.setdefault(len(rows[k][1]), []).append(k)
    links = {}
    for members in by_length.values():
        x = np.array([np.float32(rows[k][1]) for k in members], float)
        near = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= t
        for i, k in enumerate(members):
            links[k] = [members[j] for j in np.flatnonzero(near[i]).tolist() if members[j] != k]
    out, root = [], {}
    for k, (i, _) in enumerate(rows):
        if k not in root:
            seen, todo = {k}, [k]
            while todo:
                for j in links.get(todo.pop(), []):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            root |= {j: min(ids) if ids else None for j in seen}
        out.append((i, len(links.get(k, [])), root[k]))
    return out


def same(got, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block,leaf", [(2048, 256), (16, 4)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    rng = np.random.default_rng(block)
    centers = rng.normal(size=(12, 8))
    rows = [(int(i), (centers[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.1, 0.3, 0.5])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)] + [(340, [2 * x for x in rows[3][1]]), (341, [0.0] * 8), (342, None), (343, [float("nan")] + [1.0] * 7), (344, [None] + [1.0] * 7), (345, [float("inf")] * 8), (346, [1.0]), (347, []), (None, rows[5][1]), (None, [1.0] + [0.0] * 7), (3, rows[3][1])]
    rows += [(400, [1.0, 2.0, 3.0]), (401, [1.0, 2.0, 3.1]), (402, [3.0, -1.0, 0.0]), (403, [2.0]), (404, [-2.0])]  # other lengths
    rows += [(500, [1.0] + [0.0] * 7), (501, [9.0, 3.0, 3.0, 1.0] + [0.0] * 4), (502, [18.0, 6.0, 2.0, -6.0] + [0.0] * 4), (503, [5.0, -0.1] + [0.0] * 6)]  # cosines of exactly 0.9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("v", "w", "node", "h1", "dims", "place", "path"):
        df = df.withColumn(c, vectors.F.lit(1))
    df = df.repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LEAF", leaf)
    got = vectors.links_and_components(df).collect()
    same(got, rows)


def test_thousands_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(150, 48))
    x = centers[rng.integers(0, 150, 4000)] + 0.25 * rng.normal(size=(4000, 48)) * rng.choice([0.3, 1, 1.6], size=(4000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    same(vectors.links_and_components(df).collect(), rows)


def test_pairs_of_blocks(spark):
    """The tree of intervals gives all pairs of blocks whose boxes may be near, and no other: few, where clusters are larger than blocks."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 48))
    x = centers[rng.integers(0, 12, 4000)] + 0.15 * rng.normal(size=(4000, 48))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    classes = df.select(vectors.F.col("vec_id").alias("node"), vectors.F.lit(1).cast("long").alias("w"), vectors.F.col("embedding").alias("v"), vectors.F.lit(48).alias("dims"), vectors.F.hash("embedding").alias("h2"))
    axes = vectors._axes(classes)
    blocks = vectors._write_blocks(vectors._sequence(classes, axes, 0.4472, 128), axes, 128).cache()
    pairs = vectors.block_pairs(blocks, 0.2 + vectors.SLACK).collect()
    boxes = blocks.collect()
    assert sum(b["n"] for b in boxes) == 4000 and len(boxes) > 20
    apart = lambda a, b: sum(max(0, p - q, r - s) ** 2 for p, q, r, s in zip(b["lo"], a["hi"], a["lo"], b["hi"]))
    want = {frozenset((a["path"], b["path"])) for a in boxes for b in boxes if apart(a, b) <= 0.2 + vectors.SLACK}
    assert {frozenset((r["path"], r["path2"])) for r in pairs} == want and len(pairs) == len(want) < 0.5 * len(boxes) * (len(boxes) + 1) / 2


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.links_and_components(df).count() == 0
    assert vectors.links_and_components(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0]["n_links"] == 0
