from collections import Counter, defaultdict
import re

from palimpsest.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= full
    return target


def check(out, slack):
    size, taken = defaultdict(int), defaultdict(int)
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = waterfill(size)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"]) and r["source_size"] == size[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= slack(s, want[s])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).collect()
    check(out, lambda s, t: max(30, 0.02 * t))
    assert sorted(out) == sorted(mixing.mix(docs.repartition(7)).collect())
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] for r in out)


def test_odd_rows(docs, rows, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    check(out, lambda s, t: 9000)
    assert mixing.mix(empty).count() == 0
    whole = Counter()
    for r in out:
        whole[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in got.collect()) == +whole


def test_weights_and_order(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a", float(i % 2)) for i in range(400)] + [(i, "w " * 10, "b", 1.0) for i in range(400, 800)], "doc_id long, text string, source string, q double")
    out = mixing.mix(df, weight_col="q", weights=(1, 3)).collect()
    assert all(r["copies"] == 0 for r in out if r["source"] == "a" and r["doc_id"] % 2 == 0)
    assert sum(r["taken"] for r in out if r["source"] == "a") == 2000
    other = mixing.mix(df, weight_col="q", weights=(1, 3), seed="other").collect()
    assert sorted(out) != sorted(other)


def test_inclusion_by_weight(spark):
    """Many sources with the same documents and other ids: how often each is in is what its odds say, the last place included."""
    sizes = [4, 8, 16, 30, 60, 120] * 40
    n = 25
    rows = [(g * 1000 + k, "w " * s, f"s{g:03d}") for g in range(n) for k, s in enumerate(sizes)] + [(10**6, "w " * (n * sum(sizes) // 2), "z")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), weights=(1,)).collect()
    check_one = {r["source"]: r["target"] for r in out}
    f = check_one["s000"] / sum(sizes) - 1  # one copy is certain
    assert 0.3 < f < 0.7
    got = [sum(r["copies"] - 1 for r in out if r["doc_id"] % 6 == (r["doc_id"] // 1000 * 1000 + k) % 6 and r["source"] != "z") / n / 40 for k in range(6)]
    lo, hi = 1e-6, 1e6
    mean = sum(sizes) / len(sizes)
    odds = lambda c, s: c * (s / mean) ** 0.5 / (1 + c * (s / mean) ** 0.5)
    for _ in range(200):
        c = (lo * hi) ** 0.5
        lo, hi = (c, hi) if sum(s * odds(c, s) for s in sizes) < f * sum(sizes) else (lo, c)
    assert all(abs(g - odds(c, s)) < 0.06 for g, s in zip(got, sizes)), (got, [odds(c, s) for s in sizes[:6]])
    assert got[-1] > got[0] + 0.15
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    off = [taken[s] - t for s, t in check_one.items() if s != "z"]
    assert max(map(abs, off)) <= 4


def test_all_documents_under_one_id(spark):
    df = spark.createDataFrame([(7, "w " * (1 + i % 5), "a") for i in range(100)] + [(i, "w " * 10, "b") for i in range(100)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 200
    check([r for r in out], lambda s, t: 100)
    assert sorted(out) == sorted(mixing.mix(df.repartition(5)).collect())
