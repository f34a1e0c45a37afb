"""Each stage against plain Python, on documents with copies and passages."""

from collections import Counter

import corpus_pipeline as P
from palimpsest.llm import mixing, neardup
from test_neardup import brute as components
from test_substrings import brute as substrings


def table(spark, rows):
    return spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, rows):
    rows = [r[:5] for r in rows]
    docs = table(spark, rows)
    names = [n for n, _ in P.STAGES]
    assert names == ["langid", "neardup", "substrings", "mixing", "bpe"]
    assert all(f(spark, docs, "").columns == docs.columns for _, f in P.STAGES[:-1])
    ok = P.identify_language(spark, docs, "")
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert len(rows) - len(letters) <= len(rows) - ok.count() <= len(rows) - len(letters) + 3
    got = P.drop_near_duplicates(spark, docs, "")
    want = components([(k, r[1]) for k, r in enumerate(rows)])  # places for ids: each row counts
    assert got.count() == len({c for _, _, c in want})
    got = P.drop_repeated_substrings(spark, docs, "")
    want = Counter((r[0], kept if k else r[1], len(kept) if k else r[4]) for r, (_, k, kept) in zip(rows, substrings([r[1] for r in rows], 35)))
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == want
    got = P.mix_sources(spark, docs, "")
    assert got.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    out = P.encode(spark, docs, "").collect()
    assert len(out) == len(rows) and all(len(r["ids"]) == len(r["ends"]) for r in out)


def test_run(spark, empty):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "text", "ids"} <= set(out.columns)


def test_empty(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in P.STAGES:
        docs = f(spark, docs, "")
    assert docs.count() == 0


def test_near_copies_from_similarity_08(spark):
    """Sets of 180 shingles: with k last words changed, 180 - k of 180 + k are common."""
    rows = []
    for g, k in enumerate([20, 17, 21, 90]):  # 160 of 200, 163 of 197, 159 of 201, 90 of 270
        words = [f"g{g}w{i}" for i in range(184)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[:-k] + [f"x{w}" for w in words[-k:]]))]
    docs = table(spark, [(i, text, "en", "web", len(text)) for i, text in rows])
    got = sorted(r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == [0, 10, 20, 21, 30, 31]
    assert neardup.dedup(docs).count() == len(rows)  # op10's own limit is 0.85
