import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_statistics(docs, rows, empty):
    got = Counter(tuple(r) for r in quality.text_statistics(docs).select("doc_id", *quality.BASE).collect())
    assert got == Counter((r[0], *brute(r[1])) for r in rows)
    assert quality.text_statistics(empty).count() == 0


def test_learned_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels).cache()
    both = out.join(labels.filter("quality is not null"), "doc_id").filter("not base_failed").toPandas()
    assert both[both["quality"] == 1]["kept"].mean() > 0.97
    assert both[both["quality"] == 0]["kept"].mean() < 0.5
    assert out.filter("base_failed and kept").count() == 0 and out.count() == docs.count()


def test_rules_are_what_they_select():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] <= 0.5) | (x[:, 8] <= 0.15)
    rules = quality.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        assert len(r) <= quality.CONDITIONS and all(str(c) for c in r)
        hit |= quality._hits(r, x)
    assert (hit == bad).mean() > 0.95
    assert quality.learn(x, np.zeros(900, bool)) == [] == quality.learn(x[:0], bad[:0])


def test_verdict_as_columns(spark):
    rules = [[quality.Condition("symbol_share", True, 0.1), quality.Condition("n_words", False, 3.0)], [quality.Condition("n_words", True, 50.0)]]
    rows = [(2, 4, 40), (2, 1, 40), (60, 0, 10), (10, 9, 10)]
    df = spark.createDataFrame(rows, "n_words long, n_symbols long, n_bytes long")
    for c in [*quality.BASE, *quality.MORE]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1).cast("long"))
    got = [r["v"] for r in df.select(quality.verdict(rules).alias("v")).collect()]
    assert got == [True, True, False, True]
    got = [r["v"] for r in df.withColumn("n_bytes", F.lit(20)).select(quality.verdict(rules).alias("v")).collect()]
    assert got == [False, True, False, True]


def test_odd_rows(docs, rows, spark, empty):
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None), (1, 0), (1, 1)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    assert out.count() == len(rows)
    assert quality.judge(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert quality.judge(empty, labels).count() == 0
