import math
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import regex

from palimpsest.llm import langid
from palimpsest.llm.words import utf8

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    out = langid.identify(docs.select("doc_id", "text", "lang"), langid.fit(docs)).withColumn("held", langid.held_out()).toPandas()
    assert (out["held"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out["held"] & out["lang"].notna()]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert out["score"].between(0, 1).all() and out["rejected"].mean() < 0.02


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet(DOCUMENTS).limit(300)
    wrong = docs.withColumn("lang", langid.F.when(langid.held_out(), langid.F.lit("zz")).otherwise(docs["lang"]))
    assert "zz" not in langid.fit(wrong).languages


def test_short_texts():
    t = pq.read_table(DOCUMENTS, columns=["text", "lang"]).to_pandas().dropna()
    m = langid.train(t["text"].tolist()[:500], t["lang"].tolist()[:500])
    rest = t.iloc[500:]
    some = [" ".join(x.split()[:12]) for x in rest["text"]]
    best, _, _ = m.predict(*utf8(pa.array(some)))
    assert (rest["lang"].to_numpy() == [m.languages[b] for b in best]).mean() > 0.9


def test_odd_rows(docs, rows, empty):
    m = langid.fit(docs)
    out = langid.identify(docs, m)
    assert out.columns == [*docs.columns, "lang_pred_", "score", "rejected"]  # ``lang_pred`` is taken
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred_"] == "und") == (not letters)
        assert letters or (r["score"] == 0 and r["rejected"])
    assert out.count() == len(rows)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.accepted(docs).columns == docs.columns


def test_one_language_and_foreign_noise():
    m = langid.train(["some words here"] * 10, ["en"] * 10)
    best, score, rejected = m.predict(*utf8(pa.array(["words", "123"])))
    assert best.tolist() == [0, -1] and score[0] == 1 and rejected.tolist() == [False, True]
    rng = random.Random(1)
    mix = ["".join(rng.choice("abcdef ") for _ in range(80)) for _ in range(60)] + ["".join(rng.choice("uvwxyz ") for _ in range(80)) for _ in range(60)]
    m = langid.train(mix, ["x"] * 60 + ["y"] * 60)
    best, score, _ = m.predict(*utf8(pa.array(["abc fed abc", "xyz zyx uvw", "aubvcw dxeyfz"])))
    assert best.tolist()[:2] == [0, 1] and score[2] < min(score[:2])


def plain_scores(model, text):
    """Of one text, code point by code point; None without a letter."""
    low = []
    for c in text:
        if regex.fullmatch(r"\p{L}", c):
            low.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif low and low[-1]:
            low.append(0)
    if not any(low):
        return None
    total, n = [0.0] * len(model.languages), 0
    for order in langid.ORDERS:
        for i in range(len(low) - order + 1):
            h = order
            for x in low[i : i + order]:
                h = (h * 0x9E3779B97F4A7C15 + x) % 2**64
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 % 2**64
            total = [t + float(v) for t, v in zip(total, model.table[h >> (64 - langid.BUCKET_BITS)])]
            n += 1
    z = [(t / max(n, 1) + b) / model.temperature for t, b in zip(total, model.bias)]
    p = [math.exp(x - max(z)) for x in z]
    return [x / sum(p) for x in p]


def test_scores_against_plain_python(docs, rows, spark):
    model = langid.fit(docs)
    extra = [(100, "a", "en"), (101, "é", "de"), (102, "1 2 3", "en"), (103, "İstanbul ǅ ß", "de"), (104, "x" * 20_000 + " été", None)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    for r in langid.identify(df, model).collect():
        want = plain_scores(model, r["text"] or "")
        if want is None:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
        else:
            assert abs(r["score"] - max(want)) < 1e-6 and r["lang_pred"] == model.languages[want.index(max(want))]
            assert r["rejected"] == (r["score"] < model.threshold)


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i:03d}") for i in range(400)]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string").repartition(3)
    usable = sorted(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    table, languages = langid.sample(df)
    assert languages == usable
    got = table.filter("kind = 0").groupBy("lang").count().collect()
    assert {r["lang"] for r in got} == set(usable) and {r["count"] for r in got} == {1}  # equal rows are one
    assert langid.fit(df).languages == usable


def test_the_sample_is_bounded_and_the_same_again(spark):
    docs = spark.read.parquet(DOCUMENTS).limit(600).cache()
    same_id = docs.withColumn("doc_id", langid.F.lit(5).cast("long"))
    for d in (docs, same_id):
        a, b = (sorted(map(str, langid.sample(x, rows_a_language=20)[0].collect())) for x in (d, d.repartition(5)))
        assert a == b
        n = langid.sample(d, rows_a_language=20)[0].filter("kind = 0").groupBy("lang").count().collect()
        assert all(0 < r["count"] <= 20 for r in n)
