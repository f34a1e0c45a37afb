import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.llm import warc
from palimpsest.llm.shared import scratch

PAGES = "page_id long, url string, html string, digest string, payload int, n int, first int"
LONG, OTHER = "<p>" + "x" * 200, "é" * 80


def pages(spark):
    rows = [(5, "http://a", LONG), (3, "http://b\r\nX: y", LONG), (9, None, LONG), (4, "u", "short"), (6, "u", "short"), (1, "u", None), (2, "u", ""), (None, "u", LONG), (7, "u", OTHER), (8, "u", OTHER), (3, "z", LONG), (10, "u", "a\r\n\r\nb" + LONG)]
    return spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], PAGES), rows


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i is not None and i > first[h]
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    return out


def test_archive(spark):
    df, rows = pages(spark)
    for compression in ("gzip", "none"):
        out = warc.archive_pages(df, compression=compression).drop("target_uri").collect()
        assert Counter(tuple(r) for r in out) == want(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_pushdown_and_splits(spark):
    path = scratch(spark, "warc")
    warc.register(spark)
    df = spark.range(600).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.concat(F.lit("p" * 8000), (F.col("id") % 50).cast("string")).alias("html"))
    warc.page_records(df).coalesce(1).write.format("warc").mode("append").option("path", path).option("index_bytes", 20_000).save()
    a = spark.read.format("warc").option("path", path).option("split_bytes", 100_000).load()
    assert a.rdd.getNumPartitions() > 1 and a.count() == 600
    revisits = a.filter("record_type = 'revisit' and record_id like '<urn:page:5%'")
    assert revisits.count() == sum(str(i).startswith("5") for i in range(50, 600))
    assert a.filter(F.col("record_type").isin("response")).select("payload").filter("payload is not null").count() == 50
    reader = warc.WarcReader({"path": path}, a.schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and reader.tests == [("record_type", "in", {"revisit"})]


def test_only_headers_are_inflated(spark, tmp_path):
    """Of skipped records, with and without lengths in their members; and payloads with blank lines or of several MB."""
    big = b"<p>\r\n\r\n" + bytes(range(256)) * 20_000
    rows = [{"record_type": "response" if i % 2 else "revisit", "record_id": f"<urn:page:{i}>", "payload": big if i % 2 else None, "payload_length": len(big)} for i in range(10)]
    plain = gzip.compress(warc.record(rows[1]))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(r)) for r in rows) + plain)
    assert gzip.decompress(warc.member(big)) == big
    for want_type, payload, most in (("revisit", False, 2 * 11 * 2048 + len(plain) + 2 * len(big)), ("response", True, 7 * len(big))):
        schema = "record_id string" + ", payload binary" * payload
        reader = warc.WarcReader({"path": f"file://{tmp_path}"}, spark.createDataFrame([], schema).schema)
        assert not list(reader.pushFilters([warc.EqualTo(("record_type",), want_type)]))
        made = []
        kept = warc._Gzip.__init__

        def counted(self, *args):
            kept(self, *args)
            made.append(self)

        warc._Gzip.__init__ = counted
        try:
            got = [x for part in reader.partitions() for batch in reader.read(part) for x in batch.to_pylist()]
        finally:
            warc._Gzip.__init__ = kept
        assert len(got) == (6 if payload else 5) and all(x["payload"] == big for x in got if payload)
        assert sum(x.inflated for x in made) < (most if payload else len(big) + 60_000)  # the member without lengths is inflated


def test_clashing_names_and_long_payloads(spark):
    rows = [(i, "u", ("<p>\r\n\r\n" + "x" * (3 << 20)) if i < 3 else f"page {i} " * 20) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("payload_length", "record_type", "payload", "digest", "first", "target_uri", "refers_to"):
        df = df.withColumn(c, F.lit(1))
    assert Counter(tuple(r) for r in warc.archive_pages(df).drop("target_uri").collect()) == want(rows)


def test_a_lost_task_leaves_no_records(spark, tmp_path):
    path = f"file://{tmp_path}"
    warc.register(spark)
    df, rows = pages(spark)
    warc.page_records(df).write.format("warc").mode("append").option("path", path).save()
    (tmp_path / "part-of-a-lost-attempt.warc").write_bytes(b"WARC/1.0\r\nbroken")
    assert warc.read_warc(spark, path, ["record_id"]).count() == len(rows)
