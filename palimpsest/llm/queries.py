"""Queries over the supplied tables, one for each operator, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, langid, mixing, neardup, quality, records, sharding, substrings, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))[0]


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, digest=True)


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links_and_components(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs)[1].select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_langid": op2_langid, "op3_sharding": op3_sharding, "op4_substrings": op4_substrings, "op5_records": op5_records, "op6_warc": op6_warc, "op7_mixing": op7_mixing, "op8_vectors": op8_vectors, "op9_quality": op9_quality, "op10_neardup": op10_neardup}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": OP4_SQL, "op6_warc": OP6_SQL, "op7_mixing": OP7_SQL, "op8_vectors": OP8_SQL, "op10_neardup": OP10_SQL}


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM (SELECT doc_id, i, unnest(range(35)) AS d FROM v SEMI JOIN again ON v.h = again.h)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT page_id, payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS with_words FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, sum(source_size::DOUBLE) OVER () AS whole,
    coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s2),
lv AS (SELECT arg_min((whole - full_) / rest, full_) AS level FROM s3 WHERE (whole - full_) / rest * w <= cap),
g AS (SELECT source, source_size, with_words, coalesce(least(level * w, cap), cap) AS target FROM s3 LEFT JOIN lv ON true),
e0 AS (SELECT d.*, source_size, with_words, target, least(coalesce(CASE WHEN source_size > 0 THEN target / source_size END, 0), 3.0::DOUBLE) AS e
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e1 AS (SELECT *, floor(e) AS sure, e - floor(e) AS pi FROM e0),
e2 AS (SELECT *, CASE WHEN size > 0 AND pi > 0 THEN (u / (1 - u)) / ((pi / (1 - pi)) * sqrt(size / (source_size / with_words))) END AS q FROM e1),
e3 AS (SELECT *, q / (1 + q) AS rank FROM e2),
p0 AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS open_, false AS in_ FROM e3),
@PASSES@
l AS (SELECT source, min({'far': abs(open_ - size) > target / 200, 'gap': CASE WHEN abs(open_ - size) > target / 200 THEN abs(open_ - size) ELSE 0 END, 'rank': rank, 'size': size, 'id': doc_id}) AS last FROM p3
  WHERE rank IS NOT NULL AND NOT in_ AND abs(open_ - size) < open_ GROUP BY source)
SELECT f.doc_id, f.source, f.size, source_size, target, (copies * f.size)::BIGINT AS taken, copies FROM (
  SELECT f.*, CASE WHEN f.size > 0 THEN (sure + CASE WHEN rank IS NOT NULL AND (in_ OR (last IS NOT NULL AND last.rank = rank AND last.size = f.size AND last.id IS NOT DISTINCT FROM f.doc_id)) THEN 1 ELSE 0 END) ELSE 0 END::INTEGER AS copies
  FROM p3 f LEFT JOIN l ON f.source IS NOT DISTINCT FROM l.source) f
"""
_PASS = """
a@K@ AS (SELECT *, rank IS NOT NULL AND NOT in_@FITS@ AS may FROM p@J@),
b@K@ AS (SELECT *, CASE WHEN may THEN sum(CASE WHEN may THEN size END) OVER (PARTITION BY source ORDER BY CASE WHEN may THEN 0 ELSE 1 END, rank NULLS LAST, size, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM a@K@),
p@K@ AS (SELECT * EXCLUDE (may, upto, open_, in_), open_ - coalesce(max(CASE WHEN upto <= open_ THEN upto END) OVER (PARTITION BY source), 0) AS open_, in_ OR coalesce(upto <= open_, false) AS in_ FROM b@K@),
"""
OP7_SQL = OP7_SQL.replace("@PASSES@", "".join(_PASS.replace("@K@", str(k)).replace("@J@", str(k - 1)).replace("@FITS@", "" if k == 1 else " AND size <= open_") for k in range(1, mixing.PASSES + 1)))

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(list_aggregate(ws[i : i + 4], 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - 3, 2)) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON doc_id = c.a LEFT JOIN n USING (doc_id)
"""
