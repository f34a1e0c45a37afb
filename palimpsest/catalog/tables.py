"""Aggregates, windows, order, sets and scalar functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import lenses
from ..functions import ident, text as fn
from ..lenses import INSTANCES_SQL, table
from ..operators import mining
from . import Catalog

CATALOG = Catalog()
q = CATALOG.add
INS = f"WITH {INSTANCES_SQL} "


def n_rows():
    return F.count(F.lit(1)).alias("n")


@q("a1_distinct", "SELECT DISTINCT event_type, user_id % 10 AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("k")).distinct()


@q("a2_single_candidate", "SELECT c_nationkey, min(c_mktsegment) AS segment FROM customer GROUP BY c_nationkey, c_custkey % 100 HAVING count(DISTINCT c_mktsegment) = 1")
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", F.col("c_custkey") % 100)
    return c.agg(F.count_distinct("c_mktsegment").alias("n"), F.any_value("c_mktsegment").alias("segment")).filter("n = 1").select("c_nationkey", "segment")


@q("a3_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(n_rows())


@q("a4_lifetimes", "SELECT user_id AS entity, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("version"), F.col("event_id").alias("idx"))
    return mining.lifetimes(e)


@q("a5_collected_sets", INS + "SELECT v0, grp, list_sort(list(DISTINCT pattern)) AS items, count(*) AS n FROM ins GROUP BY v0, grp")
def _(spark, d):
    return mining.essentials(lenses.instances(spark, d), ["v0", "grp"], "pattern")


@q("a6_enough_extras", INS + ", x AS (SELECT e0, count(*) AS n FROM ins WHERE pattern = 'click' GROUP BY e0) SELECT e1, coalesce(n, 0) AS n_extra FROM ins LEFT JOIN x USING (e0) WHERE pattern = 'purchase' AND coalesce(n, 0) >= 2")
def _(spark, d):
    i = lenses.instances(spark, d)
    buys = i.filter("pattern = 'purchase'")
    extras = i.filter("pattern = 'click'").select("e0").join(buys.select("e0", "e1"), "e0")
    return mining.with_enough(buys, extras, 2).select("e1", "n_extra")


@q("a7_pattern_shares", INS + "SELECT pattern, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ins GROUP BY pattern")
def _(spark, d):
    return mining.counts(lenses.instances(spark, d), ["pattern"])


@q("a8_primitive_changes", INS + "SELECT v0, v1, fid0, fid1, count(*) AS n FROM ins WHERE grp <> 'g0' AND pattern <> 'error' GROUP BY ALL")
def _(spark, d):
    i = lenses.instances(spark, d).withColumn("category", F.when(F.col("grp") == "g0", "File").otherwise("Node")).withColumn("change", F.when(F.col("pattern") == "error", "modified").otherwise("renamed"))
    return mining.primitive(i)


@q("a9_coverage", INS + "SELECT v0, v1, fid0, fid1, CASE WHEN grouping(fid1) = 0 THEN 0 WHEN grouping(v0) = 0 THEN 3 ELSE 15 END::BIGINT AS level, count(*) AS total, sum((pattern = 'click')::INT)::BIGINT AS identified, round(sum((pattern = 'click')::INT) / count(*)::DOUBLE, 6) AS coverage FROM ins GROUP BY GROUPING SETS ((v0, v1, fid0, fid1), (v0, v1), ())")
def _(spark, d):
    return mining.coverage(lenses.instances(spark, d).withColumn("identified", F.col("pattern") == "click"))


@q("a15_rename_frequency", "SELECT split_part(p_name, ' ', 1) AS old, p_brand AS new, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    p = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("old"), F.col("p_brand").alias("new"))
    return p.groupBy("old", "new").agg(n_rows()).filter("n > 1").orderBy(F.desc("n"), "old", "new")


@q("a16_rename_bonus", "SELECT p_brand AS old, p_type AS new, count(*) AS n, sum(p_size)::BIGINT AS bonus FROM part GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("old"), F.col("p_type").alias("new")).agg(n_rows(), F.sum("p_size").alias("bonus"))


@q("a17_move_groups", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("groups"))


@q("a18_lines_by_language", "SELECT lang, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) AS files FROM documents WHERE text IS NOT NULL GROUP BY lang")
def _(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.groupBy("lang").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count(F.lit(1)).alias("files"))


@q("w1_next_version", "SELECT DISTINCT v AS v0, lead(v) OVER (ORDER BY v) AS v1 FROM (SELECT DISTINCT substr(source, 4)::INT AS v FROM documents) QUALIFY v1 IS NOT NULL")
def _(spark, d):
    v = table(spark, d, "documents").select(F.substring("source", 4, 9).cast("int").alias("v")).distinct()
    return mining.consecutive(v, "v", "v").select("v0", "v1")


@q("w2_first_seen", INS + "SELECT v0, key, min(e1) AS e1 FROM ins GROUP BY v0, v1, key")
def _(spark, d):
    return mining.first_seen(lenses.instances(spark, d), ["e1"]).select("v0", "key", "e1")


@q("w2_precedence_any")
def _(spark, d):
    i = lenses.instances(spark, d).withColumn("key", F.array(F.col("key"), F.col("key") % 7))
    return mining.first_seen(i, ["e1"], parts=2, one_to_one=[True, True]).select("v0", "e1")


@q("w6_sibling_places", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS nth FROM lineitem")
def _(spark, d):
    from ..operators.edits import numbered

    return numbered(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", F.col("nth").cast("long").alias("nth"))


@q("o1_pairs_by_metric", INS + "SELECT v0, count(*) AS n FROM ins GROUP BY v0 ORDER BY n DESC, v0")
def _(spark, d):
    return lenses.instances(spark, d).groupBy("v0").agg(n_rows()).orderBy(F.desc("n"), "v0")


@q("o5_sampled_instances")
def _(spark, d):
    return mining.sampled(lenses.instances(spark, d), 10, seed=1)


@q("o6_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@q("o7_best_by_score", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': -o_orderkey}) AS best FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@q("u1_union", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name")))


@q("u2_set_operations", "SELECT 'both' AS how, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, d):
    o = table(spark, d, "orders")
    f, g = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(g).select(F.lit("both").alias("how"), "k").unionByName(f.subtract(g).select(F.lit("only").alias("how"), "k"))


@q("u3_mutual_pairs", "SELECT a.o_custkey AS c, a.o_orderkey AS o FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS o_orderkey FROM orders GROUP BY 1) b USING (o_custkey, o_orderkey)")
def _(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("o"))
    dear = o.groupBy(F.col("o_custkey").alias("c")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o"))
    return last.intersect(dear)


@q("u4_bag_difference", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@q("f1_concat", "SELECT c_custkey, c_name || '.' || c_mktsegment AS full FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("."), "c_mktsegment").alias("full"))


@q("f2_replace", "SELECT p_partkey, regexp_replace(p_brand, '[#$]', '.', 'g') AS v FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "[#$]", ".").alias("v"))


@q("f3_before_after", "SELECT c_custkey, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, 1, instr(c_name, '#') - 1) ELSE '' END AS head, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS tail, CASE WHEN instr(c_name, '<') > 0 THEN 'x' ELSE '' END AS none FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.before("c_name", "#").alias("head"), fn.after("c_name", "#").alias("tail"), fn.before("c_name", "<").alias("none"))


@q("f4_substring", "SELECT c_custkey, substr(c_mktsegment, 1, greatest(length(c_mktsegment) - 2, 0)) AS v FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.cut_ends("c_mktsegment").alias("v"))


@q("f5_casts", "SELECT p_partkey, p_size::VARCHAR AS s, try_cast(substr(p_brand, 7) AS BIGINT) AS n FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.substring("p_brand", 7, 99).try_cast("long").alias("n"))


@q("f6_digests", "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256, sha1('blob '::BLOB || strlen(coalesce(text, ''))::VARCHAR::BLOB || '\\x00'::BLOB || encode(coalesce(text, ''))) AS git FROM documents")
def _(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", fn.digest(t, "MD5").alias("md5"), fn.digest(t, "SHA1").alias("sha1"), fn.digest(t, "SHA256").alias("sha256"), fn.digest(t, "GIT").alias("git"))


@q("f6_long_digests")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *(fn.digest("text", x).alias(x.lower()) for x in ("SHA224", "SHA384", "SHA512")))


@q("f7_hex", "SELECT c_custkey, lower(hex(c_name)) AS h, c_name AS back FROM customer")
def _(spark, d):
    h = fn.hexed("c_name")
    return table(spark, d, "customer").select("c_custkey", h.alias("h"), fn.unhexed(h).alias("back"))


@q("f8_local_names", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN regexp_extract(url, '([^/#]*)$', 1) ELSE url END AS name, CASE WHEN starts_with(url, 'https://') THEN 's:' || substr(url, 9) ELSE url END AS short FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.local_name("url").alias("name"), fn.prefixed("url", {"s": "https://"}).alias("short"))


@q("f9_name_space", "SELECT page_id, regexp_extract(url, '^(.*[/#])[^/#]*$', 1) AS space FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.name_space("url").alias("space"))


@q("f10_entities", "SELECT event_id, 'DO-' || 'MD5_' || md5(event_type) || '-' || event_id || '-' || (event_id + 5) AS entity, 'MD5_' || md5(event_type) AS fid, event_id::INT AS so, (event_id + 5)::INT AS eo FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    so, eo = F.col("event_id"), F.col("event_id") + 5
    e = e.select("event_id", ident.entity("DO", ident.file_id("D", F.lit("MD5"), F.md5(F.col("event_type").cast("binary"))), ident.encode_range("O", {"so": so, "eo": eo})).alias("entity"))
    parts = ident.decode_entity(F.col("entity"))
    r = ident.decode_range("O", parts["range"])
    return e.select("event_id", "entity", parts["fid"].alias("fid"), r["so"].alias("so"), r["eo"].alias("eo"))


@q("f11_range_algebra", "SELECT l_orderkey, l_linenumber, (l_linenumber <= 3 AND 5 <= l_quantity) AS has, (l_linenumber <= 9 AND 3 <= l_quantity) AS meets, greatest(l_linenumber, 3)::BIGINT AS mso FROM lineitem WHERE l_quantity >= 3")
def _(spark, d):
    so, eo = F.col("l_linenumber"), F.col("l_quantity")
    li = table(spark, d, "lineitem").filter("l_quantity >= 3")
    return li.select("l_orderkey", "l_linenumber", ident.contains(so, eo, F.lit(3), F.lit(5)).alias("has"), ident.overlaps(so, eo, F.lit(3), F.lit(9)).alias("meets"), F.greatest(so, F.lit(3)).cast("long").alias("mso"))


@q("f15_affixes", "SELECT p_partkey, starts_with(p_type, 'PROMO') AS s, ends_with(p_type, 'STEEL') AS e, trim('  ' || p_name || ' ') AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_type").startswith("PROMO").alias("s"), F.col("p_type").endswith("STEEL").alias("e"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"))


@q("f16_escapes", "SELECT page_id, replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS nt, html AS back, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM pages")
def _(spark, d):
    nt = fn.escape_literal("html")
    return table(spark, d, "pages").select("page_id", nt.alias("nt"), fn.unescape_literal(nt).alias("back"), fn.escape_xml("html").alias("xml"))


@q("f17_titles", "SELECT DISTINCT source, upper(source[1]) || substr(source, 2) || ' File' AS title FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", fn.title(F.concat("source", F.lit("_file"))).alias("title"))


@q("f18_local_time", "SELECT event_id, strftime(ts + INTERVAL 540 MINUTE, '%Y-%m-%d %H:%M:%S') AS t FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", fn.local_time(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), F.lit(540)).alias("t"))


@q("f19_group_keys", "SELECT p_partkey, array_to_string(list_sort(string_split_regex(p_brand || '/' || p_type || ';' || p_size, '[/;]')), ';') AS k FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.group_key(F.concat("p_brand", F.lit("/"), "p_type", F.lit(";"), F.col("p_size").cast("string"))).alias("k"))


@q("f20_paths", "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, len(list_filter(string_split(url, '/'), lambda x: x <> ''))::INT AS depth, replace(lower(url), '-', '/') AS key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.path_parent("url").alias("parent"), F.size(fn.path_parts("url")).alias("depth"), fn.path_key("url").alias("key"))


@q("f21_version_keys", "SELECT DISTINCT 'GITREV:' || source AS v FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(ident.version_key(F.lit("GITREV"), F.col("source")).alias("v")).distinct()


@q("f22_json", "SELECT event_id, (props->>'k')::BIGINT AS k, '{\"k\":' || (props->>'k') || '}' AS again FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("p.k")).alias("again"))


@q("p18_path_prefixes", "SELECT page_id FROM pages WHERE (starts_with(url, 'https://a') OR starts_with(url, 'http')) AND NOT starts_with(url, 'http://')")
def _(spark, d):
    from ..sources.trees import selected

    p = table(spark, d, "pages").withColumn("path", F.col("url"))
    return selected(p, ["https://a", "http"], ["http://"]).select("page_id")


@q("p19_ignored", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    ignored = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ignored, "o_custkey", "left_anti").select("o_orderkey")


@q("p20_auxiliary", "SELECT p_partkey FROM part WHERE NOT ends_with(p_type, 'STEEL') AND NOT ends_with(p_type, 'TIN')")
def _(spark, d):
    from ..sources.trees import without_auxiliary

    return without_auxiliary(table(spark, d, "part").withColumn("name", F.col("p_type")), ["STEEL", "TIN"]).select("p_partkey")


@q("p23_without_files", INS + "SELECT pattern, e1 FROM ins WHERE NOT (fid0 = 'u1' AND fid1 = 'k1') AND pattern <> 'error'")
def _(spark, d):
    return lenses.instances(spark, d).filter("not (fid0 = 'u1' and fid1 = 'k1') and pattern <> 'error'").select("pattern", "e1")


@q("x7_grouped_patterns", INS + "SELECT v0, v1, grp, string_agg(DISTINCT pattern, ';' ORDER BY pattern) AS patterns, count(*) AS n FROM ins GROUP BY v0, v1, grp")
def _(spark, d):
    return mining.grouped(lenses.instances(spark, d))


@q("j2_across_versions", "SELECT a.doc_id AS d0, b.doc_id AS d1 FROM documents a JOIN documents b ON substr(b.source, 4)::INT = substr(a.source, 4)::INT + 1 AND a.doc_id // 20 = b.doc_id // 20")
def _(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.substring("source", 4, 9).cast("int").alias("v"), F.floor(F.col("doc_id") / 20).alias("slot"))
    pairs = mining.consecutive(v.select("v").distinct(), "v", "v").filter("v1 = v0 + 1")
    a, b = v.select(F.col("doc_id").alias("d0"), F.col("v").alias("v0"), "slot"), v.select(F.col("doc_id").alias("d1"), F.col("v").alias("v1"), "slot")
    return a.join(F.broadcast(pairs.select("v0", "v1")), "v0").join(b, ["v1", "slot"]).select("d0", "d1")  # one row a version


@q("j26_earliest_pair", INS + "SELECT key, arg_min({'v0': v0, 'v1': v1}, e1)['v0'] AS v0, min(e1) AS e1 FROM ins GROUP BY key")
def _(spark, d):
    return lenses.instances(spark, d).groupBy("key").agg(F.min_by("v0", "e1").alias("v0"), F.min("e1").alias("e1"))
