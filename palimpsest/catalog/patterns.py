"""Graph patterns, joins on shared variables, inference and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import lenses
from ..functions.text import before
from ..lenses import FACTS_SQL
from ..operators import ranges
from ..plans.closure import closure
from ..plans.pattern import Bindings, Paths
from ..plans.store import FactStore
from . import Catalog

CATALOG = Catalog()
WITH = f"WITH {FACTS_SQL} "


def q(name: str, sql: str | None = None, recursive: bool = False):
    return CATALOG.add(name, sql and (WITH.replace("WITH", "WITH RECURSIVE", 1) if recursive else WITH) + sql)


def solve(spark: SparkSession, sf_dir: str) -> Bindings:
    return Bindings(Paths(lenses.store(spark, sf_dir)))


@q("p1_conjunction", "SELECT c.s AS c, n.o AS nation, r.o AS region FROM t c JOIN t n0 ON c.o = n0.s AND n0.p = 'inRegion' JOIN t n ON n.s = c.o AND n.p = 'name' JOIN t r ON r.s = n0.o AND r.p = 'name' WHERE c.p = 'inNation' AND c.s LIKE 'customer/%'")
def _(spark, d):
    b = solve(spark, d).match("?c a Customer", "?c inNation ?n", "?n inRegion ?r", "?n name ?nation", "?r name ?region")
    return b.rows.select("c", "nation", "region")


@q("p2_sequence_path", "SELECT b.o AS region, count(*) AS n FROM t a JOIN t b ON a.o = b.s AND b.p = 'inRegion' WHERE a.p = 'inNation' GROUP BY 1")
def _(spark, d):
    return solve(spark, d).match("?x inNation/inRegion ?region").rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@q("p3_alternative_path", "SELECT o, count(*) AS n FROM t WHERE p IN ('inNation', 'inRegion') GROUP BY o")
def _(spark, d):
    return solve(spark, d).match("?x inNation|inRegion ?o").rows.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


@q("p4_inverse_path", "SELECT o AS n, s AS x FROM t WHERE p = 'inNation'")
def _(spark, d):
    return solve(spark, d).match("?n ^inNation ?x").rows.select("n", "x")


@q("p5_anonymous", "SELECT DISTINCT o AS n FROM t WHERE p = 'inNation' AND s IN (SELECT s FROM t WHERE p = 'a' AND o = 'Supplier')")
def _(spark, d):
    return solve(spark, d).match("?n a Nation").where_exists("?any inNation ?n", "?any a Supplier").rows.select("n")


@q("p6_comparison", "SELECT s AS x, o AS name FROM t WHERE p = 'name' AND o > 'Customer#000000100' AND o <> 'Customer#000000101' AND s LIKE 'customer/%'")
def _(spark, d):
    return solve(spark, d).match("?x a Customer", "?x name ?name").where("name > 'Customer#000000100' and name <> 'Customer#000000101'").rows.select("x", "name")


@q("p7_in_list", "SELECT s AS x, o AS status FROM t WHERE p = 'status' AND o IN ('F', 'P')")
def _(spark, d):
    return solve(spark, d).match("?x status ?status").where(F.col("status").isin("F", "P")).rows.select("x", "status")


@q("p8_exists_under_or", "SELECT c.s AS c FROM t c WHERE c.p = 'a' AND c.o = 'Customer' AND (NOT EXISTS (SELECT 1 FROM t o WHERE o.p = 'by' AND o.o = c.s) OR EXISTS (SELECT 1 FROM t o JOIN t st ON o.s = st.s AND st.p = 'status' AND st.o = 'P' WHERE o.p = 'by' AND o.o = c.s))")
def _(spark, d):
    b = solve(spark, d).match("?c a Customer").flag("ordered", "?any by ?c").flag("pending", "?o by ?c", "?o status P")
    return b.where("not ordered or pending").rows.select("c")


@q("p9_bound", "SELECT n.s AS n, count(x.s) AS suppliers, sum(CASE WHEN x.s IS NULL THEN 1 ELSE 0 END)::BIGINT AS unbound FROM t n LEFT JOIN (SELECT a.s, a.o FROM t a WHERE a.p = 'inNation' AND a.s LIKE 'supplier/%') x ON x.o = n.s WHERE n.p = 'a' AND n.o = 'Nation' GROUP BY n.s")
def _(spark, d):
    b = solve(spark, d).match("?n a Nation").optional("?x inNation ?n", "?x a Supplier")
    return b.rows.groupBy("n").agg(F.count("x").alias("suppliers"), F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).alias("unbound"))


@q("p10_bind", "SELECT s AS n, o || '!' AS shout FROM t WHERE p = 'name' AND s LIKE 'nation/%'")
def _(spark, d):
    return solve(spark, d).match("?n a Nation", "?n name ?name").bind("shout", "concat(name, '!')").rows.select("n", "shout")


@q("p11_if_coalesce", "SELECT c.s AS c, CASE WHEN g.o = 'BUILDING' THEN 'b' ELSE coalesce(g.o, 'none') END AS kind FROM t c LEFT JOIN t g ON g.s = c.s AND g.p = 'segment' WHERE c.p = 'a' AND c.o IN ('Customer', 'Supplier')")
def _(spark, d):
    return solve(spark, d).match("?c a Party").optional("?c segment ?g").bind("kind", "if(g = 'BUILDING', 'b', coalesce(g, 'none'))").rows.select("c", "kind")


@q("p12_values", "SELECT n.s AS n, k.k FROM t n, (VALUES (1), (2), (3)) k(k) WHERE n.p = 'a' AND n.o = 'Nation'")
def _(spark, d):
    return solve(spark, d).match("?n a Nation").values("k", [1, 2, 3]).rows.select("n", "k")


@q("p13_computed_predicate", "SELECT s, 'in' || 'Nation' AS p, o FROM t WHERE p = 'inNation'")
def _(spark, d):
    from ..plans.pattern import construct

    b = solve(spark, d).match("?x a Party").bind("how", F.concat(F.lit("in"), F.lit("Nation")))
    facts = b.paths.store.facts().select(F.col("s").alias("x"), F.col("p").alias("how"), "o")
    return construct(b._join(facts), "?x ?how ?o")


@q("p14_ontology", "SELECT x.sub, count(*) AS n FROM (VALUES ('Customer', 'Party'), ('Supplier', 'Party')) x(sub, sup) JOIN t ON p = 'a' AND t.o = x.sub WHERE sup = 'Party' GROUP BY x.sub")
def _(spark, d):
    s = lenses.store(spark, d)
    ontology = spark.createDataFrame(lenses.CLASSES, "sub string, sup string").filter("sup = 'Party'")
    return s.scan("a").join(ontology, F.col("o") == F.col("sub")).groupBy("sub").agg(F.count(F.lit(1)).alias("n"))


@q("p15_two_graphs", "SELECT s AS x FROM t WHERE p = 'name' AND s LIKE 'region/%' EXCEPT SELECT s FROM t WHERE p = 'inRegion'")
def _(spark, d):
    f = lenses.facts(spark, d)
    first = FactStore.of(f.filter(F.col("s").startswith("region/")), lenses.ONTOLOGY)
    second = FactStore.of(f.filter(~F.col("s").startswith("region/")), lenses.ONTOLOGY)
    return first.scan("name").select(F.col("s").alias("x")).distinct().subtract(second.scan("inRegion").select("s"))


@q("p16_inference", "SELECT 'inferred' AS how, count(DISTINCT s) AS n FROM t WHERE p = 'a' AND o IN ('Customer', 'Supplier', 'Party', 'Agent') UNION ALL SELECT 'raw', count(*) FROM t WHERE p = 'a' AND o = 'Agent' UNION ALL SELECT 'properties', count(*) FROM t WHERE p IN ('in', 'inNation', 'inRegion', 'by', 'related')")
def _(spark, d):
    s = lenses.store(spark, d)
    one = lambda how, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n")
    return one("inferred", s.typed("Agent")).unionByName(one("raw", s.typed("Agent", infer=False))).unionByName(one("properties", s.scan("related")))


@q("p17_distinct_subselect", "SELECT DISTINCT b.o AS r, c.o AS segment FROM t a JOIN t b ON a.o = b.s AND b.p = 'inRegion' JOIN t c ON c.s = a.s AND c.p = 'segment' WHERE a.p = 'inNation'")
def _(spark, d):
    return solve(spark, d).match("?x inNation/inRegion ?r", "?x segment ?segment").distinct("r", "segment").rows


@q("j3_two_optionals", "SELECT c.s AS c, g.o AS segment, count(o.s) AS orders FROM t c LEFT JOIN t g ON g.s = c.s AND g.p = 'segment' LEFT JOIN t o ON o.o = c.s AND o.p = 'by' WHERE c.p = 'a' AND c.o IN ('Customer', 'Supplier') GROUP BY ALL")
def _(spark, d):
    b = solve(spark, d).match("?c a Party").optional("?c segment ?segment").optional("?o by ?c")
    return b.rows.groupBy("c", "segment").agg(F.count("o").alias("orders"))


@q("j4_anti_join", "SELECT s AS c FROM t WHERE p = 'a' AND o = 'Customer' AND s NOT IN (SELECT o FROM t WHERE p = 'by')")
def _(spark, d):
    return solve(spark, d).match("?c a Customer").unless("?o by ?c").rows.select("c")


@q("j5_two_predicate_guard", "SELECT s AS x FROM t c WHERE p = 'a' AND o IN ('Customer', 'Supplier') AND NOT (EXISTS (SELECT 1 FROM t a WHERE a.s = c.s AND a.p = 'segment') AND EXISTS (SELECT 1 FROM t a WHERE a.s = c.s AND a.p = 'inNation'))")
def _(spark, d):
    return solve(spark, d).match("?x a Party").unless("?x segment ?any1", "?x inNation ?any2").rows.select("x")


@q("j6_semi_join", "SELECT s AS c FROM t c WHERE p = 'a' AND o = 'Customer' AND EXISTS (SELECT 1 FROM t o JOIN t st ON o.s = st.s WHERE o.p = 'by' AND o.o = c.s AND st.p = 'status' AND st.o = 'P')")
def _(spark, d):
    return solve(spark, d).match("?c a Customer").where_exists("?o by ?c", "?o status P").rows.select("c")


@q("j7_nested_negation", "SELECT DISTINCT c.s AS c FROM t c WHERE c.p = 'a' AND c.o = 'Customer' AND EXISTS (SELECT 1 FROM t o WHERE o.p = 'by' AND o.o = c.s) AND NOT EXISTS (SELECT 1 FROM t o WHERE o.p = 'by' AND o.o = c.s AND NOT EXISTS (SELECT 1 FROM t st WHERE st.s = o.s AND st.p = 'status' AND st.o IN ('F', 'O')))")
def _(spark, d):
    """Customers all of whose orders have one of two statuses: the bad pairs first, then an anti-join."""
    b = solve(spark, d)
    good = b.match("?o status ?st").where(F.col("st").isin("F", "O")).rows.select("o").distinct()
    bad = b.match("?o by ?c").rows.join(good, "o", "left_anti").select("c").distinct()
    return b.match("?c a Customer").where_exists("?o by ?c").rows.join(bad, "c", "left_anti").select("c")


@q("j8_computed_key", "SELECT a.s AS c, b.s AS sup FROM t a JOIN t b ON replace(a.o, 'Customer', 'Supplier') = b.o WHERE a.p = 'name' AND b.p = 'name' AND a.s LIKE 'customer/%' AND b.s LIKE 'supplier/%'")
def _(spark, d):
    b = solve(spark, d).match("?c a Customer", "?c name ?cn").bind("key", "replace(cn, 'Customer', 'Supplier')")
    return b.match("?sup name ?key", "?sup a Supplier").rows.select("c", "sup")


@q("j9_disjunctive_key", "SELECT DISTINCT a.s AS c, b.s AS n FROM t a JOIN t b ON b.p = 'a' AND b.o = 'Nation' AND (b.s = a.o OR b.s = 'nation/' || split_part(a.s, '/', 2)) WHERE a.p = 'inNation' AND a.s LIKE 'customer/%'")
def _(spark, d):
    """Either key is a row of its own, so that the join stays an equi-join."""
    b = solve(spark, d).match("?c a Customer", "?c inNation ?own")
    b = b.bind("n", F.explode(F.array_distinct(F.array("own", F.concat(F.lit("nation/"), F.split("c", "/")[1])))))
    return b.match("?n a Nation").distinct("c", "n").rows


@q("j10_numeric_condition", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 20")
def _(spark, d):
    c, o = lenses.table(spark, d, "customer"), lenses.table(spark, d, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > c.c_acctbal * 20)).select(F.col("c_custkey").alias("c"), F.col("o_orderkey").alias("o"))


@q("f3_before", "SELECT s, CASE WHEN instr(o, '#') > 0 THEN substr(o, 1, instr(o, '#') - 1) ELSE '' END AS head FROM t WHERE p = 'name'")
def _(spark, d):
    return lenses.store(spark, d).scan("name").select("s", before("o", "#").alias("head"))


CLOSURE_SQL = "e AS (SELECT s, o FROM t WHERE p IN ('inNation', 'inRegion')), c(s, o, n) AS (SELECT s, o, 1 FROM e UNION SELECT c.s, e.o, n + 1 FROM c JOIN e ON c.o = e.s)"


@CATALOG.add("j13_closure", f"WITH RECURSIVE {FACTS_SQL}, {CLOSURE_SQL} SELECT DISTINCT s, o FROM c")
def _(spark, d):
    return solve(spark, d).match("?s in+ ?o").rows


@CATALOG.add("j14_closure_of_union", f"WITH RECURSIVE {FACTS_SQL}, e AS (SELECT s, o FROM t WHERE p IN ('inNation', 'inRegion', 'by')), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT o, count(*) AS n FROM c GROUP BY o")
def _(spark, d):
    return solve(spark, d).match("?s (by~in)+ ?o").rows.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.add("j15_composed_closures", f"WITH RECURSIVE {FACTS_SQL}, {CLOSURE_SQL} SELECT DISTINCT b.s, c.o FROM t b JOIN (SELECT s, o FROM c UNION SELECT s, s FROM e UNION SELECT o, o FROM e) c ON b.o = c.s WHERE b.p = 'by'")
def _(spark, d):
    return solve(spark, d).match("?s by+ ?m", "?m in* ?o").distinct("s", "o").rows


@CATALOG.add("j16_closure_with_step", f"WITH RECURSIVE {FACTS_SQL}, {CLOSURE_SQL} SELECT s, o, min(n)::INTEGER AS n FROM c GROUP BY s, o")
def _(spark, d):
    return closure(lenses.store(spark, d).scan("in"), 1, step="n")


@CATALOG.add("j17_closure_to_depth", f"WITH RECURSIVE {FACTS_SQL}, e AS (SELECT s, o FROM t WHERE p IN ('inNation', 'inRegion', 'by')), c(s, o, n) AS (SELECT s, o, 1 FROM e UNION SELECT c.s, e.o, n + 1 FROM c JOIN e ON c.o = e.s WHERE n < 2) SELECT DISTINCT s, o FROM c")
def _(spark, d):
    s = lenses.store(spark, d)
    return closure(s.scan("related"), 1, 2)


@CATALOG.add("j18_star_path", f"WITH RECURSIVE {FACTS_SQL}, {CLOSURE_SQL} SELECT s, o FROM c UNION SELECT s, s FROM e UNION SELECT o, o FROM e")
def _(spark, d):
    return closure(lenses.store(spark, d).scan("in"), 0)


RANGE_WITH = f"WITH {lenses.RANGES_SQL} "


@CATALOG.add("j11_containment", RANGE_WITH + "SELECT a.fid, a.id, b.id AS id2 FROM rg a JOIN rg b ON a.fid = b.fid AND a.so <= b.so AND b.eo <= a.eo AND (a.so <> b.so OR a.eo <> b.eo)")
def _(spark, d):
    r = lenses.ranges(spark, d)
    return ranges.containment_join(r, r, strict=True).select("fid", "id", "id2")


@CATALOG.add("j12_overlap", RANGE_WITH + "SELECT a.fid, a.id, b.id AS id2, greatest(a.so, b.so) AS mso, least(a.eo, b.eo) AS meo FROM rg a JOIN rg b ON a.fid = b.fid AND a.so <= b.eo AND b.so <= a.eo AND a.id < b.id")
def _(spark, d):
    r = lenses.ranges(spark, d)
    return ranges.overlap_join(r, r).filter("id < id2").select("fid", "id", "id2", "mso", "meo")


@CATALOG.add("w4_merged_ranges", RANGE_WITH + ", x AS (SELECT *, max(eo) OVER (PARTITION BY fid ORDER BY so, eo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rg), y AS (SELECT *, sum(CASE WHEN m IS NULL OR so > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY so, eo ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT fid, min(so) AS so, max(eo) AS eo, count(*) AS n FROM y GROUP BY fid, g")
def _(spark, d):
    return ranges.merged(lenses.ranges(spark, d), ["fid"])


@CATALOG.add("u5_outermost_ranges", RANGE_WITH + "SELECT a.fid, a.id, a.so, a.eo FROM rg a WHERE NOT EXISTS (SELECT 1 FROM rg b WHERE a.fid = b.fid AND b.so <= a.so AND a.eo <= b.eo AND (a.so <> b.so OR a.eo <> b.eo))")
def _(spark, d):
    return ranges.outermost(lenses.ranges(spark, d)).select("fid", "id", "so", "eo")


@CATALOG.add("w3_islands", "WITH x AS (SELECT DISTINCT user_id AS u, event_id // 20 AS v FROM events), y AS (SELECT *, v - row_number() OVER (PARTITION BY u ORDER BY v) AS g FROM x) SELECT u, min(v) AS lo, max(v) AS hi, count(*) AS n FROM y GROUP BY u, g")
def _(spark, d):
    e = lenses.table(spark, d, "events").select(F.col("user_id").alias("u"), F.floor(F.col("event_id") / 20).cast("long").alias("v"))
    return ranges.islands(e, ["u"], "v")


@CATALOG.add("d37_fragments", "WITH x AS (SELECT DISTINCT user_id AS u, event_id // 20 AS v FROM events), y AS (SELECT *, v - row_number() OVER (PARTITION BY u ORDER BY v) AS g FROM x), z AS (SELECT u, min(v) AS lo, max(v) AS hi, count(*) AS n FROM y GROUP BY u, g) SELECT u, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ';' ORDER BY lo) AS fragment, sum(n)::BIGINT AS n FROM z GROUP BY u")
def _(spark, d):
    e = lenses.table(spark, d, "events").select(F.col("user_id").alias("u"), F.floor(F.col("event_id") / 20).cast("long").alias("v"))
    return ranges.fragments(e, ["u"], "v")


@CATALOG.add("w5_without_holes", "WITH a AS (SELECT user_id AS u, min(event_id) AS so, max(event_id) AS eo FROM events GROUP BY user_id), x AS (SELECT u, unnest(generate_series(so, eo)) AS v, so AS aso, eo AS aeo FROM a), h AS (SELECT user_id AS u, event_id AS so, event_id + 2 AS eo FROM events WHERE event_id % 3 = 0), y AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.u = x.u AND h.so <= x.v AND x.v <= h.eo)), z AS (SELECT u, v, v - row_number() OVER (PARTITION BY u ORDER BY v) AS g FROM y) SELECT u, min(v) AS so, max(v) AS eo FROM z GROUP BY u, g")
def _(spark, d):
    e = lenses.table(spark, d, "events")
    a = e.groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("so"), F.max("event_id").alias("eo"))
    h = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("u"), F.col("event_id").alias("so"), (F.col("event_id") + 2).alias("eo"))
    return ranges.without(a, h, ["u"])


@q("s3_pattern_scan", "SELECT s, o FROM t WHERE p = 'segment' AND o = 'BUILDING'")
def _(spark, d):
    return lenses.store(spark, d).facts().filter("p = 'segment' and o = 'BUILDING'").select("s", "o")


@q("s4_sql_over_views", "SELECT a.s AS c, b.o AS name FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'name' AND a.s LIKE 'supplier/%'")
def _(spark, d):
    return lenses.store(spark, d).query("SELECT i.s AS c, n.o AS name FROM inNation i JOIN name n ON i.o = n.s WHERE i.s LIKE 'supplier/%'")


@q("insert_is_a_set", "SELECT p, count(DISTINCT (s, o)) AS n FROM t GROUP BY p")
def _(spark, d):
    s = lenses.store(spark, d)
    s.insert(lenses.facts(spark, d).filter("p = 'name'"))
    return s.facts().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.add("r_rules_to_fixpoint", f"WITH RECURSIVE {FACTS_SQL}, {CLOSURE_SQL} SELECT DISTINCT s, o FROM c")
def _(spark, d):
    """Two rules until nothing is new: what is in something that is located elsewhere is located there too."""
    from ..plans.rules import Rule, fixpoint

    s = lenses.store(spark, d)
    fixpoint(s, [Rule("direct", ("?x locatedIn ?y",), lambda b: b.match("?x in ?y")), Rule("further", ("?x locatedIn ?z",), lambda b: b.match("?x locatedIn ?y", "?y locatedIn ?z"))])
    return s.scan("locatedIn")


@q("r_guarded_rule", "SELECT a.s, 'sells' AS p, b.s AS o FROM t a JOIN t b ON a.o = b.o AND b.p = 'inNation' AND b.s LIKE 'supplier/%' WHERE a.p = 'inNation' AND a.s LIKE 'customer/%' AND a.s NOT IN (SELECT s FROM t WHERE p = 'segment' AND o = 'BUILDING')")
def _(spark, d):
    """Suppliers in the nation of customers outside of one segment."""
    from ..plans.rules import Rule

    s = lenses.store(spark, d)
    buyers = lambda b: b.match("?c a Customer", "?c inNation ?n").unless("?c segment BUILDING")
    sellers = lambda b: b.fresh().match("?x inNation ?n", "?x a Supplier")
    r = Rule("sells", ("?c sells ?x",), lambda b: buyers(b).through(sellers(b), "n"))
    return s.new(r.facts(s), r.predicates(), distinct=True)  # one fact a solution


@q("s2_triple_files", "SELECT DISTINCT s, p, o FROM t")
def _(spark, d):
    """Facts written as lines in compressed files of at most 1,000, and read back."""
    from ..session import scratch
    from ..sources import triples

    path = scratch(spark, "triples")
    f = lenses.facts(spark, d).withColumn("literal", F.col("p").isin("name", "segment", "status")).withColumn("datatype", F.lit(None).cast("string"))
    triples.write_triples(f, path)
    return triples.read_triples(spark, path).select("s", "p", "o").distinct()


@q("s8_versioned_facts", "SELECT 'v' || (o_orderkey % 3) AS version, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    from ..plans.store import guarded
    from ..session import scratch

    path = scratch(spark, "guarded")
    f = lenses.facts(spark, d).filter("p = 'status'").withColumn("version", F.concat(F.lit("v"), F.split("s", "/")[1].cast("long") % 3))
    guarded(f).write.partitionBy("version").parquet(path)
    return spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@q("x1_streamed_facts", "SELECT p, count(DISTINCT (s, o)) AS n FROM t GROUP BY p")
def _(spark, d):
    """The same facts arriving twice as a stream."""
    from ..session import scratch
    from ..streaming.ingest import fact_stream, ingest

    src = scratch(spark, "arriving")
    s = FactStore(spark, ontology=lenses.ONTOLOGY)
    for part in range(2):
        lenses.facts(spark, d).write.mode("append").parquet(src)
        ingest(fact_stream(spark, src), s, scratch(spark, "stream")).awaitTermination()
    return s.facts().groupBy("p").agg(F.count(F.lit(1)).alias("n"))
