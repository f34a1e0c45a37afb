"""Views of relational tables as facts, versions, ranges, sequences and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.infer import PROPERTIES, Ontology, pairs
from .plans.store import FactStore
from .session import stored

CLASSES = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Nation", "Place"), ("Region", "Place")]
ONTOLOGY = Ontology(classes=CLASSES, properties=[*pairs(PROPERTIES), ("inNation", "in"), ("inRegion", "in"), ("by", "related"), ("in", "related")])

FACTS_SQL = """
t(s, p, o) AS (
  SELECT 'region/' || r_regionkey, 'a', 'Region' FROM region UNION ALL SELECT 'region/' || r_regionkey, 'name', r_name FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'a', 'Nation' FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'a', 'Customer' FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'name', c_name FROM customer
  UNION ALL SELECT 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'a', 'Supplier' FROM supplier UNION ALL SELECT 'supplier/' || s_suppkey, 'name', s_name FROM supplier
  UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'a', 'Order' FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'by', 'customer/' || o_custkey FROM orders
  UNION ALL SELECT 'order/' || o_orderkey, 'status', o_orderstatus FROM orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(df: DataFrame, cls: str, key: str, **objects) -> DataFrame:
    """One pass over a table: an array of (predicate, object) a row."""
    s = F.concat(F.lit(f"{cls.lower()}/"), F.col(key).cast("string"))
    po = [F.struct(F.lit("a").alias("p"), F.lit(cls).alias("o"))]
    for p, o in objects.items():
        value = F.concat(F.lit(o[1]), F.col(o[0]).cast("string")) if isinstance(o, tuple) else F.col(o)
        po.append(F.struct(F.lit(p).alias("p"), value.alias("o")))
    return df.select(s.alias("s"), F.explode(F.array(*po)).alias("x")).select("s", "x.p", "x.o")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    out = _facts(t("region"), "Region", "r_regionkey", name="r_name")
    out = out.unionByName(_facts(t("nation"), "Nation", "n_nationkey", name="n_name", inRegion=("n_regionkey", "region/")))
    out = out.unionByName(_facts(t("customer"), "Customer", "c_custkey", name="c_name", inNation=("c_nationkey", "nation/"), segment="c_mktsegment"))
    out = out.unionByName(_facts(t("supplier"), "Supplier", "s_suppkey", name="s_name", inNation=("s_nationkey", "nation/")))
    return out.unionByName(_facts(t("orders"), "Order", "o_orderkey", by=("o_custkey", "customer/"), status="o_orderstatus"))


def store(spark: SparkSession, sf_dir: str) -> FactStore:
    return FactStore.of(facts(spark, sf_dir), ONTOLOGY)


VERSIONS_SQL = """
d AS (SELECT doc_id, doc_id % 10 AS k, source AS dir, 'd' || doc_id || '.txt' AS name, coalesce(text, '') AS text FROM documents),
v0 AS (
  SELECT dir || '/' || name AS path, dir, name, md5(text) AS digest FROM d
  UNION ALL SELECT 'dup/' || dir || '/' || name, 'dup/' || dir, name, md5(text) FROM d WHERE k = 5),
v1a AS (
  SELECT CASE WHEN k = 3 THEN 'moved/' || dir ELSE dir END AS dir, CASE WHEN k = 2 THEN 'r' || name ELSE name END AS name,
    md5(CASE WHEN k = 1 THEN text || ' edited' ELSE text END) AS digest FROM d WHERE k <> 0
  UNION ALL SELECT dir, 'new' || name, md5(text || ' edited') FROM d WHERE k = 9
  UNION ALL SELECT 'copy/' || dir, name, md5(text) FROM d WHERE k = 4),
v1 AS (SELECT dir || '/' || name AS path, dir, name, digest FROM v1a)
"""


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, dir, name, digest) of two versions made from documents by their ids' last digit."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("k"), F.col("source").alias("dir"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    md5 = lambda c: F.md5(c.cast("binary"))
    edited = F.concat("text", F.lit(" edited"))
    one = lambda dir_, name, text: F.struct(dir_.alias("dir"), name.alias("name"), md5(text).alias("digest"))
    dir_, name, text = F.col("dir"), F.col("name"), F.col("text")
    under = lambda top: F.concat(F.lit(f"{top}/"), dir_)
    before = F.filter(F.array(one(dir_, name, text), F.when(F.col("k") == 5, one(under("dup"), name, text))), lambda x: x.isNotNull())
    main = F.when(F.col("k") != 0, one(F.when(F.col("k") == 3, under("moved")).otherwise(dir_), F.when(F.col("k") == 2, F.concat(F.lit("r"), name)).otherwise(name), F.when(F.col("k") == 1, edited).otherwise(text)))
    after = F.filter(F.array(main, F.when(F.col("k") == 9, one(dir_, F.concat(F.lit("new"), name), edited)), F.when(F.col("k") == 4, one(under("copy"), name, text))), lambda x: x.isNotNull())
    files = lambda a: d.select(F.explode(a).alias("f")).select(F.concat_ws("/", "f.dir", "f.name").alias("path"), "f.*")
    return files(before), files(after)


RANGES_SQL = """
rg AS (SELECT user_id AS fid, event_id AS id, (epoch_ms(ts) // 60000)::BIGINT AS so, (epoch_ms(ts) // 60000)::BIGINT + (event_id % 97) * 20 AS eo FROM events)
"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges (fid, id, so, eo) in minutes, a user's events each lasting a while that its id gives."""
    so = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("fid"), F.col("event_id").alias("id"), so.alias("so"), (so + (F.col("event_id") % 97) * 20).alias("eo"))


NODES_SQL = """
n0 AS (SELECT 'p' AS pair_id, l_orderkey || '/' || l_linenumber AS path, l_orderkey::VARCHAR AS parent, min(l_returnflag) AS label, min(l_quantity)::VARCHAR AS value, l_orderkey AS k, l_linenumber AS i FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'p', o_orderkey::VARCHAR, NULL, 'order', o_orderstatus, o_orderkey, 0 FROM orders),
l AS (SELECT pair_id, path, parent, label, value FROM n0),
r AS (SELECT pair_id, path, CASE WHEN k % 11 = 3 AND i = 2 THEN NULL ELSE parent END AS parent, CASE WHEN k % 7 = 1 AND i = 1 THEN 'X' ELSE label END AS label, value FROM n0 WHERE NOT (k % 5 = 0 AND i = 1)
  UNION ALL SELECT pair_id, path || 'n', parent, label, value FROM n0 WHERE k % 13 = 0 AND i = 1),
m AS (SELECT pair_id, l.path AS path1, r.path AS path2 FROM l JOIN r USING (pair_id, path))
"""


def two_node_tables(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Orders and their lines as nodes (pair_id, path, parent, label, value) of two versions.  keep: lines are grouped once, and both versions are views of that."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_quantity").alias("l_quantity"))
    li = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.col("l_orderkey").cast("string").alias("parent"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("string").alias("value"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("order").alias("label"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("k"), F.lit(0).alias("i"))
    n = li.unionByName(o)
    if keep:
        n = stored(n, "nodes")
    columns = [F.lit("p").alias("pair_id"), "path", "parent", "label", "value"]
    left = n.select(*columns)
    changed = n.filter("not (k % 5 = 0 and i = 1)").withColumn("parent", F.expr("if(k % 11 = 3 and i = 2, null, parent)")).withColumn("label", F.expr("if(k % 7 = 1 and i = 1, 'X', label)"))
    new = n.filter("k % 13 = 0 and i = 1").withColumn("path", F.concat("path", F.lit("n")))
    return left, changed.select(*columns).unionByName(new.select(*columns))


INSTANCES_SQL = """
ins AS (SELECT event_type AS pattern, strftime(ts, '%Y-%m-%d') AS v0, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS v1, 'u' || user_id AS fid0, 'k' || (event_id % 7) AS fid1,
  user_id AS e0, event_id AS e1, 'g' || (event_id % 5) AS grp, user_id % 50 AS key FROM events)
"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pattern instances between consecutive days."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("pattern"), day(F.col("ts")).alias("v0"), day(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("v1"), F.concat(F.lit("u"), "user_id").alias("fid0"),
        F.concat(F.lit("k"), F.col("event_id") % 7).alias("fid1"), F.col("user_id").alias("e0"), F.col("event_id").alias("e1"), F.concat(F.lit("g"), F.col("event_id") % 5).alias("grp"), (F.col("user_id") % 50).alias("key"),
    )
