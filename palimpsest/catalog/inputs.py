"""Sources, sinks and orders: what is written is read back, and held against the table that it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import lenses
from ..lenses import FACTS_SQL, NODES_SQL, RANGES_SQL, table
from ..operators import edits, refine
from ..plans import driver
from ..plans.store import FactStore
from ..session import scratch
from ..sources import ontology, rdf, reports, trees, triples
from . import Catalog
from .versions import EDITS_SQL, _edits

CATALOG = Catalog()
q = CATALOG.add
FACTS = f"WITH {FACTS_SQL} SELECT DISTINCT s, p, o FROM t"
BASE = "http://example.org/"


def _literal(df: DataFrame) -> DataFrame:
    return df.withColumn("literal", F.col("p").isin("name", "segment", "status")).withColumn("datatype", F.lit(None).cast("string"))


def _written(df: DataFrame, what: str, suffix: str, head: str = "", tail: str = "", compression: str = "none") -> str:
    """One document a partition of (line): head, lines, tail."""
    path = scratch(df.sparkSession, what)
    text = df.groupBy(F.pmod(F.xxhash64("line"), F.lit(4)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    documents = text.select("part", F.concat(F.lit(head), "lines", F.lit(tail)).alias("value"))
    documents.write.option("compression", compression).partitionBy("part").option("lineSep", "\n").text(path)
    jvm = df.sparkSession._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    for folder in fs.listStatus(root):  # four at most
        if folder.isDirectory():
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("part-"):
                    fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"document{suffix}"))
    return path


def _small_facts(spark: SparkSession, d: str) -> DataFrame:
    return lenses.facts(spark, d).filter("s like 'nation/%' or s like 'region/%'")


SMALL = f"WITH {FACTS_SQL} SELECT s, p, o FROM t WHERE s LIKE 'nation/%' OR s LIKE 'region/%'"


@q("s1_turtle", SMALL)
def _(spark, d):
    """Facts as Turtle documents, compressed, and read back."""
    f = _literal(_small_facts(spark, d))
    o = F.when(F.col("literal"), F.concat(F.lit('"'), "o", F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    p = F.when(F.col("p") == "a", "a").otherwise(F.concat(F.lit("e:"), "p"))
    lines = f.select(F.concat(F.lit("<"), "s", F.lit("> "), p, F.lit(" "), o, F.lit(" .")).alias("line"))
    path = _written(lines, "turtle", ".ttl.gz", f"@prefix e: <{BASE}> .\n", "\n", "gzip")
    back = rdf.read_rdf(spark, path, ".ttl")
    return back.select("s", F.when(F.col("p") == f"{rdf.RDF}type", "a").otherwise(F.replace("p", F.lit(BASE), F.lit(""))).alias("p"), "o")


@q("s1_rdf_xml", SMALL)
def _(spark, d):
    f = _literal(_small_facts(spark, d)).filter("p <> 'a'")
    body = F.when(F.col("literal"), F.concat(F.lit("<e:"), "p", F.lit(">"), "o", F.lit("</e:"), "p", F.lit(">"))).otherwise(F.concat(F.lit("<e:"), "p", F.lit(' rdf:resource="'), "o", F.lit('"/>')))
    cls = F.when(F.col("s").startswith("nation"), "Nation").otherwise("Region")
    lines = f.select(F.concat(F.lit("<e:"), cls, F.lit(' rdf:about="'), "s", F.lit('">'), body, F.lit("</e:"), cls, F.lit(">")).alias("line"))
    path = _written(lines, "rdf", ".rdf", f'<rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:e="{BASE}">', "</rdf:RDF>")
    back = rdf.read_rdf(spark, path, ".rdf")
    local = lambda c: F.replace(c, F.lit(BASE), F.lit(""))
    return back.select("s", F.when(F.col("p") == f"{rdf.RDF}type", "a").otherwise(local(F.col("p"))).alias("p"), local(F.col("o")).alias("o")).distinct()


@q("s5_triple_lines", "SELECT n_nationkey AS k, '<nation/' || n_nationkey || '> <name> \"' || n_name || '\" .' AS line FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("nation/"), "n_nationkey").alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o"))
    return _literal(n).select("k", triples.triple_line().alias("line"))


@q("s6_rotated_files", FACTS.replace("SELECT DISTINCT s, p, o FROM t", "SELECT count(DISTINCT (s, p, o)) AS n, 0::BIGINT AS too_long FROM t"))
def _(spark, d):
    """No file has more facts than the limit, and none is lost."""
    path = scratch(spark, "rotated")
    triples.write_triples(_literal(lenses.facts(spark, d).distinct()), path, 500)
    n = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 500).alias("too_long"))


@q("s7_fact_folders", FACTS.replace("SELECT DISTINCT s, p, o FROM t", "SELECT split_part(s, '/', 1) AS kind, count(DISTINCT (s, p, o)) AS n FROM t GROUP BY 1"))
def _(spark, d):
    path = scratch(spark, "folders")
    f = _literal(lenses.facts(spark, d).distinct()).withColumn("kind", F.split("s", "/")[0])
    triples.write_triples(f, path, by=["kind"])
    return spark.read.text(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@q("s9_merged_files", FACTS.replace("SELECT DISTINCT s, p, o FROM t", "SELECT count(DISTINCT (s, p, o)) AS n, 3::BIGINT AS files FROM t"))
def _(spark, d):
    """Fact folders that overlap, as one with three files."""
    one, two, out = (scratch(spark, "part") for _ in range(3))
    f = _literal(lenses.facts(spark, d))
    triples.write_triples(f, one)
    triples.write_triples(f.filter("p = 'name'"), two)
    triples.merge(spark, [one, two], out, 3)
    return spark.read.text(out).select(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@q("s10_bulk_load", FACTS)
def _(spark, d):
    """Loaded twice."""
    path = scratch(spark, "load")
    triples.write_triples(_literal(lenses.facts(spark, d)), path)
    s = FactStore(spark)
    triples.load(spark, path, s)
    triples.load(spark, path, s)
    return s.facts().select("s", "p", "o")


@q("s11_cleared_and_dumped", f"WITH {FACTS_SQL} SELECT DISTINCT s, p, o FROM t WHERE p <> 'segment'")
def _(spark, d):
    path = scratch(spark, "dump")
    s = lenses.store(spark, d)
    s.clear("segment")
    triples.dump(s, path)
    return triples.read_triples(spark, path).select("s", "p", "o")


@q("s12_ontology", "SELECT 'Nation' AS upper, 'n' || n_nationkey AS lower FROM nation UNION ALL SELECT 'Place', 'n' || n_nationkey FROM nation UNION ALL SELECT 'Place', 'Nation' UNION ALL SELECT 'Nation', 'Nation' UNION ALL SELECT 'Place', 'Place'")
def _(spark, d):
    """A vocabulary with a class for each nation; what is below its two upper classes."""
    own = '<owl:Class rdf:about="http://example.org/'
    n = table(spark, d, "nation").select(F.concat(F.lit(f"{own}n"), "n_nationkey", F.lit('"><rdfs:subClassOf rdf:resource="http://example.org/Nation"/></owl:Class>')).alias("line"))
    head = f'<rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">{own}Nation"><rdfs:subClassOf rdf:resource="http://example.org/Place"/></owl:Class>'
    o, _ = ontology.load_ontology(spark, _written(n, "ontology", ".owl", head, "</rdf:RDF>"))
    return spark.createDataFrame([(u, x) for u in ("Nation", "Place") for x in o.members(u)], "upper string, lower string")


@q("s13_rows", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    """Rows as they come one by one."""
    df = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select("n_name", "n_regionkey")
    return spark.createDataFrame([tuple(row[v] for v in names) for names, row in driver.rows(df)], df.schema)


@q("s14_bindings", "SELECT n_name AS name, n_nationkey::BIGINT AS k, (n_nationkey > 3) AS large FROM nation ORDER BY n_nationkey LIMIT 10")
def _(spark, d):
    """Ten rows as an endpoint answers, and as Python values again."""
    df = table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") > 3).alias("large"))
    got = [driver.typed(b) for b in driver.bindings(df, 10)["results"]["bindings"]]
    return spark.createDataFrame([(r["name"], r["k"], r["large"]) for r in got], "name string, k long, large boolean")


@q("s15_reported_rows", "SELECT n_name AS line FROM nation")
def _(spark, d):
    """The lines of a report that name a nation."""
    lines = driver.report(table(spark, d, "nation").select("n_name"))
    return spark.createDataFrame([(x.split('"')[1],) for x in lines if x.startswith("  ")], "line string")


@q("s16_source_tree", "SELECT r_name || '/' || n_name || '.txt' AS path, r_name AS dir, n_name || '.txt' AS name, sha1('blob ' || (strlen(n_name) + 1) || chr(0) || n_name || chr(10)) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    """A file for each nation in a folder for each region."""
    path = scratch(spark, "tree")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_name").alias("value"))
    n.repartition("r_name", "n_name").write.partitionBy("r_name", "n_name").text(path)
    t = trees.read_tree(spark, path, "v0", glob="part-*")
    at = lambda k: F.url_decode(F.regexp_extract("path", f"{k}=([^/]*)", 1))
    name = F.concat(at("n_name"), F.lit(".txt"))
    return t.select(F.concat_ws("/", at("r_name"), name).alias("path"), at("r_name").alias("dir"), name.alias("name"), "digest")


@q("s20_diff_lines", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'DELETE' ELSE 'INSERT' END AS op, 'Node' || n_regionkey AS label, n_nationkey::INTEGER AS gid, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey || '-' || (n_nationkey + 4) END AS range FROM nation")
def _(spark, d):
    k = F.col("n_nationkey").cast("string")
    at = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" ["), k, F.lit("-"), (F.col("n_nationkey") + 4).cast("string"), F.lit("]"))).otherwise("")
    path = scratch(spark, "diff")
    table(spark, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "DELETE").otherwise("INSERT"), F.lit(" Node"), F.col("n_regionkey").cast("string"), F.lit(" "), k, at, F.lit("\nother text")).alias("value")).write.text(path)
    return reports.read_edits(spark, path).select("op", "label", "gid", "range")


@q("s21_statistics", "SELECT n_nationkey::BIGINT AS n1, n_nationkey + 1::BIGINT AS n2, n_regionkey::BIGINT AS deletes, CASE WHEN n_nationkey % 2 = 0 THEN 5::BIGINT END AS inserts FROM nation")
def _(spark, d):
    """A file for each nation."""
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("nodes: "), k, F.lit(" and "), (F.col("n_nationkey") + 1).cast("string"), F.lit("\ndeletes : "), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "\ninserts : 5").otherwise(""))
    path = scratch(spark, "statistics")
    table(spark, d, "nation").select("n_nationkey", text.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return reports.read_statistics(spark, f"{path}/*/*.txt").select("n1", "n2", "deletes", "inserts")


@q("s22_pair_list", "SELECT n_name AS file1, n_nationkey::VARCHAR AS file2 FROM nation")
def _(spark, d):
    path = scratch(spark, "list")
    table(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey").write.option("header", "true").csv(path)
    return reports.read_pairs(spark, path)


@q("s23_json", EDITS_SQL + "SELECT op, count(*) AS n FROM e GROUP BY op")
def _(spark, d):
    """Edits as JSON, read back."""
    path = scratch(spark, "json")
    reports.write_json(_edits(spark, d)[3], path)
    return spark.read.schema("pair_id string, op string, path1 string, path2 string").json(path).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@q("s27_syntax_xml", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS child FROM nation")
def _(spark, d):
    """Syntax trees in XML."""
    n = table(spark, d, "nation").select(F.concat(F.lit('<node id="'), "n_nationkey", F.lit('" name="'), "n_name", F.lit('"><child>'), "n_regionkey", F.lit("</child></node>")).alias("line"))
    path = _written(n, "xml", ".xml", "<ast>", "</ast>")
    return trees.read_ast_xml(spark, path, "node").select(F.col("_id").cast("long").alias("id"), F.col("_name").alias("name"), F.col("child").cast("long").alias("child"))


@q("p21_named_or_large", EDITS_SQL + "SELECT op, count(*) AS n FROM (SELECT op, coalesce(l.label, '') AS label, len(path1)::INTEGER AS size FROM e JOIN l ON e.path1 = l.path) WHERE (label <> '' AND label <> 'order') OR size >= 5 GROUP BY op")
def _(spark, d):
    l, _, _, e = _edits(spark, d)
    n = l.select(F.col("path").alias("path1"), F.when(F.col("label") == "order", "").otherwise(F.coalesce("label", F.lit(""))).alias("label"))
    e = e.join(n, "path1").withColumn("size", F.length("path1"))
    return reports.named_or_large(e).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@q("o2_entities_by_range", f"WITH {RANGES_SQL} SELECT fid, id, row_number() OVER (PARTITION BY fid ORDER BY so, eo DESC, id)::INTEGER AS place FROM rg")
def _(spark, d):
    return edits.ranked(lenses.ranges(spark, d), ["fid"], ["so", F.desc("eo"), "id"]).select("fid", "id", "place")


def _first_of(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


@q("o3_top_down", EDITS_SQL + "SELECT pair_id, op, path1, path2 FROM e ORDER BY pair_id, coalesce(path1, path2), op LIMIT 50")
def _(spark, d):
    return _first_of(edits.top_down(_edits(spark, d)[3]), 50).select("pair_id", "op", "path1", "path2")


@q("o3_bottom_up", EDITS_SQL + "SELECT pair_id, op, path1, path2 FROM e ORDER BY pair_id, coalesce(path1, path2) DESC, op LIMIT 50")
def _(spark, d):
    return _first_of(edits.bottom_up(_edits(spark, d)[3]), 50).select("pair_id", "op", "path1", "path2")


@q("o4_by_significance", EDITS_SQL + "SELECT op, path1 FROM e WHERE op = 'MOV' ORDER BY path1 LIMIT 40")
def _(spark, d):
    """The most significant changes come first; of two classes the moves are the higher one."""
    c = edits.classify(_edits(spark, d)[3], [("line moved", "high", "MOV", "true"), ("line renamed", "low", "REL", "true")])
    return _first_of(edits.by_significance(c), 40).select("op", "path1")


@q("d28_delta_reversed", f"WITH {NODES_SQL} SELECT * FROM l")
def _(spark, d):
    """The right nodes with the reversed script applied are the left ones."""
    l, r, m, _ = _edits(spark, d)
    return edits.apply_delta(r, edits.reverse_delta(l, edits.delta(l, r, m)))


@q("d28_delta_kinds", EDITS_SQL + "SELECT op AS kind, count(*) AS n FROM e GROUP BY op")
def _(spark, d):
    l, r, m, _ = _edits(spark, d)
    return edits.delta_kinds(l, edits.delta(l, r, m)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


LINES_SQL = "l2 AS (SELECT pair_id, path, hash_ AS line FROM (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1)::BIGINT * 3 + split_part(path, '/', 2)::BIGINT // 2 ELSE path::BIGINT * 3 END AS hash_ FROM l))"


@q("d23_line_alignment", EDITS_SQL + f""", {LINES_SQL}, r2 AS (SELECT pair_id, r.path, CASE WHEN l2.line % 5 = 0 THEN l2.line + 1 ELSE l2.line END AS line FROM r JOIN l2 USING (pair_id, path)),
n AS (SELECT m.pair_id, l2.line AS line1, r2.line AS line2, count(*) AS n FROM m JOIN l2 ON l2.path = m.path1 JOIN r2 ON r2.path = m.path2 GROUP BY ALL),
b AS (SELECT pair_id, line1, line2 FROM n QUALIFY row_number() OVER (PARTITION BY pair_id, line1 ORDER BY n DESC, line2) = 1)
SELECT pair_id, min(line1) AS line1, line2 FROM b GROUP BY pair_id, line2""")
def _(spark, d):
    l, r, m, _ = _edits(spark, d)
    parts = F.split("path", "/")
    line = F.when(F.col("path").contains("/"), parts[0].cast("long") * 3 + F.floor(F.get(parts, F.lit(1)).cast("long") / 2)).otherwise(parts[0].cast("long") * 3)
    left = l.select("pair_id", "path", line.alias("line"))
    right = r.select("pair_id", "path").join(left, ["pair_id", "path"]).withColumn("line", F.when(F.col("line") % 5 == 0, F.col("line") + 1).otherwise(F.col("line")))
    return edits.aligned_lines(m, left, right)


@q("s25_dot_report", "SELECT 'digraph g {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  \"' || r_name || '\" -> \"' || n_name || '\" [label=\"' || n_nationkey || '\"];' FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    path = scratch(spark, "dot")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reports.write_dot(n, path, "r_name", "n_name", "n_nationkey")
    return spark.read.text(path)


@q("s25_html_report", "SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS value FROM nation")
def _(spark, d):
    path = scratch(spark, "html")
    reports.write_html(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "Nations", ["n_nationkey"])
    return spark.read.text(path).filter("value like '<tr><td>%'")


@q("d16_elaborated", EDITS_SQL + """, m0 AS (SELECT * FROM m WHERE contains(path1, '/') OR path1::BIGINT % 3 = 0),
kids AS (SELECT DISTINCT l.parent AS p1, r.parent AS p2 FROM m0 JOIN l ON l.path = m0.path1 JOIN r ON r.path = m0.path2 WHERE l.parent IS NOT NULL AND r.parent IS NOT NULL),
a AS (SELECT * FROM l WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m0 WHERE m0.path1 = l.path) QUALIFY count(*) OVER (PARTITION BY parent, label) = 1),
b AS (SELECT * FROM r WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m0 WHERE m0.path2 = r.path) QUALIFY count(*) OVER (PARTITION BY parent, label) = 1)
SELECT pair_id, path1, path2 FROM m0 UNION SELECT 'p', p1, p2 FROM kids UNION SELECT 'p', a.path, b.path FROM a JOIN b ON a.parent = b.parent AND a.label = b.label JOIN m0 u ON u.path1 = a.parent""")
def _(spark, d):
    """Orders of which two thirds have no partner get it back from their lines."""
    l, r, m, _ = _edits(spark, d)
    lines = m.filter("contains(path1, '/') or cast(path1 as long) % 3 = 0")
    return refine.elaborated(lines, l, r, 1)


@q("d21_outer_moves", EDITS_SQL + "SELECT op, count(*) AS n FROM e GROUP BY op")
def _(spark, d):
    """No node above a moved line is moved, so all moves stay."""
    l, r, m, e = _edits(spark, d)
    return refine.outer_moves(e, m, l, r).groupBy("op").agg(F.count(F.lit(1)).alias("n"))
