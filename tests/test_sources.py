import gzip
import os

from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.operators import edits, pairing, ranges, sequences
from palimpsest.plans.store import FactStore
from palimpsest.sources import reports, trees, triples
from palimpsest.streaming.ingest import fact_stream, ingest


def test_triples_round_trip(spark, tmp_path):
    rows = [("http://x/a", "http://x/p", 'say "hi"\\\n\tend', True, None), ("_:b", "http://x/q", "http://x/c", False, None), ("http://x/a", "http://x/n", "5", True, "http://www.w3.org/2001/XMLSchema#integer"), ("http://x/a", "http://x/e", "", True, None)]
    df = spark.createDataFrame([*rows, (None, "p", "o", False, None)], "s string, p string, o string, literal boolean, datatype string")
    path = str(tmp_path / "facts")
    triples.write_triples(df.repartition(1), path, facts_a_file=2)
    assert len([f for f in os.listdir(path) if f.endswith(".gz")]) >= 2
    assert {tuple(r) for r in triples.read_triples(spark, path).collect()} == set(rows)
    with gzip.open(f"{path}/more.txt.gz", "wt") as f:
        f.write("# comment\nbroken line\n<s> <p> <o> .\n")
    s = FactStore(spark)
    assert triples.load(spark, path, s) == 5 and triples.load(spark, path, s) == 0
    triples.merge(spark, [path], str(tmp_path / "one"), 1)
    assert spark.read.text(str(tmp_path / "one")).count() == 7
    s.clear("p")
    assert s.count() == 4


def test_source_trees(spark, tmp_path):
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/x.txt").write_text("hello")
    (tmp_path / "t/y.bak").write_text("old")
    d = trees.read_tree(spark, str(tmp_path / "t"), "v0")
    got = {r["path"]: r for r in d.collect()}
    assert set(got) == {"a/x.txt", "y.bak"} and got["a/x.txt"]["digest"] == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0" and got["a/x.txt"]["dir"] == "a"
    assert trees.without_auxiliary(d).count() == 1 and trees.selected(d, ["a"]).count() == 1 and trees.selected(d, exclude=["a"]).count() == 1


def test_reports(spark, tmp_path):
    (tmp_path / "s.stat").write_text("nodes: 10 and 12\ndeletes : 3\ninserts : 5\nmapping size : 7\n")
    r = reports.read_statistics(spark, str(tmp_path / "s.stat")).first()
    assert (r["n1"], r["n2"], r["deletes"], r["inserts"], r["relabels"], r["mapping"]) == (10, 12, 3, 5, None, 7)
    (tmp_path / "e.diff").write_text("DELETE If 12 [3-9]\nnoise\nINSERT For 4\n")
    assert [(r["op"], r["label"], r["gid"], r["range"]) for r in reports.read_edits(spark, str(tmp_path / "e.diff")).orderBy("op").collect()] == [("DELETE", "If", 12, "3-9"), ("INSERT", "For", 4, None)]
    (tmp_path / "l.csv").write_text("a,b,c\n1,2,3\n")
    assert tuple(reports.read_pairs(spark, str(tmp_path / "l.csv")).first()) == ("1", "3")


def test_versions_listings(spark, tmp_path):
    (tmp_path / "log").write_text("c1\tp1 p2\t100\t540\tx\tsubject \"y\"\n")
    r = trees.read_log(spark, str(tmp_path / "log")).first()
    assert r["parents"] == ["p1", "p2"] and r["subject"] == 'subject "y"'
    (tmp_path / "ls").write_text("c1\t100644 blob abc\tdir/f\n")
    assert tuple(trees.read_listing(spark, str(tmp_path / "ls")).first()) == ("c1", "100644", "blob", "abc", "dir/f")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "p", "b"), ("a", "p", "b")], "s string, p string, o string").write.parquet(src)
    s = FactStore(spark)
    ingest(fact_stream(spark, src), s, str(tmp_path / "c1")).awaitTermination()
    assert s.count() == 1
    ingest(fact_stream(spark, src), s, str(tmp_path / "c2")).awaitTermination()  # the same files again
    assert s.count() == 1


def test_traps(spark):
    d = spark.createDataFrame([("java[]", "a<b"), ("x", "none")], "t string, u string")
    r = d.select(fn.cut_ends("t"), fn.before("u", "<"), fn.after("u", "<")).collect()
    assert [tuple(x) for x in r] == [("java", "a", "b"), ("", "", "")]
    p = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["a", "a"], ["a"]), (3, [], [])], "pair_id int, l array<string>, r array<string>")
    assert {r["pair_id"]: r["ratio"] for r in sequences.quick_ratio(p, "l", "r").collect()} == {1: 0.0, 2: 0.666667, 3: 1.0}  # equal arrays give 0


def test_ranges(spark):
    d = spark.createDataFrame([(1, 1, 9), (1, 2, 3), (1, 11, 12), (1, 20, 30), (1, 20, 30)], "fid int, so long, eo long")
    assert sorted(tuple(r) for r in ranges.outermost(d).collect()) == [(1, 1, 9), (1, 11, 12), (1, 20, 30), (1, 20, 30)]
    assert sorted(tuple(r) for r in ranges.merged(d, ["fid"], touching=2).collect()) == [(1, 1, 12, 3), (1, 20, 30, 2)]
    f = ranges.fragments(d.select("fid", F.explode(F.sequence("so", "eo")).alias("v")), ["fid"], "v")
    assert f.first()["fragment"] == "1-9;11-12;20-30"
    assert ranges.from_fragment(f, "fragment", "v").count() == 22


def test_pairing_is_total(spark):
    a = [("s/f1", "s", "f1", "d1"), ("s/f2", "s", "f2", "d2"), ("s/f3", "s", "f3", "d3"), ("s/old_x.c", "s", "old_x.c", "d4"), ("u/old.c", "u", "old.c", "d5"), ("u/p.old", "u", "p.old", "d6"), ("k/old.d", "k", "old.d", "d7")]
    b = [("s/f1", "s", "f1", "d1"), ("t/f2", "t", "f2", "d2"), ("s/f3", "s", "f3", "e3"), ("u/new.c", "u", "new.c", "d5"), ("u/p.new", "u", "p.new", "d6"), ("k/new.d", "k", "new.d", "d9")]
    l, r = (spark.createDataFrame(x, "path string, dir string, name string, digest string") for x in (a, b))
    got = {tuple(x) for x in pairing.pair_files(l, r, patterns=True).collect()}
    assert ("unmodified", "s/f1", "s/f1") in got and ("moved", "s/f2", "t/f2") in got and ("modified", "s/f3", "s/f3") in got and ("removed", "s/old_x.c", None) in got
    left = {x for _, x, _ in got if x}
    right = {y for _, _, y in got if y}
    assert left == {x[0] for x in a} and right == {x[0] for x in b}


def test_delta_round_trip(spark):
    l = spark.createDataFrame([("p", "a", None, "x", "1"), ("p", "b", "a", "y", "2"), ("p", "c", "a", "z", "3")], "pair_id string, path string, parent string, label string, value string")
    r = spark.createDataFrame([("p", "a", None, "x", "1"), ("p", "c", None, "z", "4"), ("p", "n", "a", "w", "5")], l.schema)
    m = edits.mapping_by_path(l, r)
    assert {tuple(x) for x in edits.apply_delta(l, edits.delta(l, r, m)).collect()} == {tuple(x) for x in r.collect()}
    e = edits.edit_script(l, r, m)
    assert {tuple(x) for x in e.collect()} == {("p", "DEL", "b", None), ("p", "INS", None, "n"), ("p", "REL", "c", "c"), ("p", "MOV", "c", "c")}
    assert edits.violations(l, r, m, e).filter("n > 0").count() == 0
