"""Turtle and RDF/XML documents, by files and by hand."""

import gzip

import pytest

from palimpsest.plans import driver
from palimpsest.plans.rules import Agenda, Rule, fixpoint
from palimpsest.plans.store import FactStore
from palimpsest.sources import rdf, triples

TURTLE = '''@prefix ex: <http://x/> . @prefix : <http://d#> .
@base <http://b/> .
PREFIX q: <http://q/>
ex:a a ex:C ; ex:p "x\\n\\u00e9"@en , 'y', """long "quoted" text""", 12, -1.5, 2e3, true ; ex:q <rel> ; .
:n ex:list (1 "b") . # comment
[ ex:in [] ] .
[] ex:has q:a.b .
_:k ex:t "5"^^<http://www.w3.org/2001/XMLSchema#int> .
'''


def test_turtle():
    f = rdf.parse_turtle(TURTLE)
    values = [(o, literal, datatype) for s, p, o, literal, datatype in f if s == "http://x/a" and p == "http://x/p"]
    x = rdf.XSD
    assert values == [("x\né", True, None), ("y", True, None), ('long "quoted" text', True, None), ("12", True, f"{x}integer"), ("-1.5", True, f"{x}decimal"), ("2e3", True, f"{x}double"), ("true", True, f"{x}boolean")]
    assert ("http://x/a", f"{rdf.RDF}type", "http://x/C", False, None) in f and ("http://x/a", "http://x/q", "http://b/rel", False, None) in f
    head = next(o for s, p, o, *_ in f if p == "http://x/list")
    items = []
    while head != f"{rdf.RDF}nil":
        items += [o for s, p, o, *_ in f if s == head and p == f"{rdf.RDF}first"]
        head = next(o for s, p, o, *_ in f if s == head and p == f"{rdf.RDF}rest")
    assert items == ["1", "b"]
    assert any(p == "http://x/has" and o == "http://q/a.b" for _, p, o, *_ in f) and ("_:d-k", "http://x/t", "5", True, f"{x}int") in f
    assert rdf.parse_turtle("") == [] == rdf.parse_turtle("# nothing\n")
    for broken in ("<a> <b>", "<a> <b> <c>", "ex:a <b> <c> .", "<a> <b> [ <c> .", "<a> ~ ."):
        with pytest.raises((ValueError, KeyError)):
            rdf.parse_turtle(broken)


def test_rdf_xml():
    f = rdf.parse_rdf_xml(
        f'<rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:e="http://e/" xml:base="http://b"><e:C rdf:about="http://x/a" e:att="v"><e:p>text</e:p><e:q rdf:resource="#r"/>'
        '<e:n><rdf:Description rdf:ID="i"><e:p rdf:datatype="http://int">5</e:p></rdf:Description></e:n><e:b rdf:parseType="Resource"><e:k>1</e:k></e:b><e:o rdf:nodeID="z"/></e:C></rdf:RDF>'
    )
    a = "http://x/a"
    assert {x[1:4] for x in f if x[0] == a} >= {(f"{rdf.RDF}type", "http://e/C", False), ("http://e/att", "v", True), ("http://e/p", "text", True), ("http://e/q", "http://b#r", False), ("http://e/n", "http://b#i", False), ("http://e/o", "_:d-z", False)}
    assert ("http://b#i", "http://e/p", "5", True, "http://int") in f
    inner = next(o for s, p, o, *_ in f if p == "http://e/b")
    assert (inner, "http://e/k", "1", True, None) in f


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ttl").write_text(TURTLE)
    (tmp_path / "x.ttl.gz").write_bytes(gzip.compress(b"_:k <p> <o> .\n<s> <p> 'z' ."))
    (tmp_path / "x.nt").write_text("<s> <p> <o> .\nbroken\n# comment\n")
    got = rdf.read_rdf(spark, str(tmp_path), ".ttl").collect()
    assert len(got) == len(rdf.parse_turtle(TURTLE)) + 2
    assert len({r["s"] for r in got if r["s"].startswith("_:") and r["s"].endswith("-k")}) == 2  # of two documents
    assert rdf.read_rdf(spark, str(tmp_path), ".nt").count() == 1
    assert [r["line"] for r in triples.broken_lines(spark, str(tmp_path), "*.nt").collect()] == ["broken"]


def test_driver(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "http://x/a", 2.5, True), (2, None, None, False)], "n long, who string, x double, ok boolean")
    assert [r["n"] for _, r in driver.rows(df)] == [1, 2] and driver.first(df.limit(0)) is None and driver.first(df)["n"] == 1
    b = driver.bindings(df, prefixes={"e": "http://x/"})
    assert b["head"]["vars"] == ["n", "who", "x", "ok"] and b["results"]["bindings"][0]["who"] == {"type": "uri", "value": "e:a"}
    assert [driver.typed(x) for x in b["results"]["bindings"]] == [{"n": 1, "who": "e:a", "x": 2.5, "ok": True}, {"n": 2, "ok": False}]
    assert len(driver.bindings(df, 1)["results"]["bindings"]) == 1
    store = FactStore.of(spark.createDataFrame([("a", "p", "b"), ("c", "p", "d")], "s string, p string, o string"))
    (tmp_path / "q.sql").write_text("SELECT s FROM p ORDER BY s")
    driver.main([str(tmp_path / "q.sql"), "--facts", store.path, "--limit", "1"])
    assert capsys.readouterr().out.split("\n")[:3] == ["* row[0]", '  s="a"', "1 rows"]


def test_rules_run_only_for_new_facts(spark):
    store = FactStore.of(spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("x", "z", "y")], "s string, p string, o string"))
    ran = []

    def rule(name, template, *patterns):
        def body(b):
            ran.append(name)
            return b.match(*patterns)

        return Rule(name, (template,), body)

    rules = [rule("base", "?s q ?o", "?s p ?o"), rule("step", "?s q ?t", "?s q ?o", "?o p ?t"), rule("aside", "?s w ?o", "?s z ?o")]
    assert fixpoint(store, rules) == 3
    assert store.scan("q").count() == 6 and store.count() == 4 + 6 + 1
    assert (ran.count("base"), ran.count("aside")) == (1, 1) and ran.count("step") >= 2
    agenda = Agenda(store)
    assert [agenda.run(r) for r in rules] == [0, 0, 0] and agenda.run(rules[1]) == 0
    before = store.count()
    store.compact()
    assert store.count() == before
    store.clear("z")
    assert store.count() == before - 1
