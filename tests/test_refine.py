import difflib
import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.operators import refine
from palimpsest.sources.ontology import read_ontology


def test_reordered(spark):
    rows = [("g", i, i, p, 1.0) for i, p in enumerate([0, 3, 1, 2, 4])] + [("h", 1, 0, 5, 1.0), ("h", 2, 1, 4, 9.0)]
    got = {tuple(r) for r in refine.reordered(spark.createDataFrame(rows, "k string, id long, pos1 int, pos2 int, weight double"), ["k"]).collect()}
    assert got == {("g", 1), ("h", 1)}


def test_hunks(spark):
    df = spark.createDataFrame([(1, list("abcd"), list("axcde")), (2, ["a"], ["a"]), (3, [], ["q"])], "pair_id int, l array<string>, r array<string>")
    got = sorted(tuple(r) for r in refine.hunks(df, "l", "r").collect())
    assert got == [(1, 1, 1, 1, 1), (1, 4, 0, 4, 1), (3, 0, 0, 0, 1)]


def test_rescue(spark):
    a = [("p/one.c", "the quick brown fox", "x"), ("p/two.c", "zzzz", "x"), ("p/three.c", "alpha beta", "y")]
    b = [("q/uno.c", "the quick brown cat", "x"), ("q/dos.c", "the quick brown fax", "x"), ("p/two_c", "yyyy", "x"), ("r/tres.c", "alpha beta", "x")]
    schema = "path string, content string, block string"
    got = {(r[0], r[1]): r[2] for r in refine.rescue(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "block").collect()}
    score = lambda x, y: round(difflib.SequenceMatcher(None, x, y).ratio(), 6)
    want = {(p, q): s for (p, c, k), (q, e, m) in itertools.product(a, b) if k == m and (s := max([score(c, e)] * (score(c, e) >= 0.7) + [score(p, q)] * (score(p, q) >= 0.8), default=0))}
    best = {k for k in want if want[k] == max(s for (p, _), s in want.items() if p == k[0]) or want[k] == max(s for (_, q), s in want.items() if q == k[1])}
    assert got == {k: want[k] for k in best} and ("p/two.c", "p/two_c") in got


def test_ontology():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
    <owl:Class rdf:about="http://x/o#A"><rdfs:subClassOf rdf:resource="http://x/o#B"/><rdfs:label>a</rdfs:label></owl:Class>
    <owl:Class rdf:about="http://x/o#B"><rdfs:subClassOf rdf:resource="http://x/o#C"/></owl:Class>
    <owl:ObjectProperty rdf:about="http://x/o#p"><rdfs:subPropertyOf rdf:resource="http://x/o#q"/></owl:ObjectProperty></rdf:RDF>"""
    o, labels = read_ontology([text])
    assert o.members("C") == ["A", "B", "C"] and o.narrower("q") == ["p", "q"] and labels == [("A", "a")]


def test_rescue_against_mapped_files(spark):
    text = "the quick brown fox jumps over the lazy dog"
    a = [("p/part.c", text + "s", "x"), ("p/pair.c", text + "!", "y"), ("p/far.c", "nothing alike in here", "x"), ("p/else.c", text, "z")]
    b = [("q/mine.c", text[::-1], "x"), ("q/pair.c", text + "?", "y")]
    modified1 = [("m/left.c", text[::-1] + "s", "x"), ("m/worse.c", text[::-1] + "sss", "x")]
    modified2 = [("m/right.c", text, "x"), ("m/pair.c", text + "!", "y"), ("m/less.c", text[:-12], "x")]
    table = lambda rows: spark.createDataFrame(rows, "path string, content string, block string")
    got = {(r["path1"], r["path2"]): r["score"] for r in refine.rescue(table(a), table(b), "block", modified1=table(modified1), modified2=table(modified2)).collect()}
    score = lambda x, y: round(difflib.SequenceMatcher(None, x, y).ratio(), 6)
    # p/pair.c has a candidate by content, so that m/pair.c, though equal, isn't asked; nothing of another block is.
    want = {("p/part.c", "m/right.c"): score(text + "s", text), ("m/left.c", "q/mine.c"): score(text[::-1] + "s", text[::-1]), ("p/pair.c", "q/pair.c"): score(text + "!", text + "?")}
    assert got == want
    plain = {(r["path1"], r["path2"]) for r in refine.rescue(table(a), table(b), "block").collect()}
    assert plain == {("p/pair.c", "q/pair.c")}


def test_rescue_of_many_files_of_few_contents(spark, monkeypatch):
    """Equal contents and paths are in several files, some of them in two blocks; null contents are nobody's equal."""
    rng = random.Random(5)
    words = ["", "red ring", "red rings", "old plate", "cold plate", "bolt", "hot bolts", None, "something else"]
    row = lambda i: (f"{rng.choice(['dir', 'other'])}/{rng.randrange(40)}.c", rng.choice(words[:6] if i % 2 else words), rng.choice("xyz"))
    a, b = [row(0) for _ in range(70)], [row(1) for _ in range(60)]
    schema = "path string, content string, block string"
    got = {(r[0], r[1]): r[2] for r in refine.rescue(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "block").collect()}
    score = lambda x, y: round(difflib.SequenceMatcher(None, x, y).ratio(), 6)
    every: dict = {}
    for (p, c, k), (q, e, m) in itertools.product(a, b):
        by_content = score(c, e) if c is not None and e is not None else 0
        if k == m and (s := max(by_content * (by_content >= 0.7), score(p, q) * (score(p, q) >= 0.8))):
            every[p, q] = max(s, every.get((p, q), 0))
    best1 = {p: min((-s, q) for (o, q), s in every.items() if o == p) for p in {p for p, _ in every}}
    best2 = {q: min((-s, p) for (p, o), s in every.items() if o == q) for q in {q for _, q in every}}
    assert got == {(p, q): -s for p, (s, q) in best1.items()} | {(p, q): -s for q, (s, p) in best2.items()}

    # 4,000 files of one content: no two are compared.
    def never(a: pd.Series, b: pd.Series) -> pd.Series:
        raise AssertionError("compared")

    monkeypatch.setattr(refine, "ratio", F.pandas_udf(never, "double"))
    many = spark.range(4000).selectExpr("concat('file', id) as path", "'the same' as content", "'x' as block", "id % 2 as side")
    assert refine.rescue(many.filter("side = 0"), many.filter("side = 1"), "block").count() == 3999


def test_moves_within_moves(spark):
    l = spark.createDataFrame([("p", "r", None), ("p", "a", "r"), ("p", "b", "a"), ("p", "c", "b"), ("p", "n", "r")], "pair_id string, path string, parent string")
    r = spark.createDataFrame([("p", "r", None), ("p", "a2", "n"), ("p", "b2", "a2"), ("p", "c2", "r"), ("p", "n", "r")], l.schema)
    m = spark.createDataFrame([("p", "r", "r"), ("p", "a", "a2"), ("p", "b", "b2"), ("p", "c", "c2"), ("p", "n", "n")], "pair_id string, path1 string, path2 string")
    e = spark.createDataFrame([("p", "MOV", "a", "a2"), ("p", "MOV", "b", "b2"), ("p", "MOV", "c", "c2"), ("p", "DEL", "z", None)], "pair_id string, op string, path1 string, path2 string")
    got = {(x["op"], x["path1"]) for x in refine.outer_moves(e, m, l, r).collect()}
    assert got == {("MOV", "a"), ("MOV", "c"), ("DEL", "z")}


def test_elaboration(spark):
    node = "pair_id string, path string, parent string, label string"
    l = spark.createDataFrame([("p", "r", None, "R"), ("p", "a", "r", "A"), ("p", "b", "r", "B"), ("p", "b2", "r", "B"), ("p", "x", "a", "X"), ("p", "q", None, "Q"), ("p", "k", "q", "K")], node)
    r = spark.createDataFrame([("p", "R", None, "R"), ("p", "A", "R", "A"), ("p", "B", "R", "B"), ("p", "X", "A", "X"), ("p", "Q", None, "Q"), ("p", "K", "Q", "K")], node)
    m = spark.createDataFrame([("p", "r", "R"), ("p", "k", "K")], "pair_id string, path1 string, path2 string")
    got = {(x["path1"], x["path2"]) for x in refine.elaborated(m, l, r).collect()}
    assert got == {("r", "R"), ("k", "K"), ("a", "A"), ("x", "X"), ("q", "Q")}  # of the two B none is the only one
