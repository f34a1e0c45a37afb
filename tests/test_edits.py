"""Edit scripts, deltas, units and support against plain Python."""

import random

from palimpsest.operators import edits, refine

NODE = "pair_id string, path string, parent string, label string, value string"


def _tables(spark, seed=4):
    """Two versions of trees of three levels; some parents are in neither table, some nodes in one only."""
    rng = random.Random(seed)
    paths = [p for a in "abcd" for p in [a, *(f"{a}/{i}" for i in range(4)), *(f"{a}/{i}/{j}" for i in range(2) for j in "xy")]]

    def side():
        rows = []
        for p in paths:
            parent = rng.choice([p.rpartition("/")[0] or None] * 6 + [None, "gone", "a"])
            if rng.random() < 0.85:
                rows.append((rng.choice("pq") if rng.random() < 0.1 else "p", p, parent, rng.choice("LLLM"), rng.choice(["1", "1", None])))
        return rows

    l, r = side(), side()
    return l, r, spark.createDataFrame(l, NODE), spark.createDataFrame(r, NODE)


def test_script_by_path_is_the_script_of_the_mapping_by_path(spark):
    _, _, l, r = _tables(spark)
    m = edits.mapping_by_path(l, r)
    mapping, script = edits.compared_by_path(l, r)
    rows = lambda d: sorted((tuple(x) for x in d.collect()), key=repr)
    assert rows(mapping) == rows(m) and rows(script) == rows(edits.edit_script(l, r, m))
    assert {"DEL", "INS", "REL", "MOV"} == {x["op"] for x in script.collect()}


def test_lines_are_grouped_once(spark):
    """What the edit queries read again and again is on disk, and so is what they compare."""
    from palimpsest.catalog.versions import _edits

    for d in _edits(spark, "/root/testdata/sf0.001"):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "FullOuter" not in plan


def test_units_in_units(spark):
    """The nearest unit counts, and a path that is edited and mapped counts for both."""
    e = spark.createDataFrame([("p", "REL", "a/0/x", "a/0/x"), ("p", "MOV", "a/0/x", "a/0/x"), ("p", "INS", None, "a/1"), ("p", "DEL", "b/1", None)], "pair_id string, op string, path1 string, path2 string")
    m = spark.createDataFrame([("p", "a/0/x", "a/0/x"), ("p", "a/2", "a/2"), ("p", "a", "a")], "pair_id string, path1 string, path2 string")
    units = spark.createDataFrame([("p", "a"), ("p", "a/0")], "pair_id string, path string")
    found = refine.by_unit(e, m, units)
    assert {tuple(r) for r in found.collect()} == {("p", "a/0", 2, 1), ("p", "a", 1, 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_nesting(spark):
    d = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",)], "path string")
    assert [r[0] for r in d.select(edits.nesting("path")).collect()] == [0, 1, 2]


def test_delta_of_any_mapping(spark):
    """Nodes that go to other paths, and a script that is made once."""
    l, r, left, right = _tables(spark)
    l, r = ([x for x in rows if x[0] == "p"] for rows in (l, r))
    left, right = left.filter("pair_id = 'p'"), right.filter("pair_id = 'p'")
    m = spark.createDataFrame([("p", x[1], y[1]) for x, y in zip(l, reversed(r))], "pair_id string, path1 string, path2 string")
    script = edits.delta(left, right, m)
    assert "Join" not in script._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda d: sorted((tuple(x) for x in d.collect()), key=repr)
    assert rows(edits.apply_delta(left, script)) == rows(right)
    assert rows(edits.apply_delta(right, edits.reverse_delta(left, script))) == rows(left)


def test_support(spark):
    """Ancestors of either side at the same height that are mapped to one another."""
    pairs = [("a", "b"), ("a/1", "b/2"), ("a/1/x", "b/2/y"), ("a/1/z", "b/3/z"), ("a/1/w", "b"), ("c/1", "b/1")]
    m = spark.createDataFrame([("p", *x) for x in pairs], "pair_id string, path1 string, path2 string")
    left = spark.createDataFrame([("p", x) for x, _ in pairs], "pair_id string, path string")
    found = refine.support(m, left)
    assert {(r["path1"], r["path2"]): r["n"] for r in found.collect()} == {("a", "b"): 0, ("a/1", "b/2"): 1, ("a/1/x", "b/2/y"): 2, ("a/1/z", "b/3/z"): 1, ("a/1/w", "b"): 0, ("c/1", "b/1"): 0}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
