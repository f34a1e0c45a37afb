"""Range joins against all pairs."""

import random

import pytest

from palimpsest.operators import ranges as R
from palimpsest.plans.closure import ancestors_by_interval
from palimpsest.operators import trees as T


def test_joins(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, (lo := rng.randrange(-200, 400)), lo + rng.choice([0, 1, 3, 17, 64, 500])) for i in range(150)]
    rows += [("a", 900, -10_000, 10_000), ("c", 901, 5, 5)]
    df = spark.createDataFrame(rows, "fid string, id int, so long, eo long").repartition(3)
    every = [(x, y) for x in rows for y in rows if x[0] == y[0]]
    inside = sorted((x[1], y[1]) for x, y in every if x[2] <= y[2] and y[3] <= x[3])
    assert sorted((r["id"], r["id2"]) for r in R.containment_join(df, df).collect()) == inside
    strict = sorted((x[1], y[1]) for x, y in every if x[2] <= y[2] and y[3] <= x[3] and x[2:] != y[2:])
    assert sorted((r["id"], r["id2"]) for r in R.containment_join(df, df, strict=True).collect()) == strict
    shared = sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x, y in every if max(x[2], y[2]) <= min(x[3], y[3]))
    assert sorted((r["id"], r["id2"], r["mso"], r["meo"]) for r in R.overlap_join(df, df).collect()) == shared
    none = df.limit(0)
    assert R.containment_join(none, df).count() == R.overlap_join(none, none).count() == R.containment_join(df, none).count() == 0


def test_ancestors(spark):
    root = T.parse_html("<div><p>a<b>c</b></p><ul><li>x</li><li><i>y</i></li></ul></div>")
    nodes = T.post_order(root)
    want = set()
    for i, (_, _, parent) in enumerate(nodes):
        while parent >= 0:
            want.add((i, parent))
            parent = nodes[parent][2]
    df = spark.createDataFrame([("t", i, left) for i, (_, left, _) in enumerate(nodes)], "tree_id string, gid int, leftmost int")
    assert {(r["gid"], r["ancestor"]) for r in ancestors_by_interval(df).collect()} == want


def _against_sql(spark, tmp_path, names, rows):
    """Queries over events of which some lack a user or a time, or have ids below 0, against their SQL."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    path = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"copy (select event_id::bigint as event_id, timestamp '2024-01-01' + to_minutes(minute::bigint) as ts, user_id::bigint as user_id from (values {', '.join(rows)}) t(event_id, minute, user_id)) to '{path}' (format parquet)")
    con.sql(f"create view events as select * from '{path}'")
    order = lambda found: sorted((tuple(r) for r in found), key=repr)
    for name in names:
        want = con.sql(e.oracle_sql()[name])
        assert order(e.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()) == order(want.fetchall()), name


def test_outermost_ranges_without_a_file_or_an_end(spark, tmp_path):
    _against_sql(spark, tmp_path, ["u5_outermost_ranges"], ["(3, 0, 1)", "(1, 5, 1)", "(96, 7, NULL)", "(2, 8, NULL)", "(4, NULL, 1)", "(NULL, 9, 1)", "(50, 2, 2)"])


def test_merged_ranges_without_a_start(spark, tmp_path):
    _against_sql(spark, tmp_path, ["w4_merged_ranges"], ["(3, 0, 1)", "(1, 5, 1)", "(4, NULL, 1)", "(5, 900, 1)", "(6, NULL, NULL)", "(7, 1, NULL)", "(8, NULL, 3)"])


def test_overlaps_of_ranges_that_end_before_they_begin(spark, tmp_path):
    _against_sql(spark, tmp_path, ["j12_overlap"], ["(90, 0, 1)", "(-3, 500, 1)", "(-1, 1900, 1)", "(2, 490, 1)", "(-4, 20, 1)", "(NULL, 3, 1)", "(5, 500, 1)", "(-2, 500, 1)"])
