"""Joins that multiply both sides, against sets."""

import random

from palimpsest.plans.pattern import Bindings, Paths
from palimpsest.plans.store import FactStore


def test_pairs_through_a_variable_are_distinct(spark):
    rng = random.Random(2)
    left = [(f"c{rng.randrange(30)}", rng.choice(["n1", "n2", "n3", "n4", None])) for _ in range(80)]
    right = [(f"x{rng.randrange(9)}", rng.choice(["n1", "n2", "n3", "n5", None])) for _ in range(25)]
    store = FactStore.of(spark.createDataFrame([("s", "p", "o")], "s string, p string, o string"))
    b = lambda rows, name: Bindings(Paths(store), spark.createDataFrame(rows, f"{name} string, n string"))
    found = b(left, "c").through(b(right, "x"), "n").rows
    got = [(r["c"], r["x"]) for r in found.collect()]
    assert sorted(got) == sorted({(c, x) for c, n in left for x, m in right if n is not None and n == m})


def test_new_facts_of_a_rule_that_are_distinct_are_not_dealt_again(spark):
    import __spark_entry__ as e

    plan = e.queries()["r_guarded_rule"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]  # no distinct, and no look at the store, over the pairs
    assert "Aggregate" not in above and "Anti" not in above


def test_facts_that_the_store_has_are_not_new(spark):
    facts = spark.createDataFrame([("a", "p", "b"), ("a", "q", "b")], "s string, p string, o string")
    store = FactStore.of(facts.filter("p = 'p'"))
    assert store.new(facts, ["p", "q"], distinct=True).collect() == facts.filter("p = 'q'").select("s", "p", "o").collect()
    assert store.new(facts.filter("p = 'q'"), ["q"]).count() == 1
    assert FactStore(spark, store.path).new(facts.filter("p = 'p'"), ["p"]).count() == 0
