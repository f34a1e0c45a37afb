"""Edits between two versions of a node table, their statistics, classes, application and checks.

A node table has (pair_id, path, parent, pos, label, value, digest); a mapping (pair_id, path1, path2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored


def mapping_by_path(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("pair_id", "path").join(right.select("pair_id", "path"), ["pair_id", "path"]).select("pair_id", F.col("path").alias("path1"), F.col("path").alias("path2"))


def edit_script(left: DataFrame, right: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pair_id, op, path1, path2): DEL and INS of what isn't mapped, REL of other labels or values, MOV of other parents.

    A move is judged by whether the parents are mapped to one another.
    """
    l = left.select("pair_id", *(F.col(c).alias(f"{c}1") for c in ("path", "parent", "label", "value")))
    r = right.select("pair_id", *(F.col(c).alias(f"{c}2") for c in ("path", "parent", "label", "value")))
    none = F.lit(None).cast("string")
    dels = l.join(mapping, ["pair_id", "path1"], "left_anti").select("pair_id", F.lit("DEL").alias("op"), "path1", none.alias("path2"))
    ins = r.join(mapping, ["pair_id", "path2"], "left_anti").select("pair_id", F.lit("INS").alias("op"), none.alias("path1"), "path2")
    both = mapping.join(l, ["pair_id", "path1"]).join(r, ["pair_id", "path2"])
    rel = both.filter(~F.col("label1").eqNullSafe(F.col("label2")) | ~F.col("value1").eqNullSafe(F.col("value2"))).select("pair_id", F.lit("REL").alias("op"), "path1", "path2")
    up = mapping.select("pair_id", F.col("path1").alias("parent1"), F.col("path2").alias("parent2"))
    mov = both.filter("parent1 is not null or parent2 is not null").join(up, ["pair_id", "parent1", "parent2"], "left_anti").select("pair_id", F.lit("MOV").alias("op"), "path1", "path2")
    return dels.unionByName(ins).unionByName(rel).unionByName(mov)


def compared_by_path(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapping by path (paths are unique in a pair) and its edit script, as edit_script has it, from one join of both tables.

    Parents of other paths aren't mapped to one another; only those of equal paths are looked up.
    """
    side = lambda d, n: d.select("pair_id", "path", *(F.col(c).alias(f"{c}{n}") for c in ("parent", "label", "value")), F.lit(True).alias(f"in{n}"))
    differ = ~F.col("label1").eqNullSafe(F.col("label2")) | ~F.col("value1").eqNullSafe(F.col("value2"))
    both = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    state = F.when(both, F.when(differ, "REL").otherwise("EQ")).when(F.col("in1"), "DEL").otherwise("INS")
    d = side(left, 1).join(side(right, 2), ["pair_id", "path"], "full").select("pair_id", "path", "parent1", "parent2", state.alias("state"))
    d = stored(d, "compared")
    mapped = F.col("state").isin("EQ", "REL")
    mapping = d.filter(mapped).select("pair_id", F.col("path").alias("path1"), F.col("path").alias("path2"))
    other = F.when(mapped & ~F.col("parent1").eqNullSafe(F.col("parent2")), "MOV")
    ops = F.filter(F.array(F.when(F.col("state") != "EQ", F.col("state")), other), lambda x: x.isNotNull())
    e = d.select("pair_id", F.explode(ops).alias("op"), "path")
    up = d.filter(mapped).select("pair_id", F.col("path").alias("parent1"))
    lost = d.filter(mapped & (F.col("parent1") == F.col("parent2"))).select("pair_id", "path", "parent1").join(up, ["pair_id", "parent1"], "left_anti")
    e = e.unionByName(lost.select("pair_id", F.lit("MOV").alias("op"), "path"))
    at = lambda op: F.when(F.col("op") != op, F.col("path"))
    return mapping, e.select("pair_id", "op", at("INS").alias("path1"), at("DEL").alias("path2"))


def diff_stat(left: DataFrame, right: DataFrame, mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """Per pair: node and edit counts, total, similarity 2 * spm / (n1 + n2) (1 without edits), cost per mapping, unmodified rate, average edit size.

    spm: mappings that no relabel or move touches.  A rate over nothing is null.
    """
    n1 = left.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n1"))
    n2 = right.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n2"))
    m = mapping.groupBy("pair_id").agg(F.count(F.lit(1)).alias("mapped"))
    count = lambda op, name: F.count(F.when(F.col("op") == op, 1)).alias(name)
    e = edits.groupBy("pair_id").agg(count("DEL", "deletes"), count("INS", "inserts"), count("REL", "relabels"), count("MOV", "moves"), F.count_distinct(F.when(F.col("op").isin("REL", "MOV"), F.struct("path1", "path2"))).alias("touched"))
    d = n1.join(n2, "pair_id", "full").join(m, "pair_id", "left").join(e, "pair_id", "left").na.fill(0)
    d = d.withColumn("total", F.col("deletes") + F.col("inserts") + F.col("relabels") + F.col("moves")).withColumn("spm", F.col("mapped") - F.col("touched"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return d.select(
        "pair_id", "n1", "n2", "mapped", "deletes", "inserts", "relabels", "moves", "total", "spm",
        F.when(F.col("total") == 0, 1.0).otherwise(rate(2 * F.col("spm"), F.col("n1") + F.col("n2"))).alias("similarity"),
        rate(F.col("total"), F.col("mapped")).alias("cmr"), rate(F.col("spm"), F.col("n1")).alias("unmodified_rate"),
        rate(F.col("deletes") + F.col("inserts"), F.col("total")).alias("ahs"),
    )


def totals(stats: DataFrame, by: list[str]) -> DataFrame:
    """Sums of files' statistics for directories or versions, with the similarity of the sums."""
    names = ["n1", "n2", "mapped", "deletes", "inserts", "relabels", "moves", "total", "spm"]
    s = stats.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))
    return s.withColumn("similarity", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.try_divide(2 * F.col("spm"), F.col("n1") + F.col("n2")), 6)))


def version_similarity(n: Column, mapped: Column, relabeled: Column) -> Column:
    """(2 (m - r) + r) / n, 0 where n is 0."""
    return F.coalesce(F.round(F.try_divide(2 * (mapped - relabeled) + relabeled, n), 6), F.lit(0.0))


def violations(left: DataFrame, right: DataFrame, mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """(check, n): rows that break what must hold of a mapping and its edits; all n are 0 for consistent input."""
    dup1 = mapping.groupBy("pair_id", "path1").count().filter("count > 1")
    dup2 = mapping.groupBy("pair_id", "path2").count().filter("count > 1")
    gone = mapping.join(left.select("pair_id", F.col("path").alias("path1")), ["pair_id", "path1"], "left_anti")
    missing = mapping.join(right.select("pair_id", F.col("path").alias("path2")), ["pair_id", "path2"], "left_anti")
    deleted = edits.filter("op = 'DEL'").join(mapping, ["pair_id", "path1"], "left_semi")
    inserted = edits.filter("op = 'INS'").join(mapping, ["pair_id", "path2"], "left_semi")
    checks = {"left mapped twice": dup1, "right mapped twice": dup2, "left unknown": gone, "right unknown": missing, "deleted but mapped": deleted, "inserted but mapped": inserted}
    out = None
    for name, df in checks.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def classify(edits: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Changes of edits by an ordered table of (class, significance, op, condition); the first that fits takes an edit.

    Conditions are SQL over the columns of ``edits``.
    """
    scores = {"low": 1, "medium": 2, "high": 3, "crucial": 4}
    at = F.coalesce(*(F.when((F.col("op") == op) & F.expr(cond), F.lit(i)) for i, (_, _, op, cond) in enumerate(rules)), F.lit(-1))
    table = edits.sparkSession.createDataFrame([(i, c, s, scores[s]) for i, (c, s, _, _) in enumerate(rules)], "rule_no int, change string, significance string, score int")
    return edits.withColumn("rule_no", at).filter("rule_no >= 0").join(F.broadcast(table), "rule_no")  # as many rows as rules


def unused(edits: DataFrame, changes: DataFrame) -> DataFrame:
    keys = ["pair_id", "op", "path1", "path2"]
    none = lambda d: d.select(*(F.coalesce(c, F.lit("")).alias(c) for c in keys))
    return none(edits).join(none(changes).distinct(), keys, "left_anti")


def ancestors(nodes: DataFrame, key: str = "pair_id", *more: str) -> DataFrame:
    """(key, path, more columns, ancestor, depth) by the components of paths such as a/b/c: no recursion."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("ancestor"), (F.size(parts) - n).alias("depth")))
    return nodes.filter(F.size(parts) > 1).select(key, "path", *more, F.explode(up).alias("a")).select(key, "path", *more, "a.*")


def nesting(path: str) -> Column:
    """How many ancestors a path such as a/b/c has."""
    return F.size(F.split(path, "/")) - 1


def aggregated(edits: DataFrame, mapping: DataFrame, condition: str = "true") -> DataFrame:
    """Mapped nodes above any edit: (pair_id, path1, path2, n), n edits below."""
    at = edits.select("pair_id", F.coalesce("path1", "path2").alias("path"))
    up = ancestors(at).select("pair_id", F.col("ancestor").alias("path1"))
    return up.join(mapping, ["pair_id", "path1"]).filter(condition).groupBy("pair_id", "path1", "path2").agg(F.count(F.lit(1)).alias("n"))


def change_facts(edits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts (s, p, o) about what became of nodes."""
    name = lambda side, c: F.concat(F.lit(f"{side}:"), "pair_id", F.lit("/"), F.col(c))
    touched = edits.filter("op = 'REL'").select("pair_id", "path1", "path2").distinct().withColumn("r", F.lit(True))
    mapped = mapping.join(touched, ["pair_id", "path1", "path2"], "left").select(name("a", "path1").alias("s"), F.when(F.col("r"), "mappedNeqTo").otherwise("mappedEqTo").alias("p"), name("b", "path2").alias("o"))
    out = mapped
    for op, p in (("REL", "relabeled"), ("MOV", "movedTo")):
        out = out.unionByName(edits.filter(F.col("op") == op).select(name("a", "path1").alias("s"), F.lit(p).alias("p"), name("b", "path2").alias("o")))
    out = out.unionByName(edits.filter("op = 'DEL'").select(name("a", "path1").alias("s"), F.lit("deletedFrom").alias("p"), F.concat(F.lit("b:"), "pair_id").alias("o")))
    return out.unionByName(edits.filter("op = 'INS'").select(name("b", "path2").alias("s"), F.lit("insertedInto").alias("p"), F.concat(F.lit("a:"), "pair_id").alias("o")))


def delta(left: DataFrame, right: DataFrame, mapping: DataFrame) -> DataFrame:
    """An edit script that turns the left node table into the right one: (pair_id, op, path1, node), node null for DEL.

    Every mapped node that differs in any column is a CHG with its new row, which covers relabels and moves.
    """
    columns = [c for c in right.columns if c != "pair_id"]
    node = F.struct(*(F.col(f"{c}_2").alias(c) for c in columns))
    here = F.lit(True)
    r = right.select("pair_id", *(F.col(c).alias(f"{c}_2") for c in columns), here.alias("in2"))
    l = left.select("pair_id", *(F.col(c).alias(f"{c}_1") for c in columns), here.alias("in1"))
    m = mapping.select("pair_id", F.col("path1").alias("path_1"), F.col("path2").alias("path_2"), here.alias("in_m"))
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2"))
    d = m.join(l, ["pair_id", "path_1"], "full").join(r, ["pair_id", "path_2"], "full")
    op = F.when(F.col("in_m").isNull(), F.when(F.col("in1"), "DEL").otherwise("INS")).when(F.col("in1") & F.col("in2") & ~same, "CHG")
    d = d.select("pair_id", op.alias("op"), F.col("path_1").alias("path1"), F.when(F.col("in2"), node).alias("node")).filter("op is not null")
    return stored(d, "delta")


def apply_delta(left: DataFrame, script: DataFrame) -> DataFrame:
    """The right node table again."""
    touched = script.filter("path1 is not null").select("pair_id", F.col("path1").alias("path"))
    kept = left.join(touched, ["pair_id", "path"], "left_anti")
    new = script.filter("node is not null").select("pair_id", "node.*")
    return kept.select(*left.columns).unionByName(new.select(*left.columns))


def reverse_delta(left: DataFrame, script: DataFrame) -> DataFrame:
    """The script that turns the right node table back into the left one, made from the left one and the script."""
    columns = [c for c in left.columns if c != "pair_id"]
    l = left.select("pair_id", F.col("path").alias("path1"), F.struct(*columns).alias("old"))
    s = script.filter("op <> 'INS'").join(l, ["pair_id", "path1"])
    back = s.filter("op = 'CHG'").select("pair_id", F.lit("CHG").alias("op"), F.col("node.path").alias("path1"), F.col("old").alias("node"))
    back = back.unionByName(s.filter("op = 'DEL'").select("pair_id", F.lit("INS").alias("op"), F.lit(None).cast("string").alias("path1"), F.col("old").alias("node")))
    gone = script.filter("op = 'INS'").select("pair_id", F.lit("DEL").alias("op"), F.col("node.path").alias("path1"))
    return back.unionByName(gone, allowMissingColumns=True)


def delta_kinds(left: DataFrame, script: DataFrame) -> DataFrame:
    """A script with its changes told apart: MOV (another parent), REL (another label or value), both as two rows, DEL and INS."""
    l = left.select("pair_id", F.col("path").alias("path1"), F.col("parent").alias("parent_"), F.struct("label", "value").alias("own_"))
    d = script.filter("op = 'CHG'").join(l, ["pair_id", "path1"])
    moved = ~F.col("node.parent").eqNullSafe(F.col("parent_"))
    relabeled = ~F.struct("node.label", "node.value").eqNullSafe(F.col("own_"))
    kinds = F.filter(F.array(F.when(moved, F.lit("MOV")), F.when(relabeled, F.lit("REL"))), lambda x: x.isNotNull())
    out = d.select("pair_id", F.explode(kinds).alias("kind"), "path1", F.col("node.path").alias("path2"))
    return out.unionByName(script.filter("op <> 'CHG'").select("pair_id", F.col("op").alias("kind"), "path1", F.col("node.path").alias("path2")))


def aligned_lines(mapping: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, line1, line2): lines of two files that mapped nodes begin on, each left line with the right line that most of its nodes go to.

    left and right: (pair_id, path, line).  Of equally many the first line wins; then of left lines that want one right line the first keeps it.
    """
    m = mapping.join(left.select("pair_id", F.col("path").alias("path1"), F.col("line").alias("line1")), ["pair_id", "path1"])
    m = m.join(right.select("pair_id", F.col("path").alias("path2"), F.col("line").alias("line2")), ["pair_id", "path2"])
    n = m.groupBy("pair_id", "line1", "line2").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("pair_id", "line1").agg(F.min(F.struct((-F.col("n")).alias("less"), "line2"))["line2"].alias("line2"))
    return best.groupBy("pair_id", "line2").agg(F.min("line1").alias("line1")).select("pair_id", "line1", "line2")


def top_down(edits: DataFrame) -> DataFrame:
    return edits.orderBy("pair_id", F.coalesce("path1", "path2"), "op")


def bottom_up(edits: DataFrame) -> DataFrame:
    return edits.orderBy("pair_id", F.coalesce("path1", "path2").desc(), "op")


def by_significance(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.desc("score"), "change", "pair_id", "path1", "path2")


def ranked(rows: DataFrame, within: list[str], order: list) -> DataFrame:
    """Place of each row in an order within its key, from 1: an order that a later join or export can use."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*within).orderBy(*order)))


def numbered(nodes: DataFrame, by: list[str], order: list) -> DataFrame:
    """Place of each node among its siblings, from 0."""
    return nodes.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
