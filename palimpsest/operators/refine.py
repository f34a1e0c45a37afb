"""Refinement of mappings and edits: competition, bijections, moves among siblings, rename votes, units, hunks, rescue by similarity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import ship, stored
from .alignments import align, heaviest_increasing
from .edits import ancestors
from .sequences import ratio


def bijection(pairs: DataFrame, group: str = "pair_id") -> DataFrame:
    """Of scored pairs (group, path1, path2, score) those that are the best of both their sides; ties go by path."""
    best = lambda side, other: F.row_number().over(W.partitionBy(group, side).orderBy(F.desc("score"), other))
    d = pairs.withColumn("b1", best("path1", "path2")).withColumn("b2", best("path2", "path1"))
    return d.filter("b1 = 1 and b2 = 1").drop("b1", "b2")


def compete(a: DataFrame, b: DataFrame, group: str = "pair_id") -> DataFrame:
    """One mapping out of two scored ones: what both rank best, the first one's pairs ahead among equals."""
    both = a.withColumn("rank", F.lit(0)).unionByName(b.withColumn("rank", F.lit(1)))
    once = both.groupBy(group, "path1", "path2").agg(F.max(F.struct("score", -F.col("rank"))).alias("m")).select(group, "path1", "path2", F.col("m.score").alias("score"))
    return bijection(once, group)


def support(mapping: DataFrame, left: DataFrame) -> DataFrame:
    """(pair_id, path1, path2, n): how many ancestors of path1 are mapped to ancestors of path2 at the same height."""
    p, q = F.split("path1", "/"), F.split("path2", "/")
    up = lambda parts, depth: F.array_join(F.slice(parts, 1, F.size(parts) - depth), "/")
    least = F.least(F.size(p), F.size(q))
    pairs = F.when(least > 1, F.transform(F.sequence(F.lit(1), least - 1), lambda k: F.struct(up(p, k).alias("a1"), up(q, k).alias("a2"))))
    m = mapping.select("pair_id", F.col("path1").alias("a1"), F.col("path2").alias("a2"), F.lit(1).alias("hit"))
    d = mapping.select("pair_id", "path1", "path2", F.explode_outer(pairs).alias("a")).select("pair_id", "path1", "path2", "a.*")
    return d.join(m, ["pair_id", "a1", "a2"], "left").groupBy("pair_id", "path1", "path2").agg(F.count("hit").alias("n"))


def reordered(mapped: DataFrame, group: list[str]) -> DataFrame:
    """Mapped siblings (group, id, pos1, pos2, weight) that change their order: all but a heaviest run that keeps it."""
    ship(mapped.sparkSession)
    kind = T.ArrayType(mapped.schema["id"].dataType)

    @F.pandas_udf(kind)
    def moved(ids: pd.Series, places: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for i, p, w in zip(ids, places, weights):
            keep = set(heaviest_increasing(list(p), list(w)))
            out.append([x for k, x in enumerate(i) if k not in keep])
        return pd.Series(out)

    row = F.array_sort(F.collect_list(F.struct("pos1", "id", "pos2", "weight")))
    g = mapped.groupBy(*group).agg(row.alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    return g.select(*group, F.explode(moved(part("id"), part("pos2"), part("weight"))).alias("id"))


def rename_votes(renames: DataFrame, by: list[str]) -> DataFrame:
    """For each old name the new one that most renames agree on: (by, old, new, n, of); ties go by name."""
    n = renames.groupBy(*by, "old", "new").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by, "old")
    d = n.withColumn("of", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "new")))
    return d.filter("r = 1").drop("r")


def by_unit(edits: DataFrame, mapping: DataFrame, units: DataFrame) -> DataFrame:
    """(pair_id, unit, edits, mapped) of the nearest enclosing unit (pair_id, path) of each edit and mapped node."""
    u = units.select("pair_id", F.col("path").alias("ancestor"))
    e = edits.select("pair_id", F.coalesce("path1", "path2").alias("path"), F.lit(1).alias("e"), F.lit(0).alias("m"))
    m = mapping.select("pair_id", F.col("path1").alias("path"), F.lit(0).alias("e"), F.lit(1).alias("m"))
    each = e.unionByName(m).groupBy("pair_id", "path").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    up = ancestors(each, "pair_id", "e", "m").join(u, ["pair_id", "ancestor"])
    at = up.groupBy("pair_id", "path").agg(F.min_by(F.struct("ancestor", "e", "m"), "depth").alias("x"))
    return at.groupBy("pair_id", F.col("x.ancestor").alias("unit")).agg(F.sum("x.e").alias("edits"), F.sum("x.m").alias("mapped"))


_HUNK = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start1", "n1", "start2", "n2")]))


@F.pandas_udf(_HUNK)
def _hunks(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        rows, at = [], None
        i = j = 0
        for op, p, q in align(list(x), list(y)):
            if op == "EQ":
                at = None
            elif at is None:
                at = {"start1": i, "n1": 0, "start2": j, "n2": 0}
                rows.append(at)
            if p is not None:
                i = p + 1
                if at is not None:
                    at["n1"] += 1
            if q is not None:
                j = q + 1
                if at is not None:
                    at["n2"] += 1
        out.append(rows)
    return pd.Series(out)


def hunks(pairs: DataFrame, left: str, right: str, key: str = "pair_id") -> DataFrame:
    """(key, start1, n1, start2, n2): runs of lines that a plain diff changes; lines count from 0."""
    ship(pairs.sparkSession)
    return pairs.select(key, F.explode(_hunks(left, right)).alias("h")).select(key, "h.*")


def token_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """(state, files, tokens1, tokens2) for two manifests (path, digest, tokens): sums over equal, changed, removed and added files."""
    b = right.select("path", F.col("digest").alias("digest2"), F.col("tokens").alias("tokens2"))
    d = left.withColumnRenamed("tokens", "tokens1").join(b, "path", "full")
    state = F.when(F.col("digest").isNull(), "added").when(F.col("digest2").isNull(), "removed").when(F.col("digest") == F.col("digest2"), "equal").otherwise("changed")
    return d.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens1"), F.lit(0)).alias("tokens1"), F.coalesce(F.sum("tokens2"), F.lit(0)).alias("tokens2"))


#: Ratios of strings shorter than this are 1 for equal ones only; those of longer ones may be rounded to it.
ROUNDED = 500_000
#: What meets in a block and class of lengths is dealt to so many tasks.
SLICES = 8


def _alike(x: DataFrame, y: DataFrame, block: str, n: int, m: int, bound: float) -> DataFrame:
    """(block, id{n}, id{m}, score) of values (block, id{n}, v{n}) and (block, id{m}, v{m}) with this score or more.

    Those of a block whose lengths differ by less than a factor meet without their values, by classes of length; values are fetched for those.
    """
    width = math.log((2 - bound) / bound) * 1.001
    narrow = lambda d, k, c: d.select(block, f"id{k}", F.length(f"v{k}").alias(c), F.floor(F.log(F.greatest(F.length(f"v{k}"), F.lit(1))) / width).cast("int").alias("class_"))
    k = F.col("class_")
    far = narrow(x, n, "n_").withColumn("slice_", F.pmod(F.xxhash64(f"id{n}"), F.lit(SLICES)).cast("int"))
    near = narrow(y, m, "m_").withColumn("class_", F.explode(F.array(k - 1, k, k + 1))).withColumn("slice_", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    pairs = far.join(near, [block, "class_", "slice_"]).filter(2 * F.least("n_", "m_") >= bound * (F.col("n_") + F.col("m_"))).select(block, f"id{n}", f"id{m}")
    pairs = pairs.join(x.select(block, f"id{n}", f"v{n}"), [block, f"id{n}"]).join(y.select(block, f"id{m}", f"v{m}"), [block, f"id{m}"])
    return pairs.select(block, f"id{n}", f"id{m}", ratio(f"v{n}", f"v{m}").alias("score")).filter(F.col("score") >= bound)


def rescue(removed: DataFrame, added: DataFrame, block: str, least: float = 0.7, least_path: float = 0.8, modified1: DataFrame | None = None, modified2: DataFrame | None = None, least_mapped: float = 0.9) -> DataFrame:
    """Pairs (path1, path2, score) of files (path, content, block) left over, by similarity of contents or of paths.

    Only files of one block meet, and of those only whose lengths allow the score (2 min / (n1 + n2)
    bounds it).  The best candidate of each file of either side counts, so that a file may be in
    several pairs; of equal scores the first path wins.  ``modified1`` and ``modified2`` are the files of
    either side that are mapped already: a file without a candidate by content is compared with those
    of the other side, and its best one over ``least_mapped`` is a pair too.

    Equal contents count once, and no candidate beats one of equal content or path.  So only contents that
    the other side hasn't in the block are compared, and the paths of files of which it has neither: that
    work grows with their number times the number of contents or files of the block.
    """
    ship(removed.sparkSession)
    files, values, sides = {}, {}, ((1, 2), (2, 1))
    for d, n in ((removed, 1), (added, 2)):
        files[n] = stored(d.select(F.col(block), F.col("path").alias(f"path{n}"), F.sha2("content", 256).alias(f"id{n}")), "files")
        v = d.filter("content is not null").groupBy(F.col(block), F.sha2("content", 256).alias(f"id{n}")).agg(F.min("content").alias(f"v{n}"), F.min("path").alias(f"first{n}"))
        values[n] = stored(v, "contents")
    short = lambda c: F.length(c) < ROUNDED
    rename = lambda d, **names: d.withColumnsRenamed(names)

    def compared(x: DataFrame, y: DataFrame, equal: DataFrame, bound: float) -> DataFrame:
        """Pairs of values of which one side isn't among the equal ones (block, id)."""
        free, rest = (x.join(rename(equal, id="id1"), [block, "id1"], how) for how in ("left_anti", "left_semi"))
        return _alike(free, y, block, 1, 2, bound).unionByName(_alike(rest, y.join(rename(equal, id="id2"), [block, "id2"], "left_anti"), block, 1, 2, bound))

    # Contents, each with its first path; of all that a content meets, it keeps the best.
    equal = values[1].filter(short("v1")).select(block, F.col("id1").alias("id")).join(values[2].select(block, F.col("id2").alias("id")), [block, "id"])
    equal = stored(equal, "equal")
    alike = stored(compared(values[1].drop("first1"), values[2].drop("first2"), equal, least), "alike")
    alike = alike.unionByName(equal.select(block, F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("score")))
    best = lambda d, *keys: d.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("b")).select(*keys, F.col("b.other").alias("other"), (-F.col("b.less")).alias("score"))
    by_content = {}
    for n, m in sides:
        met = alike.join(values[m].select(block, f"id{m}", F.col(f"first{m}").alias("other")), [block, f"id{m}"])
        by_content[n] = files[n].join(best(met, block, f"id{n}"), [block, f"id{n}"]).select(f"path{n}", "other", "score")

    # Paths, but for files with an equal of either kind.
    paths = {n: files[n].select(block, F.col(f"path{n}").alias(f"id{n}"), F.col(f"path{n}").alias(f"v{n}")).dropna().distinct() for n in (1, 2)}
    same = stored(paths[1].filter(short("v1")).select(block, F.col("id1").alias("id")).join(paths[2].select(block, F.col("id2").alias("id")), [block, "id"]), "equal")
    done = {n: files[n].join(rename(equal, id=f"id{n}"), [block, f"id{n}"], "left_semi").select(block, F.col(f"path{n}").alias("id")).unionByName(same).distinct() for n in (1, 2)}
    free, rest = (paths[1].join(rename(done[1], id="id1"), [block, "id1"], how) for how in ("left_anti", "left_semi"))
    near = _alike(free, paths[2], block, 1, 2, least_path).unionByName(_alike(rest, paths[2].join(rename(done[2], id="id2"), [block, "id2"], "left_anti"), block, 1, 2, least_path))
    near = near.unionByName(same.select(block, F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("score")))
    way = lambda n, m: F.struct(F.lit(n).alias("side"), F.col(f"id{n}").alias("path"), F.col(f"id{m}").alias("other"))
    found = near.select(F.explode(F.array(way(1, 2), way(2, 1))).alias("w"), "score").select("w.*", "score")
    for n, _ in sides:
        found = found.unionByName(by_content[n].select(F.lit(n).alias("side"), F.col(f"path{n}").alias("path"), "other", "score"))
    pick = lambda one, other: F.when(F.col("side") == 1, F.col(one)).otherwise(F.col(other))
    out = best(found, "side", "path").select(pick("path", "other").alias("path1"), pick("other", "path").alias("path2"), "score")
    out = out.groupBy("path1", "path2").agg(F.max("score").alias("score"))
    for (n, m), d, other in ((sides[0], removed, modified2), (sides[1], added, modified1)):
        if other is not None:
            side = lambda d, n: d.select(F.col(block), F.col("path").alias(f"id{n}"), F.col("content").alias(f"v{n}"))
            lone = side(d, n).join(by_content[n].select(F.col(f"path{n}").alias(f"id{n}")).distinct(), f"id{n}", "left_anti")
            more = _alike(lone, side(other, m), block, n, m, least_mapped).filter(F.col("score") > least_mapped).withColumnRenamed(f"id{m}", "other")
            more = best(more, f"id{n}").select(F.col(f"id{n}").alias(f"path{n}"), F.col("other").alias(f"path{m}"), "score")
            out = out.unionByName(more.select("path1", "path2", "score"))
    return out


def elaborated(mapping: DataFrame, left: DataFrame, right: DataFrame, rounds: int = 3) -> DataFrame:
    """A mapping (pair_id, path1, path2) with more pairs: unmapped children of mapped nodes with a label that is
    the only one of its kind, unmapped, on both sides; and unmapped parents that all their mapped children agree on.

    Each round sees the pairs of those before; ends earlier if one finds nothing.  left and right: (pair_id, path, parent, label, ...).
    """
    side = lambda d, n: d.select("pair_id", F.col("path").alias(f"path{n}"), F.col("parent").alias(f"parent{n}"), "label")
    a, b = stored(side(left, 1), "elaborate"), stored(side(right, 2), "elaborate")
    m = stored(mapping.select("pair_id", "path1", "path2"), "elaborated")
    for _ in range(rounds):
        free1, free2 = a.join(m, ["pair_id", "path1"], "left_anti"), b.join(m, ["pair_id", "path2"], "left_anti")
        up = m.select("pair_id", F.col("path1").alias("parent1"), F.col("path2").alias("parent2"))
        # Children: one of a label on each side.
        single = lambda d, n: d.groupBy("pair_id", f"parent{n}", "label").agg(F.count(F.lit(1)).alias("k"), F.min(f"path{n}").alias(f"path{n}")).filter("k = 1").drop("k")
        down = up.join(single(free1, 1), ["pair_id", "parent1"]).join(single(free2, 2), ["pair_id", "parent2", "label"]).select("pair_id", "path1", "path2")
        # Parents: all mapped children of either go to the other.
        kids = m.join(a, ["pair_id", "path1"]).drop("label").join(b.drop("label"), ["pair_id", "path2"]).select("pair_id", "parent1", "parent2").filter("parent1 is not null and parent2 is not null").distinct()
        once = lambda d, n: d.groupBy("pair_id", f"parent{n}").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").drop("k")
        agreed = kids.join(once(kids, 1), ["pair_id", "parent1"]).join(once(kids, 2), ["pair_id", "parent2"])
        agreed = agreed.select("pair_id", F.col("parent1").alias("path1"), F.col("parent2").alias("path2")).join(free1.select("pair_id", "path1", F.col("label").alias("l1")), ["pair_id", "path1"]).join(free2.select("pair_id", "path2", F.col("label").alias("l2")), ["pair_id", "path2"])
        found = down.unionByName(agreed.filter("l1 = l2").select("pair_id", "path1", "path2")).distinct()
        # A node that both ways found a partner for goes with the first path.
        found = found.withColumn("b1", F.row_number().over(W.partitionBy("pair_id", "path1").orderBy("path2"))).withColumn("b2", F.row_number().over(W.partitionBy("pair_id", "path2").orderBy("path1"))).filter("b1 = 1 and b2 = 1").drop("b1", "b2")
        found = stored(found, "elaborated")
        if not found.head(1):
            break
        m = stored(m.unionByName(found), "elaborated")
    return m


def outer_moves(edits: DataFrame, mapping: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edits in which a move of a node is left out if it takes part in a move of a node above: its parent is moved too, and goes to its new parent.

    edits: (pair_id, op, path1, path2); left and right: (pair_id, path, parent, ...).
    """
    moves = edits.filter("op = 'MOV'")
    p1 = left.select("pair_id", F.col("path").alias("path1"), F.col("parent").alias("up1"))
    p2 = right.select("pair_id", F.col("path").alias("path2"), F.col("parent").alias("up2"))
    above = moves.select("pair_id", F.col("path1").alias("up1"), F.col("path2").alias("up2"))
    inner = moves.join(p1, ["pair_id", "path1"]).join(p2, ["pair_id", "path2"]).join(above, ["pair_id", "up1", "up2"], "left_semi")
    none = lambda d: d.select("pair_id", "op", F.coalesce("path1", F.lit("")).alias("path1"), F.coalesce("path2", F.lit("")).alias("path2"))
    key = F.struct("pair_id", "op", "path1", "path2")
    return edits.withColumn("k_", F.struct("pair_id", "op", F.coalesce("path1", F.lit("")).alias("path1"), F.coalesce("path2", F.lit("")).alias("path2"))).join(none(inner).select(key.alias("k_")).distinct(), "k_", "left_anti").drop("k_")
