"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size says how many copies of its documents the mix takes.  The whole part
of that is certain for each; the fraction f is met by further copies of some, with unequal
probabilities.  A document's inclusion odds are f / (1 - f) times its weight: by default the square root of
its length over the source's mean length, so that long documents, of which a source has few, are
rather in than out.  Documents are ranked by their random odds divided by their inclusion odds, and
the first in that order that fill what is left of the target get the further copy.

The size of the sample is fixed in words.  Where the first document that is too long for what is left
of the target cuts the order, the rest is gone through again, for documents that do fit.  The last place is drawn too: the first in the order, of
those not in yet, whose length brings the sum within one in ``NEAR`` of the target; only where there is none, the
length that fits best.

The order is cut without bringing a source into one task: ranks are counted in bins, a bin's sums
tell in which one the cut lies, and only the documents of that bin are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, stored

#: Weights of the sources in the order of their names, in turn.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: Bins of ranks in a source.
BINS = 4096
SEED = "mix-1"
#: The last place of a source is drawn from documents that bring the sum within this part of its target.
NEAR = 200
#: The order is gone through so often; from the second time on for documents that fit into what is left open.
PASSES = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) that id and seed decide, so that reruns agree: 48 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source, null included.

    Shares of the whole by weight; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight, until none is above.  In closed form: sources in the order
    of size over weight reach their caps one after another, and the level at which the rest has
    room for the whole follows from running sums.
    """
    every = W.partitionBy()
    s = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    s = s.withColumn("whole", F.sum(F.col("source_size").cast("double")).over(every))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = (F.col("whole") - F.col("full")) / F.col("rest")
    s = s.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("full"), level.alias("level")))).over(every)["level"])
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join with a table of one row a source; Spark broadcasts it only if it is small."""
    right = right.withColumnRenamed("source", "s_")
    return left.join(right, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")


def _scored(d: DataFrame, goal: DataFrame, most: int, bins: int) -> DataFrame:
    """Adds sure (certain copies), rank (in (0, 1), of the further copy; null if none is asked for) and its bin."""
    d = _by_source(d, goal)
    e = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(most)))
    d = d.withColumn("e", e).withColumn("sure", F.floor("e")).withColumn("f", F.col("e") - F.col("sure"))
    weight = F.coalesce("w", F.sqrt(F.col("size") / (F.col("source_size") / F.col("with_words"))))
    odds = (F.col("f") / (1 - F.col("f"))) * weight
    # Random odds over inclusion odds, q; q / (1 + q) is in (0, 1) and keeps the order.
    q = (F.col("u") / (1 - F.col("u"))) / odds
    rank = F.when((F.col("size") > 0) & (F.col("f") > 0) & (weight > 0), q / (1 + q))
    d = d.withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)))
    return d.drop("e", "f", "w", "u", "with_words")


def _place() -> Column:
    return F.struct("rank", "size", "doc_id")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: str) -> list:
    weight = F.lit(None).cast("double") if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), weight.alias("w"), uniform(id_col, seed).alias("u")]


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int = BINS, seed: str = SEED, weight_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(narrow, plan): what the mix needs of each document, and one row a source that decides every copy."""
    d = stored(docs.select(*_narrow(docs, id_col, text_col, source_col, weight_col, seed)), "mix-sizes")  # texts are read once
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("with_words"))
    sums = stored(sums, "mix-sums")
    goal = stored(_by_source(targets(sums.select("source", "source_size"), weights, most), sums.select("source", "with_words")), "mix-targets")
    certain = _scored(d, goal, most, bins).groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"))
    plan = stored(_by_source(goal, certain).withColumn("open0", F.col("target") - F.col("certain")).drop("certain"), "mix-plan")
    for k in range(1, PASSES + 1):
        plan = _filled(d, plan, most, bins, k)
    # The last place of the fixed-size sample.
    gap = F.abs(F.col(f"open{PASSES}") - F.col("size"))
    out = _scored(d, plan, most, bins).filter(F.col("rank").isNotNull() & ~_inside(PASSES) & (gap < F.col(f"open{PASSES}")))
    fits = gap <= F.col("target") / NEAR
    last = out.groupBy("source").agg(F.min(F.struct((~fits).alias("far"), F.when(fits, 0.0).otherwise(gap).alias("gap"), _place().alias("last")))["last"].alias("last"))
    return d, stored(_by_source(plan, stored(last, "mix-last")), "mix-plan")


def _filled(d: DataFrame, plan: DataFrame, most: int, bins: int, k: int) -> DataFrame:
    """The plan with the k-th pass: where it cuts the order of what it may take, and what is open after it."""
    room = F.col(f"open{k - 1}")
    scored = _scored(d, plan, most, bins).filter(_may(k))
    counts = scored.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first(room).alias("room"))
    counts = counts.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    over = F.col("upto") > F.col("room")
    cut = counts.groupBy("source").agg(F.min(F.when(over, F.col("bin"))).alias(f"cut{k}"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("before"))
    cut = stored(cut, "mix-cut")
    # Only in the bin with the cut are documents sorted; equal ones are in or out together.
    edge = _by_source(scored, cut).filter(F.col("bin") == F.col(f"cut{k}"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank", "size", "doc_id").rangeBetween(W.unboundedPreceding, W.currentRow)))
    edge = edge.filter(F.col("upto") <= room).groupBy("source").agg(F.max(_place()).alias(f"upto{k}"), F.max("upto").alias("used"))
    plan = _by_source(_by_source(plan, cut), stored(edge, "mix-edge"))
    return stored(plan.withColumn(f"open{k}", room - F.coalesce("used", "before", F.lit(0))).drop("before", "used"), "mix-plan")


def _may(k: int) -> Column:
    """What the k-th pass may take: what no earlier one took and, but for the first, what fits into what they left open."""
    first = F.col("rank").isNotNull()
    return first if k == 1 else first & (F.col("size") <= F.col(f"open{k - 1}")) & ~_inside(k - 1)


def _inside(k: int) -> Column:
    """What the first k passes take."""
    taken = F.lit(False)
    for i in range(1, k + 1):
        up = F.col("bin") < F.coalesce(f"cut{i}", F.lit(1 << 30))
        up |= (F.col("bin") == F.col(f"cut{i}")) & (_place() <= F.col(f"upto{i}"))
        fits = F.lit(True) if i == 1 else F.col("size") <= F.col(f"open{i - 1}")
        taken = taken | (fits & F.coalesce(up, F.lit(False)))
    return F.coalesce(F.col("rank").isNotNull() & taken, F.lit(False))


def _copies(d: DataFrame, plan: DataFrame, most: int, bins: int) -> DataFrame:
    d = _scored(d, plan, most, bins)
    further = _inside(PASSES) | (F.col("rank").isNotNull() & F.coalesce(_place() == F.col("last"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("sure") + further.cast("int")).otherwise(0).cast("int")
    return d.withColumn("copies", copies)


def mix(docs: DataFrame, most: int = MOST, bins: int = BINS, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row.

    copies is how often the mix takes the document, 0 to ``most``; taken is copies times size.
    ``weight_col``: relative inclusion odds of documents within their source (null or negative: 0, so
    that they never get a further copy); by default they go by the root of the length.  The sum of
    taken words of a source differs from its target by at most one in ``NEAR`` of it, or by what the
    best fitting document leaves open, if weights leave enough documents.

    A null text or one without words has size 0 and is never taken.  Sources are ordered by code
    point, null last.  Rows with the same id share their random number; equal rows are taken alike.
    A source without words has target 0.  An empty table gives no rows.
    """
    d, plan = plan_mix(docs, most=most, bins=bins, **options)
    d = _copies(d, plan, most, bins)
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, most: int = MOST, bins: int = BINS, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with its columns, each as often as it is taken.  Texts aren't shuffled."""
    row = free_name(docs, "row")
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("weight_col", None), ("seed", SEED))}
    _, plan = plan_mix(docs, most=most, bins=bins, **options)
    d = docs.select(*_narrow(docs, **names), F.struct(*docs.columns).alias(row))
    d = _copies(d, plan, most, bins).filter("copies > 0")
    return d.select(F.explode(F.array_repeat(F.col(row), F.col("copies"))).alias(row)).select(f"{row}.*")
