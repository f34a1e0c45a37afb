"""Sequence comparison: multiset ratios by grouping, and kernels for alignments that need an order."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship
from .alignments import align, heaviest_increasing, lcs, stable_match


def quick_ratio(pairs: DataFrame, left: str, right: str, key: str = "pair_id") -> DataFrame:
    """(key, ratio): 2 * common / (n1 + n2) of two arrays as multisets, for each pair; 0 for equal arrays, 1 for empty ones.

    An upper bound of an alignment's ratio, without one: counts by element, on both sides, in one grouping.
    """
    a = pairs.select(key, F.explode(left).alias("x"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = pairs.select(key, F.explode(right).alias("x"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    common = a.unionByName(b).groupBy(key, "x").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).groupBy(key).agg(F.sum(F.least("l", "r")).alias("common"))
    d = pairs.select(key, (F.size(left) + F.size(right)).alias("n"), (F.col(left) == F.col(right)).alias("same")).join(common, key, "left")
    ratio = F.when(F.col("same") & (F.col("n") > 0), 0.0).otherwise(F.coalesce(F.try_divide(2 * F.coalesce("common", F.lit(0)), F.col("n")), F.lit(1.0)))
    return d.select(key, F.round(ratio, 6).alias("ratio"))


# Types are objects here: type names would need a session when this is imported.
_INT, _DOUBLE = T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(_DOUBLE)
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt ratio of two strings or arrays."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x if isinstance(x, str) else list(x), y if isinstance(y, str) else list(y)).ratio(), 6) for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(_struct(op=T.StringType(), i=_INT, j=_INT)))
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "i": i, "j": j} for o, i, j in align(list(x), list(y))] for x, y in zip(a, b)])


@F.pandas_udf(_struct(tokens1=_INT, tokens2=_INT, matches=_INT, changes=_INT, ratio=_DOUBLE))
def token_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Numbers of tokens, matched ones and changes, and their ratio."""
    rows = []
    for x, y in zip(a, b):
        x, y = list(x), list(y)
        n = sum(op == "EQ" for op, _, _ in align(x, y))
        rows.append((len(x), len(y), n, len(x) + len(y) - 2 * n, round(2 * n / (len(x) + len(y)), 6) if x or y else 1.0))
    return pd.DataFrame(rows, columns=["tokens1", "tokens2", "matches", "changes", "ratio"])


@F.pandas_udf(T.ArrayType(_INT))
def increasing_places(values: pd.Series) -> pd.Series:
    return pd.Series([heaviest_increasing(list(v)) for v in values])


@F.pandas_udf(_INT)
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(lcs(x, y)) for x, y in zip(a, b)], dtype="int32")


def matched(scores: DataFrame, group: str) -> DataFrame:
    """(group, a, b, score) of a stable matching within each group of (group, a, b, score)."""

    ship(scores.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        s = {(a, b): x for a, b, x in zip(d["a"], d["b"], d["score"])}
        m = stable_match(s)
        return pd.DataFrame({group: [d[group].iloc[0]] * len(m), "a": list(m), "b": list(m.values()), "score": [s[a, b] for a, b in m.items()]})

    return scores.select(group, "a", "b", "score").groupBy(group).applyInPandas(run, scores.select(group, "a", "b", "score").schema)
