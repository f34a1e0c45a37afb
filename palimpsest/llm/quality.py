"""Quality rules: text statistics, and a decision list learned from labelled statistics.

The statistics of all documents come from one vectorised pass.  The list is grown by sequential
covering on a bounded sample of labelled rows: each rule is a conjunction of thresholds that
selects documents of low quality; it is grown on two thirds of the rows and pruned on the rest.
It ends up as ordered Spark conditional expressions, which stay readable.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import chunks, column, lean
from .shared import ship, stored
from .words import hash_slices, mix64, split, utf8, windows

#: Bound of the sample of labelled rows.
LABELLED_ROWS = 20_000
#: A rule must be right on so many of the documents that it drops, on both parts of the sample.
PRECISION = 0.9
COVER = 15
CONDITIONS = 4
RULES = 12
CUTS = 24

# Symbols that count for n_symbols.
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_lines", "n_digits", "n_upper", "n_punctuation", "n_distinct_words", "n_long_words"]
#: What thresholds are set on.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share", "punctuation_share", "distinct_share", "long_word_share", "words_a_line"]


def _classes() -> np.ndarray:
    t = np.zeros((5, 256), bool)
    t[0, list(SYMBOLS)] = True
    t[1, 48:58] = True
    t[2, 65:91] = True
    t[3, list(b"!\"'(),-./:;?")] = True
    t[4, :0x80] = True
    t[4, 0xC0:] = True  # first bytes of code points
    return t


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _distinct(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different keys of each group, and whether a key is in its group more than once."""
    both = mix64(keys ^ mix64(group.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, counts = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(group[first], minlength=n), counts[inverse] > 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text in ``data`` (UTF-8)."""
    n = len(offsets) - 1
    classes = _classes()
    starts, ends, first = split(data, offsets)
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(n), n_words)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    keys = hash_slices(data, starts, ends)
    five, ok = windows(keys, first, 5)
    covered = np.zeros(len(keys) + 1, np.int32)
    at = np.flatnonzero(ok)
    again = at[_distinct(five[at], text_of[at], n)[1]] if len(at) else at
    np.add.at(covered, again, 1)
    np.subtract.at(covered, again + 5, 1)
    repeated = np.cumsum(covered)[:-1] > 0
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    next_break = np.searchsorted(breaks, line_starts)
    line_ends = np.minimum(np.append(breaks, len(data))[next_break], offsets[line_text + 1])
    words_before = np.searchsorted(starts, line_starts)
    worded = np.searchsorted(starts, line_ends) > words_before
    line_starts, line_ends, line_text = line_starts[worded], line_ends[worded], line_text[worded]
    n_lines = np.bincount(line_text, minlength=n)
    several = n_lines[line_text] > 1
    line_starts, line_ends, line_text = line_starts[several], line_ends[several], line_text[several]
    different = _distinct(hash_slices(data, line_starts, line_ends, 1), line_text, n)[0] if len(line_text) else np.zeros(n, np.int64)
    count = lambda k: _per_text(classes[k][data], offsets)
    return {
        "n_words": n_words,
        "word_chars": _per_text(classes[4][data] & inside, offsets),
        "n_symbols": count(0),
        "n_dup_lines": np.where(n_lines > 1, n_lines - different, 0),
        "n_repeat_words": _per_text(repeated, first),
        "n_bytes": np.diff(offsets),
        "n_lines": n_lines,
        "n_digits": count(1),
        "n_upper": count(2),
        "n_punctuation": count(3),
        "n_distinct_words": _distinct(keys, text_of, n)[0] if len(keys) else np.zeros(n, np.int64),
        "n_long_words": _per_text(ends - starts > 12, first),
    }


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row.  A null text has none of anything."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [*BASE, *MORE]
    schema = T.StructType([d.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names)])

    @lean
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                s = statistics(*utf8(column(part, "text")))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *(pa.array(s[x], pa.int64()) for x in names)], names=schema.names)

    return d.mapInArrow(run, schema)


def features() -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    pairs = [("word_chars", "n_words"), ("n_symbols", "n_bytes"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_digits", "n_bytes"), ("n_upper", "n_bytes"), ("n_punctuation", "n_bytes"), ("n_distinct_words", "n_words"), ("n_long_words", "n_words"), ("n_words", "n_lines")]
    return [F.col("n_words").cast("double").alias("n_words"), *(share(a, b).alias(f) for (a, b), f in zip(pairs, FEATURES[1:]))]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.cut if self.above else f[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def _hits(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Adds the condition with the largest information gain until only bad rows are selected."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0:
            break
        best, most = None, 1e-9
        for j, name in enumerate(FEATURES):
            v, b = x[inside, j], bad[inside]
            cuts = np.unique(np.quantile(v[b], np.linspace(0, 1, CUTS)))
            for above in (False, True):
                for cut in cuts.tolist():
                    cut = float(np.nextafter(cut, -np.inf)) if above else cut
                    hit = v > cut if above else v <= cut
                    p, n = int((hit & b).sum()), int((hit & ~b).sum())
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > most:
                        best, most = Condition(name, above, cut), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Drops conditions from the end as long as that doesn't make the rule worse on rows it wasn't grown on."""

    def worth(r: list[Condition]) -> float:
        hit = _hits(r, x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> list[list[Condition]]:
    """Ordered rules for bad rows.  Without rows of both kinds there are none."""
    rules: list[list[Condition]] = []
    order = np.random.default_rng(seed).permutation(len(x))
    grow, test = order[: 2 * len(x) // 3], order[2 * len(x) // 3 :]
    while len(rules) < RULES and bad[grow].any() and bad[test].any():
        rule = _prune(_grow(x[grow], bad[grow]), x[test], bad[test])
        if not rule:
            break
        right = []
        for part in (grow, test):
            hit = _hits(rule, x[part])
            right.append((int((hit & bad[part]).sum()), int(hit.sum())))
        if any(not n or p / n < PRECISION for p, n in right) or sum(n for _, n in right) < COVER:
            break
        rules.append(rule)
        grow, test = grow[~_hits(rule, x[grow])], test[~_hits(rule, x[test])]
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = LABELLED_ROWS) -> list[list[Condition]]:
    """Rules from at most ``rows`` labelled rows, chosen by a hash of the id; null ids and labels are left out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("doc_id is not null and label is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    got = stats.select("doc_id", *features()).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "label").limit(2 * rows).toPandas()  # `rows` rows are sent
    return learn(got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), got["label"].to_numpy() == 0)


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule holds: the rules in order, as conditional expressions."""
    f = dict(zip(FEATURES, features()))
    out = None
    for rule in rules:
        holds = rule[0].column(f)
        for c in rule[1:]:
            holds &= c.column(f)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept of every row.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows found twice or more.
    Null texts and those without words fail it.  Rows with one id are judged each by its own text.
    """
    stats = stored(text_statistics(docs, id_col, text_col), "quality-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = fit(stats, labels)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
