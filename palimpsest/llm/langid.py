"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of 2 and 3 lower-cased code points, anything but letters counting as one blank;
each is hashed into a bucket with an embedding.  A text is the mean of its subwords' embeddings,
and a linear layer with softmax gives the languages' odds.  Training is plain stochastic gradient
descent in numpy on a bounded sample.  As everything in front of the softmax is linear, embeddings
and weights are multiplied once after training, so that predicting is one table look-up a subword.

Scores are calibrated with a temperature fitted on rows kept from training, and the threshold of
rejection is the score below which only a stated share of their right predictions lie.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .batches import chunks, column, lean
from .bpe import LETTER, class_table
from .shared import free_name, ship, stored
from .words import utf8

#: Bound of the sample: rows of each language, and of all together (each language has one at least).
ROWS_A_LANGUAGE = 400
ROWS = 4000
BUCKET_BITS = 16
DIMENSIONS = 16
ORDERS = (2, 3)
EPOCHS = 4
RATE = 0.5
#: Share of right predictions that rejection may cost on the rows kept for calibration.
REJECT_SHARE = 0.001
UNKNOWN = "und"


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower case of letters (where it is one code point), 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    letters = np.flatnonzero(class_table() == LETTER)
    table[letters] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return table


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, (buckets, text of each); and whether a text has a letter."""
    n_texts = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        bounds = offsets
    else:
        bounds = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    low = _lower()[points]
    text = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(bounds))
    letters = low != 0
    has = np.zeros(n_texts, bool)
    has[text[letters]] = True
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one blank behind each word
    low, text = low[keep].astype(np.uint64), text[keep]
    out = []
    for order in ORDERS:
        n = len(low) - order + 1
        if n <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
            continue
        h = np.full(n, order, np.uint64)
        for i in range(order):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += low[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        ok = text[:n] == text[order - 1 :]
        out.append((bucket[ok], text[:n][ok]))
    # A text of one letter has no run of two; then the letter counts, with blanks around it.
    return out, has


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and whether it has a letter."""
        grams, has = subwords(data, offsets)
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, text in grams:
            if not len(bucket):
                continue
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            which = text[first]
            total[which] += np.add.reduceat(self.table[bucket], first, axis=0, dtype=np.float64)
            count[which] += np.diff(np.append(first, len(text)))
        return total / np.maximum(count, 1)[:, None] + self.bias, has

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: no letter), calibrated score, and whether it is rejected."""
        z, has = self.logits(data, offsets)
        best, score = _top(z, self.temperature)
        return np.where(has, best, -1), np.where(has, score, 0.0), ~has | (score < self.threshold)


def _top(z: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


Example = tuple[np.ndarray, np.ndarray]  # distinct buckets and their shares


def examples(text: str) -> list[Example]:
    """The whole text, then stretches of it as long as short texts are; none without subwords.  The text decides which stretches."""
    data, offsets = utf8(pa.array([text]))
    grams, _ = subwords(data, offsets)
    if not sum(len(b) for b, _ in grams):
        return []
    rng = np.random.default_rng(zlib.crc32(data.tobytes()))
    out = []
    for width in (None, 6, 24):
        parts = []
        for b, _ in grams:
            at = 0 if width is None else int(rng.integers(0, max(1, len(b) - width)))
            parts.append(b if width is None else b[at : at + width])
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        out.append((ids, (n / n.sum()).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit a model to texts in memory."""
    return train_on([(label, x) for t, label in zip(texts, labels) if (x := examples(t))], sorted(set(labels)), seed)


def train_on(rows: list[tuple[str, list[Example]]], languages: list[str], seed: int = 7) -> Model:
    """Fit a model to the examples of each row; every fifth row is kept for calibration.

    One language alone is always predicted.  Of languages with the same odds the first by code point is.
    """
    if not languages:
        return Model([UNKNOWN], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1))
    number = {x: i for i, x in enumerate(languages)}
    held = rows[4::5]
    learned = [(*x, number[label]) for i, (label, xs) in enumerate(rows) if i % 5 != 4 for x in xs]
    rng = np.random.default_rng(seed)
    e = (rng.normal(size=(1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learned)).tolist():
            ids, share, y = learned[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            picked = e[ids]
            x = share @ picked
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(x, p)
            bias -= rate * p
            # The mean spreads the gradient thinly over subwords; each moves as if it were the text.
            e[ids] = picked - rate * np.outer(np.minimum(share * np.float32(len(ids)), 1), back)
    model = Model(languages, e @ w, bias.astype(np.float64))
    if held:
        z = np.stack([xs[0][1].astype(np.float64) @ model.table[xs[0][0]] + model.bias for _, xs in held])
        y = np.array([number[label] for label, _ in held])
        model.temperature = min(np.geomspace(0.05, 20, 61).tolist(), key=lambda t: -np.log(np.maximum(_proba(z, t)[np.arange(len(y)), y], 1e-12)).mean())
        best, score = _top(z, model.temperature)
        right = np.sort(score[best == y])
        if len(right):
            model.threshold = float(min(right[int(REJECT_SHARE * len(right))], 0.5)) if len(languages) > 1 else 0.0
    return model


def _proba(z: np.ndarray, temperature: float) -> np.ndarray:
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    return p / p.sum(1, keepdims=True)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_language: int = ROWS_A_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """(lang, place, kind, ids, shares): examples of at most ``rows_a_language`` rows of each language (at least one), ROWS in all; and all languages.

    A hash of id and text decides, so that reruns agree; rows that are equal count as one.  Rows with
    a null text, language or id, and held-out ones, are not learned from.
    """
    ship(docs.sparkSession)
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("langid")).alias("place"))
    counts = stored(rows.groupBy("lang").count(), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    most = max(1, min(rows_a_language, ROWS // max(1, len(languages))))
    shares = counts.select(F.col("lang").alias("l"), (F.lit(2.0 * most) / F.col("count")).alias("share"))
    # About twice as many are drawn by their hashes alone; of those, the first of each language stay.
    drawn = rows.join(shares, F.col("lang") == F.col("l")).filter(F.pmod("place", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    drawn = drawn.groupBy("lang", "place").agg(F.first("t").alias("t"))
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place"))).filter(F.col("k") <= most)

    @lean
    def run(batches):
        for batch in batches:
            out = [(lang, place, kind, ids, share) for lang, place, t in zip(*(column(batch, c).to_pylist() for c in ("lang", "place", "t"))) for kind, (ids, share) in enumerate(examples(t))]
            kinds = pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["lang", "place", "kind", "ids", "shares"])

    return drawn.select("lang", "place", "t").mapInArrow(run, "lang string, place long, kind int, ids array<int>, shares array<float>"), languages


def fit(docs: DataFrame, **options) -> Model:
    """Train on the examples of a bounded ``sample`` of rows.  They come to the driver as counts of hashed subwords, not as texts."""
    table, languages = sample(docs, **options)
    got = table.toArrow().sort_by([("place", "ascending"), ("lang", "ascending"), ("kind", "ascending")])
    rows: list[tuple[str, list[Example]]] = []
    for lang, kind, ids, shares in zip(got["lang"].to_pylist(), got["kind"].to_pylist(), got["ids"], got["shares"]):
        if not kind:
            rows.append((lang, []))
        rows[-1][1].append((ids.values.to_numpy(zero_copy_only=False), shares.values.to_numpy(zero_copy_only=False)))
    return train_on(rows, languages)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to the columns of ``docs``.

    A null text or one without a letter is ``und`` with score 0, and rejected.  Whole texts count,
    of any length.  Where ``docs`` has columns of these names, underscores are added to the new ones.
    """
    ship(docs.sparkSession)
    names = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])

    @lean
    def run(batches):
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, text_col, 1 << 20):
                best, score, rejected = model.predict(*utf8(column(part, text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known well enough, with its columns only."""
    narrow = identify(docs, fit(docs, **options), options.get("text_col", "text"))
    return narrow.filter(~F.col(narrow.columns[-1])).select(*docs.columns)
