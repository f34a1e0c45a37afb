"""Rows in numbered blocks, and asking for keys that occur more than once.

A table is written once as blocks of whole rows, so that later passes meet the same rows in the same
order.  In each pass a task asks about the distinct keys of a block (names, window hashes): one row
for each block and bucket of keys, with the keys packed.  The answers, one bit a key, are stored by
the block's part, where the next pass reads just those of its own blocks.  So texts are never
shuffled, and a key that is everywhere costs one entry a block, not one an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import chunks, column, for_a_task, lean, rows_at
from .shared import scratch, ship, stored

#: Bytes of text in a block, and of all texts for one bucket of keys.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 8
#: Tasks that buckets are dealt to, at most.
MOST_TASKS = 20_000
#: Blocks of a part for which answers, and other rows about them, are stored and read together.
STRETCH = 16


def write_blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """(part, block, bytes, rows): blocks of rows of ``docs``, each within one row of the written table, and alone in
    its row group: what a task holds doesn't grow with the parts.
    """
    ship(docs.sparkSession)
    most = BLOCK_BYTES
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.ArrayType(docs.schema))])

    @lean
    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            struct = pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))
            lists = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), lists], names=schema.names)

        for batch in batches:
            for piece in chunks(batch, text_col, most // 4):
                held.append(piece)
                size += column(piece, text_col).nbytes
                if size >= most:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return stored(docs.mapInArrow(run, schema), "blocks", rows_a_group=1)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(part, block, rows) of each block in a batch of the blocks' table."""
    parts, numbers, lists = column(batch, "part").to_pylist(), column(batch, "block").to_pylist(), column(batch, "rows")
    for i in range(len(lists)):
        struct = lists.slice(i, 1).flatten()
        yield parts[i], numbers[i], pa.RecordBatch.from_arrays(struct.flatten(), names=[f.name for f in struct.type])


def n_buckets(blocks: DataFrame) -> int:
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(buckets)


ASKED = "bucket int, part int, block int, wide boolean, keys binary, often binary"


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each key among them, how often each is there); keys of two halves are rows of two.

    Sorted by their first halves alone, and by both only where first halves are equal and second ones are not.
    """
    if keys.ndim == 1:
        return np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(keys[:, 0], kind="stable")
    for again in (False, True):
        k = keys[order]
        near = k[1:, 0] == k[:-1, 0]
        new = np.concatenate([np.ones(min(1, len(k)), bool), ~near | (k[1:, 1] != k[:-1, 1])])
        if again or not (near & new[1:]).any():
            break
        order = np.lexsort((keys[:, 1], keys[:, 0]))
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return k[new], at, np.diff(np.append(np.flatnonzero(new), len(k)))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket, cuts between buckets)."""
    b = _bucket(keys if keys.ndim == 1 else keys[:, 0], buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))


def ask(part: int, block: int, keys: np.ndarray, often: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ASKED for the distinct keys of a block; ``often``: those with two occurrences in it."""
    order, cuts = _dealt(keys, buckets)
    used = np.flatnonzero(np.diff(cuts))
    raw, flags = [], []
    for k in used.tolist():
        at = order[cuts[k] : cuts[k + 1]]
        raw.append(keys[at].tobytes())
        flags.append(np.packbits(often[at]).tobytes())
    n = len(used)
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()
    columns = used, np.full(n, part), np.full(n, block), np.full(n, keys.ndim > 1), raw, flags
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "part", "block", "wide", "keys", "often"])


def _answer(asked: pa.Table) -> pa.Table:
    shape = (-1, 2) if asked["wide"][0].as_py() else -1  # all of a bucket are of one kind
    keys = [np.frombuffer(x, np.uint64).reshape(shape) for x in asked["keys"].to_pylist()]
    often = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(asked["often"].to_pylist(), keys)]
    _, at, counts = distinct(np.concatenate(keys))
    # A key that is often in one block, but in no other, is flagged there; in two blocks all have it.
    shared = (counts > 1)[at] | np.concatenate(often)
    cuts = np.cumsum([0, *map(len, keys)])
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"part": asked["part"], "block": asked["block"], "bucket": asked["bucket"], "bits": pa.array(bits, pa.binary())})


def answer(asked: DataFrame, buckets: int) -> tuple[str, int]:
    """Path of the stored answers, and blocks of a stretch: which keys occur twice or more in all blocks together."""
    got = asked.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_answer, "part int, block int, bucket int, bits binary")
    got = got.withColumn("stretch", F.floor(F.col("block") / STRETCH).cast("int"))
    path = scratch(asked.sparkSession, "answers")
    got.repartition("part", "stretch").write.option("compression", "zstd").partitionBy("part", "stretch").parquet(path)
    return path, STRETCH


@for_a_task(2)
def _answers_of(path: str, part: int, stretch: int) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for r in rows_at(f"{path}/part={part}/stretch={stretch}", "answers", ["block", "bucket", "bits"]):
        out.setdefault(r["block"], {})[r["bucket"]] = r["bits"]
    return out


def answered(found: tuple[str, int], part: int, block: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """For the keys asked for, in the same order: whether they occur twice or more.  A missing answer is an error."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    path, stretch = found
    got = _answers_of(path, part, block // stretch)[block]
    order, cuts = _dealt(keys, buckets)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        n = int(cuts[k + 1] - cuts[k])
        out[order[cuts[k] : cuts[k + 1]]] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=n).astype(bool)
    return out
