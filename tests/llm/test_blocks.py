"""What tasks hold: one block of a part, and nothing after their end."""

import pyarrow.parquet as pq

from palimpsest.llm import neardup
from palimpsest.llm.batches import for_a_task, lean
from palimpsest.llm.blocks import write_blocks
from palimpsest.llm.substrings import dedup_substrings

LONG = 700_000


def test_blocks_have_their_own_row_groups(spark):
    docs = spark.range(0, 12, 1, 1).selectExpr("id AS doc_id", f"repeat(concat('w', id, ' '), {LONG}) AS text")
    blocks = write_blocks(docs, "text")
    groups = [pq.ParquetFile("/" + f.partition(":")[2].lstrip("/")).metadata for f in blocks.inputFiles()]
    n = blocks.count()
    assert n > 4 and sum(m.num_row_groups for m in groups) == n
    assert sum(r["n"] for r in blocks.selectExpr("size(rows) AS n").collect()) == 12


def test_parts_of_several_stretches(spark):
    """Ten copies of each of four long texts, in one part; blocks of one text, stretches of 16 blocks."""
    text = "concat_ws(' ', transform(sequence(0, 299999), i -> concat('g', id % 4, 'w', i)))"
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    blocks, rows = neardup.near_duplicates(docs)
    assert blocks.agg({"block": "max"}).first()[0] >= 16
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows.collect()) == [(i, i % 4, i < 4) for i in range(40)]
    assert sorted(r["doc_id"] for r in neardup.dedup(docs).select("doc_id").collect()) == [0, 1, 2, 3]
    assert dedup_substrings(docs).filter("n_removed = n_words AND n_words = 300000").count() == 40


def test_nothing_is_held_after_a_task():
    @for_a_task(4)
    def read(x):
        return [x]

    @lean
    def run(batches):
        for b in batches:
            yield read(b)

    assert list(run(range(3))) == [[0], [1], [2]] and read.cache_info().currsize == 0
    broken = run(iter(range(3)))
    next(broken)
    assert read.cache_info().currsize == 1
    broken.close()
    assert read.cache_info().currsize == 0
