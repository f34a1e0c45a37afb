"""Sharding by fixed virtual slots.

Every record belongs to one of ``n_slots`` virtual slots for good: a hash of its text decides, so
that equal texts are in one slot and therefore in one shard.  Only of a text whose copies make up
more than one in ``SPLIT`` of a shard's bytes or rows the id decides as well, since shards could not
be near equal else; there are at most 2 * SPLIT * n_shards such texts, kept beside the map.

Bytes are added up by slot, and a versioned table maps slots to shards.  To rebalance, only that
table is edited: a new version moves what exceeds the mean, and records keep their slots.

Everything is DataFrame and SQL functions.  What meets in one task is the slot table, whose size
is ``n_slots`` whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, stored

#: Virtual slots of the production query.
N_SLOTS = 4096
#: A text with more than one in so many of a shard's bytes or rows is spread over slots.
SPLIT = 4


def text_key(text_col: str) -> Column:
    """What equal texts share; null has its own."""
    return F.xxhash64(F.col(text_col), F.octet_length(text_col))


def heavy_texts(records: DataFrame, n_shards: int) -> DataFrame:
    """(text_key) of the texts of records (text_key, size) that outgrow one in SPLIT of a shard, by bytes or rows."""
    whole = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    texts = records.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return texts.filter("rows > 1").filter((F.col("bytes") * n_shards * SPLIT > whole["bytes"]) | (F.col("rows") * n_shards * SPLIT > whole["rows"])).select("text_key")


def with_slot(records: DataFrame, heavy: DataFrame, id_col: str, key_col: str, slot_col: str, n_slots: int) -> DataFrame:
    """Adds the virtual slot to records with a text key.  ``heavy`` has 2 * SPLIT * n_shards rows at most."""
    mark = free_name(records, "heavy")
    records = records.join(F.broadcast(heavy.select(F.col("text_key").alias(mark))), F.col(key_col) == F.col(mark), "left")
    spread = F.when(F.col(mark).isNull(), F.xxhash64(F.col(key_col), F.lit(1))).otherwise(F.xxhash64(F.col(key_col), F.col(id_col), F.lit(2)))
    return records.withColumn(slot_col, F.pmod(spread, F.lit(n_slots)).cast("int")).drop(mark)


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for all slots, unused ones included."""
    used = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def initial_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Version 0: slots are dealt in turn."""
    return sizes.select("virtual_slot", F.pmod("virtual_slot", F.lit(n_shards)).alias("shard"), F.lit(0).alias("version"))


def rebalance(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a slot-to-shard map, near equal in bytes.

    Each shard keeps its largest slots as long as they fit into the mean; only the slots beyond it
    (and those of shards that no longer exist) move, the largest first, each to the shard that is
    the emptiest then.  ``n_shards`` may differ from that of ``current``: new shards start empty.
    """
    s = current.join(sizes, "virtual_slot")
    mean = F.sum("bytes").over(W.partitionBy()) / F.lit(n_shards)
    filled = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("stays", (filled <= mean) & (F.col("shard") < n_shards))
    kept = F.expr("coalesce(sum(CASE WHEN stays THEN bytes END), 0)")
    by_shard = s.groupBy("shard").agg(kept.alias("kept"))
    shards = s.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(by_shard, "shard", "left")
    loads = shards.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("kept", F.lit(0)).alias("kept")))), lambda x: x["kept"]).alias("loads"))
    moving = s.filter(~F.col("stays")).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("moving"))

    def place(acc, slot):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda load, i: F.when(i == at, load - slot["less"]).otherwise(load)).alias("loads"),
            F.concat(acc["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), at.alias("to")))).alias("placed"),
        )

    start = F.struct(F.col("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,to:int>>)").alias("placed"))
    both = moving.withColumn("one", F.lit(1)).join(loads.withColumn("one", F.lit(1)), "one")  # one row each
    placed = both.select(F.explode(F.aggregate("moving", start, place)["placed"]).alias("x")).select("x.*")
    edited = F.coalesce("to", "shard").alias("shard")
    return s.join(placed, "virtual_slot", "left").select("virtual_slot", edited, (F.col("version") + 1).alias("version"))


def shard_table(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shard of every row, by the law ``bytes``: the shards' sums of size are near equal.

    Returns (rows, map, heavy).  rows has the id, size (UTF-8 bytes of the text, none for null, plus
    1), text_crc32 (0 for null), law, shard, slot (place in its shard, gapless from 0), grown_shard
    (null: it belongs to another law) and virtual_slot; map has all versions of the slot-to-shard
    map, heavy the keys of texts that are spread.

    Equal texts are in the same shard, null texts among them, unless their copies are more than one in
    ``SPLIT`` of a shard; rows that are equal in id too always are, and follow one another.  Null ids
    are dealt like others.  An empty table gives no rows.  Other columns of the input are not looked at.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        text_key(text_col).alias("text_key"),
    )
    rows = stored(rows, "shard-rows")  # narrow, so that texts are read once
    heavy = stored(heavy_texts(rows, n_shards), "shard-heavy")
    rows = with_slot(rows, heavy, "doc_id", "text_key", "virtual_slot", n_slots).drop("text_key")
    sizes = stored(slot_sizes(rows, n_slots), "shard-slots")
    first = stored(initial_map(sizes, n_shards), "shard-map")
    edited = stored(rebalance(first, sizes, n_shards), "shard-map")
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    places = edited.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("n", within).join(F.broadcast(places), "virtual_slot")  # n_slots rows
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    return out, first.unionByName(edited), heavy


def with_shard(docs: DataFrame, current: DataFrame, heavy: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its virtual slot and shard by a stored map: what a writer needs.  No shuffle."""
    key, slot, shard = (free_name(docs, c) for c in ("text_key", "virtual_slot", "shard"))
    places = current.select(F.col("virtual_slot").alias(slot), F.col("shard").alias(shard))
    slotted = with_slot(docs.withColumn(key, text_key(text_col)), heavy, id_col, key, slot, n_slots).drop(key)
    return slotted.join(F.broadcast(places), slot).select(*docs.columns, slot, shard)
