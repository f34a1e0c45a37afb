"""New versions arriving as a stream of facts, added to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.rules import Rule, materialize
from ..plans.store import FactStore


def ingest(facts: DataFrame, store: FactStore, checkpoint: str, rules: list[Rule] = ()) -> StreamingQuery:
    """Adds each batch of a stream (s, p, o), then runs the rules; what is there already isn't added again,
    so that a batch that is repeated after a failure changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        store.insert(df)
        if rules:
            materialize(store, list(rules))

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fact_stream(spark: SparkSession, path: str) -> DataFrame:
    """Facts from Parquet files as they arrive in a folder."""
    return spark.readStream.schema("s string, p string, o string").parquet(path)
