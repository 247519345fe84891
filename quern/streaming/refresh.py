"""Refresh as a stream: the batch functions over what is new.

Files: each micro-batch goes through the same intake; ids are hashes and known
contents are skipped, so a replayed batch changes nothing.  Events: windowed
counts with a watermark, and the open assertion of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.catalog import Catalog
from quern.intake import ingest_files
from quern.settings import Settings
from quern.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(catalog: Catalog, folder: str, workspace: str, checkpoint: str, settings: Settings = Settings(), per_batch: int = 500) -> StreamingQuery:
    """Ingest what a folder has and ends; run again, it takes what has come since."""
    base = folder.rstrip("/").removeprefix("file://")
    found = catalog.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)

    def one(batch: DataFrame, _: int) -> None:
        rows = files.named(batch, base)
        ingest_files(catalog, files.expanded(rows), workspace, settings)

    return found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in windows; what comes later than ``late`` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


OPEN = "user_id long, event_type string, event_id long, value double, asserted_at timestamp"
_STATE = "event_id long, value double, us long"


def _latest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    for part in parts:
        for event, value, ts in zip(part["event_id"], part["value"], part["ts"]):
            us = int(pd.Timestamp(ts).value // 1000)
            if best is None or (us, event) > (best[2], best[0]):
                best = (int(event), float(value), us)
    if best is not None:
        state.update(best)
        yield pd.DataFrame([(*key, best[0], best[1], pd.Timestamp(best[2] * 1000))], columns=["user_id", "event_type", "event_id", "value", "asserted_at"])


def open_assertions(events: DataFrame) -> DataFrame:
    """The last event of each user and type, as updates; late events change nothing."""
    timed = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_type", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(_latest, OPEN, _STATE, "update", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
