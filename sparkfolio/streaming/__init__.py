"""Streams: the latest state of each run, windowed counts, and interval maps (operators.intervals.stream_periods)."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _latest(key, batches, state: GroupState):
    seen, n, last_ts, last_type = state.get if state.exists else (0, 0, pd.Timestamp(0), "")
    total = seen
    for pdf in batches:
        total += len(pdf)
        n += int((pdf.event_type == "purchase").sum())
        i = pdf.sort_values(["ts", "event_id"]).iloc[-1]
        if i.ts >= last_ts:
            last_ts, last_type = i.ts, i.event_type
    state.update((total, n, last_ts, last_type))
    yield pd.DataFrame([(key[0], total, n, last_ts, last_type)], columns=["run", "events", "purchases", "last_ts", "last_type"])


def run_snapshots(events: DataFrame, run: str = "user_id") -> DataFrame:
    """Update-mode snapshots per run: events and purchases so far and the latest event, kept in keyed state."""
    rows = events.where(F.col(run).isNotNull()).select(F.col(run).cast("long").alias("run"), "event_id", "ts", "event_type")
    return rows.groupBy("run").applyInPandasWithState(
        _latest, "run long, events long, purchases long, last_ts timestamp, last_type string", "events long, purchases long, last_ts timestamp, last_type string", "update", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "30 minutes") -> DataFrame:
    """Events and value per type and tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def _shared_folder(spark, name: str) -> str:
    """A new folder in the session's shared one (spark.checkpoint.dir); a local session without one gets its own, which goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkfolio-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def replay(updates: DataFrame) -> DataFrame:
    """All updates of a stream over what its source holds now, as a table of files: nothing of them is kept on the driver."""
    spark = updates.sparkSession
    out = _shared_folder(spark, "updates")
    schema = updates.schema

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data") if os.path.isdir(f"{out}/data") or "://" in out else spark.createDataFrame([], schema)
