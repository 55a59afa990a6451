"""Overlapping and gapped intervals -> continuous periods and the gaps between them.

Keyed state: one ordered map of disjoint half-open intervals per entity.  An insertion finds the
intervals it touches by binary search and merges them; the gaps are what lies between neighbours.
Batch runs build partial maps where the rows lie (before any shuffle), then merge the few disjoint
intervals left per entity.  `stream_periods` keeps the same map in Structured Streaming state.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .timestamps import TODAY_MONTH, local_month, normalise_dates

#: Entities a task keeps open before it hands their partial maps on.
OPEN_ENTITIES = 50_000


class IntervalMap:
    """Ordered disjoint half-open intervals; touching ones are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts=(), ends=()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start, end) -> None:
        if start >= end:
            return
        i = bisect.bisect_left(self.ends, start)
        j = bisect.bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def periods(self):
        return list(zip(self.starts, self.ends))

    def gaps(self):
        return list(zip(self.ends, self.starts[1:]))


def _partial(batches):
    maps: dict = {}

    def flush():
        rows = [(k, s, e) for k, m in maps.items() for s, e in m.periods()]
        maps.clear()
        return pd.DataFrame(rows, columns=["entity", "start", "end"]).astype({"start": "int64", "end": "int64"})

    for pdf in batches:
        for k, s, e in zip(pdf.entity.tolist(), pdf.start.tolist(), pdf.end.tolist()):
            m = maps.get(k)
            if m is None:
                m = maps[k] = IntervalMap()
            m.insert(s, e)
        if len(maps) > OPEN_ENTITIES:
            yield flush()
    if maps:
        yield flush()


def _final(batches):
    """Rows sorted by entity -> its periods and gaps."""
    key, held = None, IntervalMap()

    def rows():
        return [] if key is None else [(key, "period", s, e) for s, e in held.periods()] + [(key, "gap", s, e) for s, e in held.gaps()]

    for pdf in batches:
        out = []
        for k, s, e in zip(pdf.entity.tolist(), pdf.start.tolist(), pdf.end.tolist()):
            if k != key:
                out += rows()
                key, held = k, IntervalMap()
            held.insert(s, e)
        if out:
            yield pd.DataFrame(out, columns=["entity", "kind", "start", "end"])
    if out := rows():
        yield pd.DataFrame(out, columns=["entity", "kind", "start", "end"])


def merge_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, kind 'period'|'gap', start, end) for integer half-open intervals.

    Rows with a null entity or bound, or start >= end, count for nothing; repeated rows change nothing;
    an empty table gives an empty result.
    """
    rows = df.select(F.col(entity).cast("long").alias("entity"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    rows = rows.where("entity is not null and start is not null and end is not null and start < end")
    partial = rows.mapInPandas(_partial, "entity long, start long, end long")
    merged = partial.repartition("entity").sortWithinPartitions("entity").mapInPandas(_final, "entity long, kind string, start long, end long")
    return merged.select(F.col("entity").alias(entity), "kind", F.col("start").alias(start), F.col("end").alias(end))


@F.pandas_udf(T.LongType())
def norm_month(norm: pd.Series, tz: pd.Series) -> pd.Series:
    """Absolute month of a normalised date: a bare year is its January, an instant counts in the record's own zone."""
    return pd.Series([local_month(n, z) for n, z in zip(norm, tz)], dtype="Int64")


def entry_months(entries: DataFrame, today_month: int = TODAY_MONTH) -> DataFrame:
    """(cv_id, start_months, end_months) of each entry: as recorded, else as read from dates_raw."""
    cut = today_month + 1
    rec = entries.where("start_months is not null").select("cv_id", F.col("start_months").cast("long"), F.coalesce(F.col("end_months"), F.lit(cut)).cast("long").alias("end_months"))
    # The readings of a source depend on each other, so all its records are read and then joined.
    blank = entries.where("start_months is null and end_months is null").select("entry_id", "cv_id", "tz").distinct()
    dated = normalise_dates(entries).join(blank, F.col("record_id") == F.col("entry_id"))
    read = dated.select("cv_id", norm_month("start_norm", "tz").alias("start_months"), F.when(F.col("end_norm") == "present", F.lit(cut)).otherwise(norm_month("end_norm", "tz") + 1).alias("end_months"))
    return rec.unionByName(read).withColumn("end_months", F.least("end_months", F.lit(cut)))


def employment_periods(entries: DataFrame, today_month: int = TODAY_MONTH) -> DataFrame:
    """p3: continuous employment periods and gaps per CV, as int months."""
    out = merge_intervals(entry_months(entries, today_month), "cv_id", "start_months", "end_months")
    return out.select("cv_id", "kind", F.col("start_months").cast("int"), F.col("end_months").cast("int"))


def _update(key, batches, state: GroupState):
    held = IntervalMap(*state.get) if state.exists else IntervalMap()
    for pdf in batches:
        for s, e in zip(pdf.start.tolist(), pdf.end.tolist()):
            held.insert(s, e)
    state.update((held.starts, held.ends))
    rows = [(key[0], "period", s, e) for s, e in held.periods()] + [(key[0], "gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame(rows, columns=["entity", "kind", "start", "end"])


def stream_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The same operator over a stream: each update gives the entity's whole current list."""
    rows = df.select(F.col(entity).cast("long").alias("entity"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    rows = rows.where("entity is not null and start is not null and end is not null and start < end")
    return rows.groupBy("entity").applyInPandasWithState(
        _update, "entity long, kind string, start long, end long", "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout
    )
