"""Session helpers shared by queries, bench and tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkfolio")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A small parquet file is one split, so one task would do all the work on its rows; an input with enough
    splits stays as it is and isn't shuffled.  Select only what is needed before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Most rows of a table that is said to be small and goes to every worker.
SMALL = 100_000


def small_rows(df: DataFrame, what: str, most: int = SMALL) -> list[Row]:
    """The distinct rows of a small table; an error, not a cut, if there are more than `most`."""
    rows = df.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
