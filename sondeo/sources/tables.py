"""Access to the parquet tables of a data directory.

Readers project the columns a plan needs right at the scan so that Catalyst's
``ReadSchema`` only carries them; filters written later are pushed into the
parquet reader by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None, balance: bool = False) -> DataFrame:
    """Read one table; ``columns`` prunes at the scan.

    ``balance`` guards fact tables stored as very few splits (one row group
    cannot be read by more than one task): when the planned scan has fewer
    partitions than the cluster's default parallelism, rows are spread
    round-robin so the per-row work before the first shuffle uses every core.
    On large inputs the scan already has more splits and nothing is added.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    if balance:
        try:
            target = spark.sparkContext.defaultParallelism
            planned = df.rdd.getNumPartitions()
        except Exception:  # no RDD API (e.g. Spark Connect): keep the scan as planned
            return df
        if planned < target:
            df = df.repartition(target)
    return df
