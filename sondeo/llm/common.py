"""Shared pieces of the training-data operators: scratch tables and bounded ranking."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# The white space of the text contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


ARROW_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in Arrow batches of a few MB: bounds what a worker holds at once, and narrow
    rows (keys, pairs) still travel by the thousands."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sondeo-llm-{uuid.uuid4().hex[:12]}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts the lineage, so a lost
    executor costs a re-read of the files and nothing upstream runs twice."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a frame made by ``save`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(df: DataFrame, col: str = "text") -> Column:
    """The text column as a string, NULL as the empty text."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def hex_digits_for(rows: int, per_bucket: int = 2000) -> int:
    """Leading hex digits of an md5 that cut ``rows`` rows into buckets of about ``per_bucket``."""
    return max(1, math.ceil(math.log(max(rows, 1) / per_bucket, 16))) if rows > per_bucket else 1


def rank_in_groups(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Gapless 0-based rank of every row in its group, without a task that sees a whole group.

    ``bucket`` must be monotone in the order (for instance its leading hash digits). Rows are
    ranked inside (group, bucket); the offsets are running sums of the bucket counts, which
    a map-side combined aggregate makes. Group and bucket columns must not be NULL.
    """
    sizes = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order))
    return (
        df.withColumn("_in", inner)
        .join(offsets, [*group, bucket])
        .withColumn(name, F.col("_before") + F.col("_in") - 1)
        .drop("_before", "_in")
    )
