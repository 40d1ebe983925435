"""Incremental ingestion of survey-wave files (S9 as a stream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def wave_stream(
    spark: SparkSession,
    landing: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    fmt: str = "parquet",
    wave_regex: str = r"wave=([^/]+)",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming frame of new export files; ``wave`` comes from the file path."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(landing)
    df = df.withColumn("wave", F.regexp_extract(F.col("_metadata.file_path"), wave_regex, 1))
    return transform(df)


def start_wave_ingestion(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    partition_by: tuple[str, ...] = ("wave",),
    available_now: bool = True,
) -> StreamingQuery:
    """Append the cleaned rows to a parquet table partitioned by wave.

    The file sink with a checkpoint is exactly-once: a restarted query resumes
    from the last committed batch, so a lost executor or driver only replays
    uncommitted files.
    """
    w = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).partitionBy(*partition_by).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
