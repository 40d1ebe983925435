"""Result sinks (S6-S8): parquet tables, per-wave partitions, result catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """``write_parquet`` (S6); ``partition_by=["wave"]`` writes one directory per wave."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_two_row_export(df: DataFrame, path: str, top: Sequence[str], bottom: Sequence[str], mode: str = "overwrite") -> None:
    """Delimited files with a header of two rows, as survey tools write them: the inverse of ``exports.read_two_row_header``.

    Every file begins with both rows; columns are written as text in the order of ``top``. Repeated names are allowed.
    """
    import pyarrow as pa

    fields = [f"c{i}" for i in range(len(top))]
    header = [list(top), list(bottom)]
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f) for c, f in zip(df.columns, fields, strict=True)])

    def with_header(batches):
        for i, b in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()) for names in zip(*header, strict=True)], fields)
            yield pa.RecordBatch.from_arrays(b.columns, fields)

    lines = text.mapInArrow(with_header, ", ".join(f"{f} string" for f in fields))
    lines.write.mode(mode).option("header", False).option("emptyValue", "").csv(path)


def write_results(tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, str]:
    """Persist named result tables (coefficients, item statistics, ...)."""
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(path)
        out[name] = path
    return out


def read_results(spark: SparkSession, root: str, pattern: str = "*", name_regex: str | None = None, name_col: str = "model") -> DataFrame:
    """Load many result tables at once and name each row by its source path.

    One distributed read over ``root/pattern``; ``name_regex`` extracts the
    name from ``_metadata.file_path`` (NULL when it does not match).
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{pattern}")
    path = F.url_decode(F.col("_metadata.file_path"))
    if name_regex:
        name = F.regexp_substr(path, F.lit(name_regex))
    else:
        name = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    return df.withColumn(name_col, name)
