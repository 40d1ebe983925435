"""Survey-export ingestion.

Headers are metadata: the (at most two) header rows are read with
``limit(2)``, resolved into names on the driver, and the data rows are read
distributed with those names. Binary workbook decoding is out of scope;
exports arrive as delimited text or parquet.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


def with_ordinal(df: DataFrame, name: str = ROW) -> DataFrame:
    """Attach an ingestion ordinal right after the scan (file path, then position).

    ``monotonically_increasing_id`` grows with partition index and position
    inside it; partitions of one file follow its byte order, so ordering by
    (file, ordinal) reproduces file order without a sort or shuffle here.
    """
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn(name, F.monotonically_increasing_id())


def read_export(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    schema: str | None = None,
    header: bool = True,
    ordinal: bool = True,
    **options,
) -> DataFrame:
    """Read a survey export (S1, S5). ``schema`` avoids inference on large inputs."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("multiLine", options.pop("multiLine", False))
    if schema:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path if isinstance(path, str) else list(path))
    return with_ordinal(df) if ordinal else df


def merge_header(top: Sequence[str | None], bottom: Sequence[str | None], other: str = "Otro") -> list[str]:
    """Resolve a two-row header (S3).

    The bottom name wins unless it is auto-named -- blank, "...N", or one of
    several equal bottom names (a spreadsheet reader suffixes all of them);
    then the column is "Otro" if the bottom mentions it, else the top name
    (itself auto-named "...N" when blank).
    """
    out, times = [], Counter((b or "").strip() for b in bottom)
    for i, (t, b) in enumerate(zip(top, bottom)):
        t_name = (t or "").strip() or f"...{i + 1}"
        b_name = (b or "").strip()
        auto = not b_name or "..." in b_name or times[b_name] > 1
        if auto:
            out.append(other if other in b_name else t_name)
        else:
            out.append(b_name)
    return out


def clean_name(name: str) -> str:
    """snake_case ASCII name (S4): accents stripped, case boundaries and
    non-alphanumerics become "_", leading digit prefixed with "x"."""
    s = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(names: Sequence[str]) -> list[str]:
    """``janitor::clean_names``: :func:`clean_name` plus ``_2``, ``_3`` for duplicates."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        c = clean_name(n)
        if c in seen:
            seen[c] += 1
            out.append(f"{c}_{seen[c]}")
        else:
            seen[c] = 1
            out.append(c)
    return out


def header_rows(spark: SparkSession, path: str, n: int = 2, **options) -> list[list[str | None]]:
    """The first ``n`` physical rows of a delimited file (tiny metadata read)."""
    raw = spark.read.options(header=False, **options).csv(path).limit(n).collect()
    return [list(r) for r in raw]


def read_two_row_header(
    spark: SparkSession,
    path: str | Sequence[str],
    header_path: str | None = None,
    clean: bool = True,
    **options,
) -> DataFrame:
    """Export whose first two rows are a header (S2, S3, S4), from any number of files in one scan.

    The names come from ``header_path`` (default: the first path; one header may serve several files).
    Spark's CSV reader drops the first line of each file; the second one is the first row of the
    split that begins at the file's first byte, whatever it holds, and is dropped where it is read. The result carries
    ``_file``, ``_block`` (first byte of the split) and ``_place`` (place of a row in its split): ordered by these three, rows come
    in file order, without a shuffle here; ``_row`` is one number that tells all rows apart. Paths may hold blanks; a path may be a folder of such files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    top, bottom = header_rows(spark, header_path or paths[0], 2, **options)
    names = merge_header(top, bottom)
    if clean:
        names = clean_names(names)
    fields = [f"c{i}" for i in range(len(names))]
    rows = spark.read.options(header=True, enforceSchema=True, **options).schema(", ".join(f"{f} string" for f in fields)).csv(paths)
    placed = rows.select(*fields, F.url_decode(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    schema = ", ".join(f"{f} string" for f in fields) + ", _file string, _block long, _place long"
    rows = placed.mapInArrow(_drop_second_line, schema).toDF(*names, "_file", "_block", "_place")
    return rows.withColumn(ROW, F.monotonically_increasing_id())


def _drop_second_line(batches):
    """Number the rows of each split (rows of a task come split by split, in order) and drop the first one of splits at byte 0."""
    import numpy as np
    import pyarrow as pa

    last, seen = None, 0
    for b in batches:
        files, blocks = b.column("_file").to_pylist(), b.column("_block").to_pylist()
        place = np.zeros(b.num_rows, np.int64)
        for i, key in enumerate(zip(files, blocks, strict=True)):
            if key != last:
                last, seen = key, 0
            place[i] = seen
            seen += 1
        keep = (place > 0) | (np.array(blocks, np.int64) > 0)
        out = pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "_place"])
        yield out.filter(pa.array(keep))


def ingest_waves(frames: Mapping[str, DataFrame], transform: Callable[[DataFrame], DataFrame] | None = None, wave_col: str = "wave") -> DataFrame:
    """One pipeline over many files (S9): the same transform per wave, stacked by name."""
    out = []
    for wave, df in frames.items():
        d = transform(df) if transform else df
        out.append(d.withColumn(wave_col, F.lit(wave)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
