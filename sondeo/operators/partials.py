"""Sums of numpy arrays over all rows of a frame.

Each task adds up its rows and hands on one row per cell that is not zero; Spark adds the cells of all tasks in an
ordinary grouped aggregate. What reaches the driver is one row per cell, however many rows, batches or tasks there are.
The cells are dealt over the partitions that they need, not over those set for the shuffles of rows: a task writes one file for each,
again in every pass of a fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_CELLS = 20_000  # cells that one task adds up, each from as many rows as the pass has tasks


def summed(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """``add(batch, total)`` adds a batch into a vector of ``size`` cells; the sum of the vectors of all tasks."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], ["cell", "value"])

    parts = df.mapInArrow(run, "cell long, value double")
    needed = max(1, math.ceil(size / TASK_CELLS))
    if needed < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        parts = parts.repartition(needed, "cell")
    out = np.zeros(size)
    rows = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out[rows.column("cell").to_numpy()] = rows.column("value").to_numpy()
    return out
