"""Stored fits (S7): parameters and settings of fitted models as Parquet tables, read by every later table of the same fit.

A store is a folder; a fit lies under its key, written once. What a fit needs besides its numbers (items, categories,
quadrature, whether it converged) is stored with it, so scoring needs neither the data nor the fit again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from .irt import GpcmFit

ITEMS = (
    "scale string, position int, item string, slope double, intercepts array<double>, node_mass array<double>, low int, loglik double, "
    "iterations int, converged boolean, n bigint, n_nodes int"
)


def key_of(*parts) -> str:
    """A folder name for a fit from what defines it (data, model, settings)."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:24]


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def write_gpcm(self, key: str, fits: dict[str, GpcmFit]) -> None:
        rows = [
            (s, i, it, float(f.slope[i]), f.intercepts[i].tolist(), f.node_mass[i].tolist(), f.low, f.loglik, f.iterations, f.converged, f.n, f.n_nodes)
            for s, f in fits.items()
            for i, it in enumerate(f.items)
        ]
        self.spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("overwrite").parquet(self.path(key))

    def read_gpcm(self, key: str) -> dict[str, GpcmFit] | None:
        """The stored fits of a key by scale, or None if there are none."""
        try:
            table = self.spark.read.schema(ITEMS).parquet(self.path(key))
            rows = table.collect()  # one row per item
        except AnalysisException:  # no such folder
            return None
        out: dict[str, GpcmFit] = {}
        for scale in dict.fromkeys(r["scale"] for r in sorted(rows, key=lambda r: r["scale"])):
            mine = sorted((r for r in rows if r["scale"] == scale), key=lambda r: r["position"])
            f = mine[0]
            out[scale] = GpcmFit(
                [r["item"] for r in mine], np.array([r["slope"] for r in mine]), np.array([r["intercepts"] for r in mine]), f["low"], f["loglik"],
                f["iterations"], f["converged"], f["n"], f["n_nodes"], np.array([r["node_mass"] for r in mine]),
            )
        return out or None

    def gpcm(self, key: str, fit: Callable[[], dict[str, GpcmFit]]) -> dict[str, GpcmFit]:
        """The stored fits of a key; fitted and stored the first time."""
        found = self.read_gpcm(key)
        if found is None:
            self.write_gpcm(key, fit())
            found = self.read_gpcm(key)
        return found

    def catalog(self) -> DataFrame:
        """Every stored item parameter with the key of its fit."""
        from pyspark.sql import functions as F

        table = self.spark.read.schema(ITEMS).parquet(f"{self.root}/*")
        return table.withColumn("key", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def session_store(spark: SparkSession) -> ModelStore:
    """A store of this application in the shared checkpoint folder."""
    return ModelStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/sondeo-models-{spark.sparkContext.applicationId}")
