"""Model designs: the complete rows of a family of models, encoded once.

Factors become level codes (levels ascending, as in R), numbers stay doubles, and every model of the family is a choice of columns of
one wide design: the intercept, an indicator of every level of every factor, the numbers. Which level is the reference, and
which columns carry no information of their own, is decided per model and segment from the moments, so a segment in which a level does not
occur needs no design of its own. Levels are what the data hold; their number is the number of columns and bounded by the models, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import col
from ..session import reliable_cache

_DISCRETE = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
ROW_BLOCK = 16_384  # rows of the dense design that a task holds at once; the encoded rows are kept in blocks of so many at most


class Design:
    """Encoded complete rows of ``response``, ``terms``, ``groups`` (random intercepts) and ``segment``.

    With only discrete terms the likelihood depends on the rows through trials and successes per cell, so the rows
    are first collapsed to cells by one partially aggregated ``groupBy``.
    """

    def __init__(self, df: DataFrame, response: str, terms: Sequence[str], groups: Sequence[str] = (), segment: str | None = None, complete: bool = True):
        self.response, self.terms, self.groups, self.segment = response, list(terms), list(groups), segment
        keys = list(dict.fromkeys([*terms, *groups, *([segment] if segment else [])]))
        data = df.select(*[col(c) for c in dict.fromkeys([response, *keys])])
        if complete:
            data = data.dropna("any")
        kind = {f.name: f.dataType for f in data.schema.fields}
        self.factors = [t for t in self.terms if isinstance(kind[t], T.StringType)]
        self.numbers = [t for t in self.terms if t not in self.factors]
        y = col(response).cast("double")
        self.collapsed = all(isinstance(kind[t], _DISCRETE) for t in self.terms)
        if self.collapsed:
            data = data.groupBy(*[col(k) for k in keys]).agg(F.sum(y).alias("__y"), F.count(F.lit(1)).cast("double").alias("__w"))
        else:
            data = data.select(*[col(k) for k in keys], y.alias("__y"), F.lit(1.0).alias("__w"))
        coded = list(dict.fromkeys([*self.factors, *self.groups, *([segment] if segment else [])]))
        data = data.select("__y", "__w", *[col(c).cast("string").alias(f"f{i}") for i, c in enumerate(coded)], *[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(self.numbers)])
        data = data.persist()
        try:
            found = data.agg(*[F.collect_set(f"f{i}").alias(f"f{i}") for i in range(len(coded))], F.sum("__w").alias("n")).first()
            self.n = int(round(found["n"] or 0))
            self.levels = {c: sorted(found[f"f{i}"]) for i, c in enumerate(coded)}
            self.frame = reliable_cache(_encode(data, [self.levels[c] for c in coded], len(self.numbers)), row_bytes=ROW_BLOCK * (4 * len(coded) + 8 * len(self.numbers) + 16))
        finally:
            data.unpersist()
        self.code = {c: f"f{i}" for i, c in enumerate(coded)}
        self.columns: list[tuple[str, str]] = [("", "(Intercept)")]  # (term, name)
        self.first: dict[str, int] = {}
        for t in self.terms:
            self.first[t] = len(self.columns)
            self.columns += [(t, f"{t}{v}") for v in self.levels[t]] if t in self.factors else [(t, t)]
        self.segments = self.levels[segment] if segment else [None]

    @property
    def width(self) -> int:
        return len(self.columns)

    def reader(self):
        """A function that cuts a batch into blocks (dense design, successes, trials, codes of the groups, codes of the segment);
        it holds no reference to the frame, so it can be sent to tasks."""
        width = self.width
        factors = [(self.code[t], self.first[t]) for t in self.factors]
        numbers = [(f"x{i}", self.first[t]) for i, t in enumerate(self.numbers)]
        groups = [self.code[g] for g in self.groups]
        segment = self.code[self.segment] if self.segment else None

        def blocks(batch: pa.RecordBatch):
            for block in batch.column("block"):
                part = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
                get = lambda name: part.column(name).to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, width))
                x[:, 0] = 1.0
                rows = np.arange(part.num_rows)
                for name, first in factors:
                    x[rows, first + get(name)] = 1.0
                for name, at in numbers:
                    x[:, at] = get(name)
                yield x, get("y"), get("w"), [get(g) for g in groups], get(segment) if segment else None

        return blocks

    def close(self) -> None:
        self.frame.unpersist()


def _encode(data: DataFrame, levels: list[list[str]], numbers: int) -> DataFrame:
    """The encoded rows, many in a value: the passes over them read whole columns instead of converting every row again."""
    names = ["y", "w", *[f"f{i}" for i in range(len(levels))], *[f"x{i}" for i in range(numbers)]]

    def run(batches):
        sets = [pa.array(v, pa.string()) for v in levels]
        for b in batches:
            codes = [pc.index_in(b.column(f"f{i}"), value_set=v) for i, v in enumerate(sets)]
            encoded = pa.RecordBatch.from_arrays([b.column("__y"), b.column("__w"), *codes, *[b.column(f"x{i}") for i in range(numbers)]], names)
            for lo in range(0, b.num_rows, ROW_BLOCK):
                part, sink = encoded.slice(lo, ROW_BLOCK), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return data.mapInArrow(run, "block binary")
