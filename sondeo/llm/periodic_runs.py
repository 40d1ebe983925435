"""Periodic runs of words (operator 11) through a dictionary of basic factors.

The dictionary names every stretch of 2^j neighbouring words of a text: equal stretches of one text have equal names,
and a name of length 2^(j+1) is the pair of the names of its halves. Stretches that occur once need no name, so the dictionary
shrinks from one level to the next and ends with the longest repeat. On every level a stretch whose next
occurrence lies within twice its length proposes the distance as a period; neighbouring stretches with the same distance are one
arithmetic progression and propose once. A proposal is extended to both sides by the names of falling length (n log n in all), and
of proposals for the same stretch of words the smallest period stays.

That finds every run with at least ``MIN_PERIODS`` periods: on the first level whose length 2^j is at least the period q,
the stretch at the begin of the run has its next occurrence exactly q words later (the q words from there are no power of a
shorter word), and it still lies in the run as 2^j + q < 3q.

Spark partitions the documents; a text is worked on in one task, in slices of some MB of whole texts. A text of n words takes about
4 n bytes a level, and only repeats make levels. NULL texts and texts without words have no runs and the empty rest. Repeated rows
are reported each. An empty table gives no rows. Only doc_id and text are read, so further columns of any name do not matter. Runs
are sorted by start, then period, so ties have one order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import ragged, text_slices

MIN_PERIODS = 4
MIN_WORDS = 6
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of words before each text (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty part
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[at]


class BasicFactors:
    """Names of the repeated stretches of 2^j words, level by level; -1 where a stretch is single or leaves its text."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        n = np.diff(at)
        text = np.repeat(np.arange(len(n)), n)
        self.end = np.repeat(at[1:], n)
        self.names: list[np.ndarray] = []
        self.next: list[tuple[np.ndarray, np.ndarray]] = []  # per level: positions, and the distance to the next equal stretch
        here = np.arange(len(codes))
        key = text * np.int64(int(codes.max(initial=0)) + 1) + codes
        while len(here):
            if not self._level(here, key, len(codes)):
                break
            size = 1 << (len(self.names) - 1)
            name = self.names[-1]
            here = np.flatnonzero(name[:-size] >= 0) if len(name) > size else here[:0]
            here = here[(name[here + size] >= 0) & (here + 2 * size <= self.end[here])]
            key = name[here].astype(np.int64) * np.int64(int(name.max()) + 1) + name[here + size]

    def _level(self, here: np.ndarray, key: np.ndarray, n: int) -> bool:
        order = np.argsort(key, kind="stable")
        key, here = key[order], here[order]
        same = key[1:] == key[:-1]
        if not same.any():
            return False
        repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rank = np.cumsum(np.concatenate([[True], ~same])) - 1
        name = np.full(n, -1, np.int32)
        name[here[repeated]] = rank[repeated]
        self.names.append(name)
        first = np.flatnonzero(same)
        self.next.append((here[first], here[first + 1] - here[first]))
        return True

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, distance) of each arithmetic progression of near occurrences, once for neighbours of equal distance."""
        at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level, (here, distance) in enumerate(self.next):
            near = distance <= 2 << level
            here, distance = here[near], distance[near]
            order = np.argsort(here)
            here, distance = here[order], distance[order]
            fresh = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (distance[1:] != distance[:-1])])[: len(here)]
            at.append(here[fresh])
            period.append(distance[fresh])
        return np.concatenate(at), np.concatenate(period)

    def equal_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from positions a and b > a on, in one text."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, size = self.names[level], 1 << level
            x, y = a + out, b + out
            ok = np.flatnonzero(y + size <= self.end[a])
            ok = ok[(name[x[ok]] >= 0) & (name[x[ok]] == name[y[ok]])]
            out[ok] += size
        return out

    def equal_before(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Number of equal words that end before positions a and b > a, in one text that begins at ``begin``."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, size = self.names[level], 1 << level
            x, y = a - out - size, b - out - size
            ok = np.flatnonzero(x >= begin)
            ok = ok[(name[x[ok]] >= 0) & (name[x[ok]] == name[y[ok]])]
            out[ok] += size
        return out


def runs_of(codes: np.ndarray, at: np.ndarray, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the texts whose words are ``codes[at[k]:at[k + 1]]``, in this order."""
    if min_periods < MIN_PERIODS:
        raise ValueError(f"runs of fewer than {MIN_PERIODS} periods are not all proposed")
    factors = BasicFactors(codes, at)
    here, period = factors.proposals()
    text = np.searchsorted(at, here, side="right") - 1
    begin = at[text]
    back = factors.equal_before(here, here + period, begin)
    length = back + factors.equal_after(here, here + period) + period
    start = here - back - begin
    good = length >= np.maximum(min_words, min_periods * period)
    rows = np.stack([text[good], start[good], length[good], period[good]], 1)
    rows = rows[np.lexsort(rows.T[::-1])]
    fresh = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])[: len(rows)]
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def dropped_words(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    step = np.zeros(int(at[-1]) + 1, np.int64)
    begin = at[rows[:, 0]] + rows[:, 1]
    np.add.at(step, begin + rows[:, 3], 1)
    np.add.at(step, begin + rows[:, 2], -1)
    return np.cumsum(step)[:-1] > 0


def find_runs(docs: DataFrame, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, runs (start word, length, smallest period) by start, then period, and ``collapsed``, the words
    that no run contains after its first period, joined by one space."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in text_slices(batches):
            words, at = words_of(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = runs_of(codes, at, min_periods, min_words)
            kept = ~dropped_words(rows, at) if len(rows) else np.ones(len(codes), bool)
            left = np.concatenate([[0], np.cumsum(kept)])[at]
            lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words if kept.all() else words.filter(pa.array(kept)))
            struct = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
            bounds = np.searchsorted(rows[:, 0], np.arange(len(at)))
            arrays = [
                batch.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct).cast(_RUN_TYPE),
                pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts ends in a planted period.

    With h = crc32(decimal doc_id) and g = h div 10, a text of n > 0 words with h mod 10 = 0 is written again from word a = g mod n on:
    word i becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Its words are joined by one space. Other texts,
    and those without a doc_id, stay as they are.
    """
    spaces = "[\\x20\\x09-\\x0D]+"
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(doc.cast("string").cast("binary"))
    words = F.filter(F.split(text, spaces), lambda w: w != "")
    n, g = F.size("_words"), F.expr("_h div 10")
    marked = docs.select(doc.alias("doc_id"), text.alias("text"), h.alias("_h")).withColumn("_hit", F.col("_h") % 10 == 0)
    cut = marked.withColumn("_words", F.when(F.col("_hit"), words))
    placed = cut.withColumn("_a", F.when(n > 0, (g % n).cast("int"))).withColumn("_p", F.expr("cast(1 + (size(_words) - _a) div (3 + (_h div 10) % 8) as int)"))
    again = F.concat(
        F.slice("_words", 1, F.col("_a")),
        F.transform(F.sequence(F.lit(0), n - F.col("_a") - 1), lambda i: F.element_at(F.col("_words"), F.col("_a") + i % F.col("_p") + 1)),
    )
    return placed.select("doc_id", F.when(F.coalesce(F.col("_a") >= 0, F.lit(False)), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digest_rows(found: DataFrame) -> DataFrame:
    """Per document of ``find_runs``: number of runs, the longest run (ties: smallest start, then period) and digests of all runs
    and of the collapsed text."""
    # Runs come by start, then period: the first of the greatest length is the answer.
    best = F.get(F.expr("filter(runs, r -> r.length = array_max(runs.length))"), F.lit(0))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        lines.alias("_lines"),
        "collapsed",
    ).select(
        "doc_id", "n_runs", "start", "length", "period",
        F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
