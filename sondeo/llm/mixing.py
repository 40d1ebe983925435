"""Mixing sources to target weights (operator 1): Pfair schedule of source blocks.

Every source is cut into blocks of ``block_rows`` documents. Block k of a source with weight
w = a / Q gets the release time floor(k / w) and the deadline ceil((k + 1) / w), counted in
slots of one block; earliest-deadline-first over the released blocks places one block per slot
and keeps each source less than one block away from its target at every slot. Integer
weights make that schedule periodic in Q = their sum, so one period of pattern (at most
``MAX_PERIOD`` slots, computed from the weights alone) places any number of blocks by
arithmetic. When a source runs out, a new phase shares the slots among the others in the
ratio of their weights. No row is dropped or repeated: the result is an order of all rows.

Rows of sources that the weights do not name, NULL included, form one pool ``OTHER`` with the
weight ``other``. Inside a source the order is that of md5 over doc_id and source, so a hot
source is ranked in many tasks. Repeated rows follow one another; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex_digits_for, rank_in_groups

OTHER = "(other)"
MAX_PERIOD = 10_000  # slots of a pattern: the sum of the weights
MAX_TABLE = 200_000  # pattern entries over all phases: the bound of what is broadcast
BLOCK_ROWS = 16


def edf_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of sum(weights) slots, earliest deadline first."""
    period = sum(weights.values())
    if not 0 < period <= MAX_PERIOD:
        raise ValueError(f"weights must sum to 1..{MAX_PERIOD}")
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s, 0) for s, a in sorted(weights.items()) if a > 0]  # (release, source, k)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, k)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)  # the weights fill every slot, so a block is always released
        slots[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return slots


def phases(weights: dict[str, int], rows: dict[str, int], block_rows: int) -> list[dict]:
    """Phases of the schedule as rows (source, first_block, n_blocks, phase, slot0, row0, a, period, slots).

    Sources are few (those of the weights); the state is one count for each."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done, slot0, row0, out, entries = dict.fromkeys(left, 0), 0, 0, [], 0
    for phase in range(len(left)):
        pattern = edf_period({s: weights[s] for s in left})
        period = sum(weights[s] for s in left)
        entries += period
        if entries > MAX_TABLE:
            raise ValueError(f"the schedule's patterns exceed {MAX_TABLE} entries: use coarser weights")
        last = {s: (n - 1) // weights[s] * period + pattern[s][(n - 1) % weights[s]] for s, n in left.items()}
        ends, width = min(last, key=last.get), min(last.values()) + 1
        for s in sorted(left):
            n = width // period * weights[s] + sum(x < width % period for x in pattern[s])
            out.append({"source": s, "first_block": done[s], "n_blocks": n, "phase": phase, "slot0": slot0, "row0": row0, "a": weights[s], "period": period, "slots": pattern[s]})
            done[s] += n
            left[s] -= n
        slot0 += width
        row0 += width * block_rows - (-rows[ends] % block_rows)  # only its last block can be short
        left = {s: n for s, n in left.items() if n}
    return out


MIX_COLUMNS = ["mix_source", "mix_block", "mix_slot", "mix_position"]
PHASE_SCHEMA = "array<struct<source:string,first_block:bigint,n_blocks:bigint,phase:int,slot0:bigint,row0:bigint,a:bigint,period:bigint,slots:array<bigint>>>"


def mix_sources(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with mix_source, mix_block (number in its source), mix_slot (of the schedule) and mix_position (0-based order); columns of those names are replaced."""
    if any(not isinstance(a, int) or a <= 0 for a in [*weights.values(), other]):
        raise ValueError("weights are positive integers")
    spark = docs.sparkSession
    weights = {**weights, OTHER: other}
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source")).cast("binary"))
    pool = F.when(F.col("source").isin(list(weights)), F.col("source")).otherwise(F.lit(OTHER))
    counts = {r[0]: r[1] for r in docs.groupBy(pool.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most len(weights) rows
    digits = hex_digits_for(sum(counts.values()))
    table = json.dumps(phases(weights, counts, block_rows))
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(table), PHASE_SCHEMA))).withColumnRenamed("source", "mix_source")
    names = [c for c in docs.columns if c not in MIX_COLUMNS]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")  # own names cannot clash inside it
    keyed = docs.select(row, F.col("doc_id").alias("_id"), pool.alias("mix_source"), key.alias("_key"), F.substring(key, 1, digits).alias("_bucket"))
    ranked = rank_in_groups(keyed, ["mix_source"], "_bucket", [F.col("_key"), F.col("_id")], "_rank")
    ranked = ranked.withColumn("mix_block", F.floor(F.col("_rank") / block_rows))
    plan = plan.select(*[F.col(c).alias("mix_source" if c == "mix_source" else f"_p_{c}") for c in plan.columns])
    inside = (F.col("mix_block") >= F.col("_p_first_block")) & (F.col("mix_block") < F.col("_p_first_block") + F.col("_p_n_blocks"))
    k = F.col("mix_block") - F.col("_p_first_block")
    local = F.floor(k / F.col("_p_a")) * F.col("_p_period") + F.element_at(F.col("_p_slots"), (F.pmod(k, F.col("_p_a")) + 1).cast("int"))
    joined = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.mix_source") == F.col("p.mix_source")) & inside)
    return joined.select(
        "_row.*",
        F.col("r.mix_source").alias("mix_source"),
        F.col("mix_block"),
        (F.col("_p_slot0") + local).alias("mix_slot"),
        (F.col("_p_row0") + local * block_rows + F.pmod(F.col("_rank"), F.lit(block_rows))).alias("mix_position"),
    )
