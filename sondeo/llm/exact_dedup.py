"""Exact dedup (operator 7): heavy-hitter split on normalised text digests.

Misra-Gries counters (Spark's ``freqItems`` aggregate, merged from partial sketches) name at
most ``1 / support`` digests that can hold more than ``support`` of the rows. Their winners are
verified by an exact, map-side combined aggregate and broadcast, so the copies of a hot text
are resolved where they are read; every other digest takes an ordinary shuffle.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; NULL
counts as empty. Of equal texts the row with the most code points stays, then the smallest
doc_id (NULL ids last); of rows repeated with the same doc_id one stays. Extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, save, text_or_empty

# Misra-Gries keeps 1 / SUPPORT counters: the bound of what is broadcast.
SUPPORT = 1.0 / 2000


def text_digest(text: Column) -> Column:
    """Lower-case hex sha256 of the text without its white space, in UTF-8."""
    return F.sha2(F.translate(text, ASCII_SPACE, "").cast("binary"), 256)


def heavy_winners(keyed: DataFrame, order: Column, support: float = SUPPORT) -> DataFrame:
    """One row (digest, winner, group_size) for each digest that Misra-Gries reports, at most
    ``1 / support``; counts and winners are exact."""
    items = keyed.select("_digest").stat.freqItems(["_digest"], support)
    frequent = items.select(F.explode(F.col("_digest_freqItems")).alias("_digest"))
    return (
        keyed.join(F.broadcast(frequent), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.min(order).alias("_winner"), F.count(F.lit(1)).alias("_size"))
    )


def duplicate_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(docs)
    keyed = save(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            F.char_length(text).alias("_len"),
            text_digest(text).alias("_digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    order = F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("_row").alias("r"))
    heavy = save(heavy_winners(keyed, order, support), "heavy")
    marked = keyed.join(F.broadcast(heavy), "_digest", "left")
    light = keyed.join(F.broadcast(heavy), "_digest", "left_anti")
    small = light.groupBy("_digest").agg(F.min(order).alias("_winner"), F.count(F.lit(1)).alias("_size"))
    rows = marked.where("_winner IS NOT NULL").select(*keyed.columns, "_winner", "_size").unionByName(light.join(small, "_digest").select(*keyed.columns, "_winner", "_size"))
    return rows.select(
        "doc_id",
        F.col("_winner.i").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_winner.r")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with their columns: copies of heavy digests go map-side, the rest by a
    per-digest first row whose map-side limit thins each partition before the shuffle."""
    text = text_or_empty(docs)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")  # own names cannot clash inside it
    wide = docs.select(row, docs["doc_id"].alias("doc_id"), F.char_length(text).alias("_len"), text_digest(text).alias("_digest"))
    keyed = save(wide.select("doc_id", "_len", "_digest"), "digests")
    order = F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    heavy = save(heavy_winners(keyed, order, support), "heavy")
    loses = F.col("_winner").isNotNull() & ((-F.col("_len") != F.col("_winner.l")) | ~F.col("doc_id").eqNullSafe(F.col("_winner.i")))
    first = W.partitionBy("_digest").orderBy(F.col("_len").desc(), F.col("doc_id").asc_nulls_last())
    return (
        wide.join(F.broadcast(heavy), "_digest", "left")
        .where(~loses)
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .select("_row.*")
    )
