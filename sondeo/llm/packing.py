"""Best-fit packing (operator 10): best-fit decreasing over token counts with a segment tree.

Documents are tokenized once, get an end id and, if longer than a sequence, are cut into
full pieces from their end. Best-fit decreasing only looks at lengths, so the whole
corpus is packed from the histogram of piece lengths (at most ``capacity`` numbers): open bins
with equal room are interchangeable and are kept as runs of sequence ids, and a segment tree over the
remaining capacities finds the tightest room that fits in logarithmic time. That
gives the very packing that one pass over all pieces in falling order gives, in memory that does not grow
with the corpus. Pieces then look their place up by (length, rank among equal lengths).

NULL and empty texts are one end id long and are packed like any other. Repeated rows are packed
each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_digits_for, rank_in_groups, save
from .tokens import load, text_slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def file_order(docs: DataFrame) -> Column:
    """Place of each row of a stored table as a string that sorts: number of the part file, row in the file."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    return F.concat(F.lpad(part, 10, "0"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))


def _block(place: Column) -> Column:
    """Rows of a part file by the million: monotone in ``file_order``."""
    return F.substring(place, 1, 16)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, place: Column | None = None) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, on request, the document's place in an
    order (see ``file_order``) and the ids themselves."""

    ordered = place is not None

    def cut(batches):
        tok = load(tokenizer_path)
        for batch in text_slices(batches):
            flat, at = tok.encode(batch.column("text"))
            keys, out = batch.column("doc_id").to_pylist(), []
            for i, key in enumerate(keys):
                ids = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for k in range(len(bounds) - 1):
                    part = ids[bounds[k] : bounds[k + 1]]
                    out.append((key, k, bounds[k], len(part), zlib.crc32(part.tobytes()), part if keep_ids else None, i))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(cols[j], pa.int64()) for j in (2, 3, 4)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ordered:
                arrays.append(batch.column("place").take(pa.array(cols[6], pa.int64())))
                names.append("place")
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    extra = [place.alias("place")] if ordered else []
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return source.mapInArrow(cut, PIECES + (", place string" if extra else "") + (", ids array<int>" if keep_ids else ""))


class RoomTree:
    """Segment tree over remaining capacities 0..size: which of them have open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.any[i] = used
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest room of at least ``need`` with an open bin."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Placements of the best-fit decreasing packing and its number of sequences.

    A placement row (length, first_rank, n_pieces, first_sequence, n_sequences, offset) puts
    pieces of that length with ranks from first_rank into n_sequences neighbouring sequences, round after round:
    piece x of them goes to sequence x mod n_sequences, at offset + (x div n_sequences) * length.
    """
    tree, rooms, out, opened = RoomTree(capacity), {}, [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length  # a bin just used stays the tightest while the length fits
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, full, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, first, full)
            if left and full < n:
                out.append((length, rank, left, first + full, 1, capacity - room))
                put_back(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put_back(room, first + full, n - full)
    return np.array(out, np.int64).reshape(-1, 6), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a stored table) with their sequence_id and offset."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {int(r["length"]): int(r["n"]) for r in counts}
    plan, _ = best_fit_decreasing(histogram, capacity)
    digits = hex_digits_for(sum(histogram.values()))
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("piece").cast("string")).cast("binary"))
    bucket = F.substring(key, 1, digits)
    if "place" in pieces.columns:
        key, bucket = F.col("place"), _block(F.col("place"))
    keyed = pieces.withColumns({"_key": key, "_bucket": bucket})
    ranked = rank_in_groups(keyed, ["length"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("piece")], "_rank")
    names = pieces.columns
    wide = np.int64(1) << 42  # ranks of one length stay below it
    keys = plan[:, 0] * wide + plan[:, 1]
    order = np.argsort(keys)
    plan, keys = plan[order], keys[order]

    def put(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = plan[np.searchsorted(keys, length * wide + rank, side="right") - 1] if len(rank) else plan[:0]
            x = rank - row[:, 1]
            extra = [pa.array(row[:, 3] + x % np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + x // np.maximum(row[:, 4], 1) * length)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *extra], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = ranked.select(*names, "_rank").mapInArrow(put, schema + ", sequence_id long, offset long")
    return number_by_place(save(placed, "placed")) if "place" in names else placed


def number_by_place(placed: DataFrame) -> DataFrame:
    """Packed pieces whose sequences are numbered by their earliest place, without the column ``place``."""
    first = placed.groupBy("sequence_id").agg(F.min("place").alias("_first")).withColumn("_bucket", _block(F.col("_first")))
    ranked = rank_in_groups(first, [], "_bucket", [F.col("_first"), F.col("sequence_id")], "_number")
    numbers = ranked.select("sequence_id", "_number")
    kept = [c for c in placed.columns if c != "place"]
    return placed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number")).select(*kept)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, place: Column | None = None) -> DataFrame:
    """Every piece of every document with its place: sequence_id (from 0) and offset in it."""
    return pack(save(token_pieces(docs, tokenizer_path, end_id, capacity, keep_ids, place), "pieces"), capacity)
