"""Token-ID / binary output (operator 4): canonical length-limited Huffman files.

Texts are tokenized once to a scratch table. Global id counts (at most the vocabulary) give
code lengths of at most ``MAX_BITS`` by package-merge and from them a canonical code. The
documents are range-partitioned and sorted by doc_id and written as independent blocks: a
block holds whole documents, the bit stream of their ids and the bit offset of every
``STEP``-th id. Readers decode all checkpoints of some blocks side by side with one table lookup per
id. The store is a folder with two Parquet tables, ``blocks`` and ``codebook``.

NULL and empty texts are stored as their end id; NULL doc_ids come first; rows that repeat a
doc_id follow each other in the order of a text hash; an empty table makes an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, scratch_path
from .tokens import load, text_slices

MAX_BITS = 18
STEP = 256  # ids between checkpoints
BLOCK_IDS = 1 << 16
DECODE_IDS = 1 << 20  # ids decoded side by side

BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<long>, n_tokens array<int>, checkpoints array<long>, bits binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each id (0: never used), by package-merge under the length limit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, row, levels = counts[order].astype(np.float64), np.zeros(0), []
    for _ in range(max_bits):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        levels.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: ids in the order (length, id) count upwards."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    codes = np.zeros(len(lengths), np.uint64)
    sizes = lengths[order].astype(np.int64)
    # The code of the next id is (code + 1) shifted by the growth in length: a left-aligned running sum.
    steps = np.uint64(1) << (np.uint64(MAX_BITS) - sizes.astype(np.uint64))
    starts = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]]) if len(order) else steps
    codes[order] = starts >> (np.uint64(MAX_BITS) - sizes.astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next MAX_BITS bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    runs = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    total = int(runs.sum())
    ids[:total], size[:total] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    return ids, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of ids (most significant bit first, eight bytes of padding) and the bit offset of each STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    value = codes[ids] << (np.uint64(64) - (size + (at & 31)).astype(np.uint64))
    words = int(ends[-1] // 32 + 3) if len(ids) else 2
    high = np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount((at >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return (high + low).astype(np.uint64).astype(">u4").tobytes(), at[::STEP]


def decode_blocks(bits: list[bytes], checkpoints: list[np.ndarray], n_ids: list[int], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of some blocks, one after the other: all checkpoints advance together, one id a round."""
    raw = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    base = np.cumsum([0, *[8 * len(b) for b in bits]])[:-1]
    at = np.concatenate([c + b for c, b in zip(checkpoints, base, strict=True)]) if bits else np.zeros(0, np.int64)
    left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(len(c))) for c, n in zip(checkpoints, n_ids, strict=True)]) if bits else at
    out = np.zeros((len(at), STEP), np.uint32)
    ids, size = table
    shift = np.uint32(32 - MAX_BITS)
    for k in range(STEP):
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[:, k] = ids[key]
        at = np.minimum(at + size[key], 8 * len(window) - 8)
    return out[np.arange(STEP) < left[:, None]]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Tokenize all texts and write the store, documents in ascending doc_id order."""
    spark = docs.sparkSession

    def tokenize(batches):
        tok = load(tokenizer_path)
        for batch in text_slices(batches):
            flat, at = tok.encode(batch.column("text"))
            n = np.diff(at) + 1
            ids = np.insert(flat, at[1:], end_id).astype("<u4")  # the end id of each document
            ends = np.concatenate([[0], np.cumsum(n)])
            small = ids.astype("<u2") if vocabulary <= 1 << 16 else ids
            blob = small.tobytes()
            width = small.itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(n.astype(np.int32)), pa.array([blob[a * width : b * width] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                ["doc_id", "tie", "n", "ids"],
            )

    vocabulary = max(load(tokenizer_path).plain.get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    tokens = save(source.mapInArrow(tokenize, "doc_id long, tie long, n int, ids binary"), "tokens")
    counts = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def encode(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys, sizes, blobs, held = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(blobs), dtype)
            bits, marks = encode_bits(ids, codes, lengths)
            row = [part, block, before, len(ids), list(keys), list(sizes), marks.tolist(), bits]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        names = ["part", "block", "before", "n_ids", "doc_ids", "n_tokens", "checkpoints", "bits"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for key, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                keys.append(key)
                sizes.append(n)
                blobs.append(ids.as_py())
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before, held = block + 1, before + held, 0
                    keys, sizes, blobs = [], [], []
        if keys:
            yield flush()

    sorted_rows = tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    sorted_rows.select("doc_id", "n", "ids").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    rows = ",".join(f"{i}:{n}" for i, n in enumerate(lengths.tolist()) if n)
    book = spark.range(1).select(F.explode(F.split(F.lit(rows), ",")).alias("x")).where("x <> ''")
    book.select(F.split("x", ":")[0].cast("int").alias("id"), F.split("x", ":")[1].cast("int").alias("length")).coalesce(1).write.parquet(f"{path}/codebook")


def read_store(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Decode a store: doc_id, start, n_tokens, ids_crc32 and, on request, the ids of every document."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    # Ids before each part: a running sum over one row per part.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    running = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", running.alias("part_start"))
    placed = blocks.join(F.broadcast(parts), "part").withColumn("first", F.col("part_start") + F.col("before"))

    def decode(batches):
        table = decode_table(lengths)
        for b in batches:
            sizes = b.column("n_ids").to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), DECODE_IDS, side="right")) + lo)
                part = b.slice(lo, hi - lo)
                lo = hi
                marks = [np.array(m, np.int64) for m in part.column("checkpoints").to_pylist()]
                flat = decode_blocks(part.column("bits").to_pylist(), marks, part.column("n_ids").to_pylist(), table).astype("<u4")
                n = np.array([x for row in part.column("n_tokens").to_pylist() for x in row], np.int64)
                keys = [x for row in part.column("doc_ids").to_pylist() for x in row]
                docs = np.array([len(row) for row in part.column("doc_ids").to_pylist()])
                ends = np.cumsum(n)
                at = ends - n
                block_at = np.repeat(np.cumsum([0, *part.column("n_ids").to_pylist()])[:-1], docs)
                start = np.repeat(np.array(part.column("first").to_pylist(), np.int64), docs) + at - block_at
                blob = memoryview(flat.tobytes())
                crc = [zlib.crc32(blob[4 * a : 4 * e]) for a, e in zip(at.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(keys, pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return placed.select("first", "n_ids", "doc_ids", "n_tokens", "checkpoints", "bits").mapInArrow(decode, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write a store (to a new scratch folder by default) and read it back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    write_store(docs, path, tokenizer_path, end_id)
    return read_store(spark, path)
