"""Byte-level BPE encoding and decoding (operator 13) with a segment tree over byte positions.

A rank file (one base64 token and its rank a line) and a splitting pattern make a tokenizer. Each match of the
pattern is encoded by itself: a match that is a token as a whole is that token; in any other the adjacent pair
of lowest rank, leftmost among equals, is merged until no pair is a token. The leaves of a segment
tree stand for the byte positions of the match, leaf i holds ``rank * leaves + i`` of the pair that begins with the live part at i,
and every inner node the minimum of its children, so the root names the leftmost pair of lowest rank. A merge changes three leaves
(the merged part, the part it swallowed, the live neighbour before it) in logarithmic time each. A match of n bytes costs
O(n log n), also one of megabytes. Short matches of one size class run side by side, one tree per row of a numpy array; few or
long ones run one after the other in a plain loop. The result is the same.

Spark partitions the documents; a worker remembers the ids of a bounded number of words (parts of a text between blanks, cut like the
other tokenizers' in ``tokens``), and works through its texts in slices of some MB, so its memory is bounded by the slice or the longest text.

NULL texts count as empty: no ids, and decoded the empty bytes. Repeated rows are encoded each. An empty
table gives no rows. Only doc_id and text are read, so further columns of any name do not matter. Ties between
equal ranks go to the leftmost pair. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import CACHE_WORDS, WordTokenizer, ragged, text_slices

SIDE_BY_SIDE = 12  # fewer matches of one size class run one after the other
TREE_LEAVES = 1 << 20  # leaves of all trees that run side by side
NONE = np.int64(1) << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _library_class(name: str) -> set[int]:
    """The characters that the tiktoken library takes for a class: it leaves out what its pattern does not match."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={**{bytes([b]): b for b in range(256)}, b"\n\n": 256}, special_tokens={})
    return set(map(ord, plain.decode(plain.encode_ordinary(every))))


def _ranges(points: set[int]) -> str:
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Splitter:
    """Matches of a pattern as the tiktoken library finds them. The two regular expression libraries know different
    editions of Unicode; texts with a character that they class differently go through a pattern with the classes spelled out."""

    CLASSES = (r"\p{L}", r"\p{N}")

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        exact, odd = pattern, set()
        for name in self.CLASSES:
            here, there = set(map(ord, regex.findall(name, every))), _library_class(name)
            if here != there:
                odd |= here ^ there
                less, more = _ranges(here - there), _ranges(there - here)
                exact = exact.replace(name, f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]")
        self.odd = regex.compile(f"[{_ranges(odd)}]") if odd else None
        self.high = re.compile(f"[\\U{min(odd):08x}-\\U0010ffff]") if odd else None  # a quick look before the exact one
        self.exact = regex.compile(exact, regex.V1) if odd else self.plain

    def __call__(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.high.search(text) and self.odd.search(text):
            return self.exact.findall(text)
        return self.plain.findall(text)


class PairTable:
    """Rank of the token that two tokens side by side make, or -1: open addressing over all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = {
            (ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.bits = max(4, (8 * len(self.pairs)).bit_length())
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            settled = self.keys[slot] == keys
            self.values[slot[settled]] = values[settled]
            keys, values, slot = keys[~settled], values[~settled], (slot[~settled] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << np.int64(32)) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], np.int64(-1))
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        slot = slot[seek]
        while len(seek):  # ends at the first empty slot
            slot = (slot + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot] == keys[seek]
            out[seek[hit]] = self.values[slot[hit]]
            stay = ~hit & (self.keys[slot] >= 0)
            seek, slot = seek[stay], slot[stay]
        return out


class ByteBPE(WordTokenizer):
    """Encodes and decodes with the ranks of a file. Texts are cut at blanks into words, which a worker remembers (see ``tokens``); the pattern
    must not match across white space but for one leading blank."""

    leading_blank = True

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.table = PairTable(self.ranks)
        self.split = Splitter(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self._reset(CACHE_WORDS)

    def merge_one(self, match: bytes) -> list[int]:
        """Ids of one match, one tree in a plain loop."""
        n = len(match)
        leaves = 1 << max(0, n - 1).bit_length()
        none, pairs = int(NONE), self.table.pairs
        ids = array("q", self.byte_ids[np.frombuffer(match, np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        start = np.full(2 * leaves, NONE, np.int64)
        if n > 1:
            first = np.frombuffer(ids, np.int64)
            rank = self.table.many(first[:-1], first[1:])
            start[leaves : leaves + n - 1] = np.where(rank >= 0, rank * leaves + np.arange(n - 1), NONE)
        width = leaves
        while width > 1:
            start[width // 2 : width] = np.minimum(start[width : 2 * width : 2], start[width + 1 : 2 * width : 2])
            width //= 2
        tree = array("q", start.tobytes())

        def put(i: int, value: int) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                other, i = tree[i ^ 1], i >> 1
                if other < value:
                    value = other
                if tree[i] == value:
                    return
                tree[i] = value

        while n > 1 and tree[1] < none:
            new, p = divmod(tree[1], leaves)
            gone = after[p]
            q, left = after[gone], before[p]
            ids[p], ids[gone], after[p] = new, -1, q
            put(gone, none)
            if q < n:
                before[q] = p
                rank = pairs.get(new << 32 | ids[q], -1)
                put(p, rank * leaves + p if rank >= 0 else none)
            else:
                put(p, none)
            if left >= 0:
                rank = pairs.get(ids[left] << 32 | new, -1)
                put(left, rank * leaves + left if rank >= 0 else none)
        return [x for x in ids if x >= 0]

    def merge_many(self, matches: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of matches of at most ``leaves`` bytes, and the number of ids of each: one tree a row, merged side by side."""
        rows, n = len(matches), np.fromiter(map(len, matches), np.int64, len(matches))
        place = np.arange(leaves)
        live = place < n[:, None]
        ids = np.zeros((rows, leaves + 1), np.int64)
        ids[:, :leaves][live] = self.byte_ids[np.frombuffer(b"".join(matches), np.uint8)]
        ids[:, :leaves][~live] = -1
        after = np.tile(np.arange(1, leaves + 2), (rows, 1))
        before = np.tile(np.arange(-1, leaves), (rows, 1))
        tree = np.full((2 * leaves, rows), NONE, np.int64)
        r, c = np.nonzero(place < n[:, None] - 1)
        rank = self.table.many(ids[r, c], ids[r, c + 1])
        good = rank >= 0
        tree[leaves + c[good], r[good]] = rank[good] * leaves + c[good]
        width = leaves
        while width > 1:
            tree[width // 2 : width] = np.minimum(tree[width : 2 * width : 2], tree[width + 1 : 2 * width : 2])
            width //= 2

        def put(at: np.ndarray, who: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[node, who] = value
            for _ in range(leaves.bit_length() - 1):
                value = np.minimum(value, tree[node ^ 1, who])
                node = node >> 1
                tree[node, who] = value

        def pair(a: np.ndarray, b: np.ndarray, at: np.ndarray, exists: np.ndarray) -> np.ndarray:
            rank = np.full(len(at), -1, np.int64)
            rank[exists] = self.table.many(a[exists], b[exists])
            return np.where(rank >= 0, rank * leaves + at, NONE)

        who = np.flatnonzero(tree[1] < NONE)
        while len(who):
            new, p = np.divmod(tree[1, who], leaves)
            gone = after[who, p]
            q, left = after[who, gone], before[who, p]
            ids[who, p], ids[who, gone], after[who, p] = new, -1, q
            before[who, q] = p  # column ``leaves`` takes the writes past the last part
            put(gone, who, np.full(len(who), NONE))
            put(p, who, pair(new, ids[who, q], p, q < n[who]))
            has = left >= 0
            put(left[has], who[has], pair(ids[who[has], left[has]], new[has], left[has], np.ones(int(has.sum()), bool)))
            who = who[tree[1, who] < NONE]
        kept = ids[:, :leaves] >= 0
        return ids[:, :leaves][kept], kept.sum(1)

    def merge(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of matches and the number of ids of each."""
        classes: dict[int, list[int]] = {}
        ids: list = [None] * len(matches)
        for i, raw in enumerate(matches):
            whole = self.ranks.get(raw)
            if whole is not None:
                ids[i] = (whole,)
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append(i)
        for leaves, found in classes.items():
            if len(found) < SIDE_BY_SIDE:
                for i in found:
                    ids[i] = self.merge_one(matches[i])
                continue
            step = max(1, TREE_LEAVES // leaves)
            for k in range(0, len(found), step):
                part = found[k : k + step]
                flat, n = self.merge_many([matches[i] for i in part], leaves)
                flat, ends = flat.tolist(), np.cumsum(n).tolist()
                lo = 0
                for i, hi in zip(part, ends, strict=True):
                    ids[i] = flat[lo:hi]
                    lo = hi
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def _learn(self, words: list[str]) -> None:
        found = [self.split(w) for w in words]
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(m, len(place)) for f in found for m in f), np.int64)
        flat, n = self.merge([m.encode("utf-8") for m in place])
        start = np.cumsum(n) - n
        ids = flat[ragged(start[at], n[at])].astype(np.uint32)
        before = np.concatenate([[0], np.cumsum(n[at])])
        ends = before[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        self._add(words, ids, np.diff(ends, prepend=0))

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        flat, at = self.encode(pa.array(texts, pa.string()))
        data, ends = flat.astype("<u4").tobytes(), (4 * at).tolist()
        return [data[a:b] for a, b in pairwise(ends)]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens of some ids; an id without a token raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a file, one per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path, pattern)
        for batch in text_slices(batches):
            flat, at = bpe.encode(batch.column("text"))
            data = pa.py_buffer(flat.astype("<u4").tobytes())
            ids = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int64).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), ids.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with their bytes in one more column, ``decoded``."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
