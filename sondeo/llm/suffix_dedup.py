"""Suffix-array dedup (operator 6): bytes covered by a string of ``SPAN`` bytes that also starts elsewhere.

Finding where. Every window of SPAN bytes owns an anchor, the gram of ``GRAM`` bytes with the smallest
hash in it; neighbouring windows with one anchor form a run, and its bytes a segment (less than two
windows long). Equal windows have equal grams at equal distances from their starts, so only runs of one gram
can hold equal windows, and one shuffle on the gram brings them together. Runs whose whole segments
are equal are decided by counting; runs with a common gram but different segments are decided by
comparing the segments.

Comparing. A task takes the different segments of its grams and builds their common suffix order column by column:
round j puts the j-th symbol from the end of every segment before its suffix of the round before,
at the place that counting the symbol in the collection's Burrows-Wheeler transform gives, and
writes the transform anew in one sequential pass. In the finished order equal windows are neighbours; their common
prefixes are compared word by word up to SPAN. Doing the rounds over whole documents would rewrite
the transform once per byte of the longest document; over segments there are at most 2 SPAN rounds.
Segments are cut in two parts by the side on which their windows reach far beyond the gram. All windows of a
part hold the same CORE bytes (gram and that side), by whose hash parts meet; a number in place of them is
ordered with the bytes around, so equal windows are those with equal numbers and surroundings.

NULL counts as the empty text; texts shorter than SPAN lose nothing. Copies of one text are found
by a digest and lose everything (if SPAN bytes long); repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .shingles import U, mix

SPAN = 200
GRAM = 24
SIDE = (SPAN - GRAM) // 2  # any window of an anchor reaches so many bytes beyond the gram on one side
CORE = GRAM + SIDE  # bytes that all windows of a group of parts have in common
CHUNK = 4_000  # segments ordered together (more, if one gram has more)
BLOOM_BITS = 1 << 24
_POS = 26
_R = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(size, U(r))
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first start, last start) of each run of windows with one anchor."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, np.int64)
        return none.view(U), none, none, none
    up, down = _powers(n)
    sums = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * up, dtype=U)])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    mask = U((1 << _POS) - 1)
    packed = (h & ~mask) | np.arange(len(h), dtype=U)
    w = SPAN - GRAM + 1
    pad = np.full(-len(packed) % w + w, ~U(0))
    rows = np.concatenate([packed, pad]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - SPAN + 1
    anchor = (np.minimum(after[:windows], before[w - 1 : w - 1 + windows]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[first]], anchor[first], first, np.append(first[1:], windows) - 1


def _each_text(batches):
    """(text key, bytes) of the texts of a task that are long enough, equal texts once."""
    seen = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            for tk, text in zip(part.column("tk").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= SPAN and tk not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(tk)
                    yield tk, raw


def _list_runs(batches):
    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["g", "sh", "tk", "lo", "hi"])

    out, size = [], 0
    for tk, raw in _each_text(batches):
        g, a, lo, hi = runs(np.frombuffer(raw, np.uint8))
        digest = xxhash.xxh3_64_intdigest
        sh = np.array([digest(raw[x : y + SPAN], z - x) for x, y, z in zip(lo.tolist(), hi.tolist(), a.tolist(), strict=True)], U)
        out.append((g.view(np.int64), sh.view(np.int64), np.full(len(g), tk, np.int64), lo.astype(np.int32), hi.astype(np.int32)))
        size += len(g)
        if size > 100_000:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def _wanted_segments(bloom: np.ndarray):
    """Function from texts to the different segments (g, sh, side key, shift, windows, segment) of grams that may be wanted,
    each cut in two by the side on which its windows meet others."""

    def run(batches):
        def flush():
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "sh", "key", "shift", "windows", "before", "after"])

        out, seen = [], set()
        for _, raw in _each_text(batches):
            g, a, lo, hi = runs(np.frombuffer(raw, np.uint8))
            x = g & U(BLOOM_BITS - 1)
            hit = (bloom[(x >> U(6)).astype(np.int64)] >> (x & U(63))) & U(1)
            for i in np.flatnonzero(hit):
                first, last, anchor = int(lo[i]), int(hi[i]), int(a[i])
                segment = raw[first : last + SPAN]
                sh = xxhash.xxh3_64_intdigest(segment, anchor - first)
                if (int(g[i]), sh) in seen:
                    continue
                seen.add((int(g[i]), sh))
                signed = int(np.array([sh], U).view(np.int64)[0])
                gram = int(g[i : i + 1].view(np.int64)[0])
                # Windows that reach SIDE bytes beyond the gram meet by those bytes, the others by the SIDE bytes before it.
                # All windows of a part hold the bytes they meet by, so only the bytes around them travel and are ordered.
                cut = max(first, anchor - SIDE)
                if cut <= last:
                    key = xxhash.xxh64_intdigest(raw[anchor : anchor + CORE]) >> 1
                    out.append((gram, signed, key, cut - first, last - cut + 1, raw[cut:anchor], raw[anchor + CORE : last + SPAN]))
                if first < cut:
                    key = xxhash.xxh64_intdigest(raw[anchor - SIDE : anchor + GRAM], 1) >> 1
                    end = min(last, cut - 1)
                    out.append((gram, signed, key, 0, end - first + 1, raw[first : anchor - SIDE], raw[anchor + GRAM : end + SPAN]))
            if len(out) > 5_000:
                yield flush()
                out = []
                if len(seen) > 500_000:
                    seen.clear()
        if out:
            yield flush()

    return run


def suffix_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of all suffixes of a collection in ascending order, built column by column."""
    m = len(segments)
    lengths = np.array([len(s) for s in segments], np.int64)
    flat = np.frombuffer(b"".join(segments), np.uint8)
    alphabet, codes = np.unique(flat, return_inverse=True)
    codes = (codes + 1).astype(np.uint8 if len(alphabet) < 255 else np.uint16)  # 0 marks a segment's begin
    base = np.cumsum(lengths) - lengths
    sigma, block = len(alphabet) + 1, 256
    left = lengths.copy()
    bwt = np.where(left > 0, codes[np.minimum(base + left - 1, len(codes) - 1)], 0).astype(codes.dtype)
    ids = (base + lengths + np.arange(m)).astype(np.int64 if len(flat) + m >= 1 << 31 else np.int32)  # of suffixes: their place in the joined text, one end mark for each segment
    first_id = base + np.arange(m)
    block_key = np.zeros(0, np.int32)
    place = np.arange(m, dtype=np.int64)  # of the suffix put in last
    active = np.arange(m)
    while True:
        active = active[left[active] > 0]
        if not len(active):
            who = np.searchsorted(first_id, ids, side="right") - 1
            return who, ids - first_id[who]
        left[active] -= 1
        c = codes[base[active] + left[active]].astype(np.int64)
        # Count each symbol before each place: whole blocks from a table, the rest of the block directly.
        n = len(bwt)
        padded = np.zeros(-(-n // block) * block, bwt.dtype)
        padded[:n] = bwt
        rows = padded.reshape(-1, block)
        if len(block_key) < len(padded):
            block_key = np.repeat(np.arange(2 * len(rows), dtype=np.int32) * sigma, block)
        table = np.bincount(block_key[: len(padded)] + padded, minlength=len(rows) * sigma).reshape(len(rows), sigma)
        table[-1, 0] -= len(padded) - n
        upto = np.concatenate([np.zeros((1, sigma), np.int64), np.cumsum(table, axis=0)])
        p = place[active]
        k, rest = p // block, p % block
        inside = ((rows[np.minimum(k, len(rows) - 1)] == c[:, None]) & (np.arange(block) < rest[:, None])).sum(axis=1)
        smaller = m + np.cumsum(upto[-1]) - upto[-1] - upto[-1][0]
        new = smaller[c] + upto[k, c] + inside
        place[active] = new
        before = np.where(left[active] > 0, codes[np.maximum(base[active] + left[active] - 1, 0)], 0)
        mask = np.ones(n + len(active), bool)
        mask[new] = False
        merged = np.empty(n + len(active), bwt.dtype), np.empty(n + len(active), ids.dtype)
        for out, old, added in zip(merged, (bwt, ids), (before, first_id[active] + left[active]), strict=True):
            out[mask] = old
            out[new] = added
        bwt, ids = merged


def tagged(before: bytes, group: int, after: bytes) -> bytes:
    """A part with the bytes its group shares replaced by the group's number. The mark 0xFF occurs in no
    UTF-8 text, so windows that hold it are equal only within a group and at equal distances from it."""
    return before + bytes((0xFF, group >> 14, group >> 7 & 127, group & 127)) + after


def repeated_windows(segments: list[bytes], windows: list[int], span: int) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` starts have a window of ``span`` bytes (at least 8) that another start
    of the collection has too."""
    who, at = suffix_order(segments)
    count = np.array(windows)
    live = at < count[who]
    who, at = who[live], at[live].astype(np.int64)
    lengths = np.array([len(s) for s in segments], np.int64)
    flat = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    start = (np.cumsum(lengths) - lengths)[who] + at
    same = np.ones(max(len(start) - 1, 0), bool)
    eight = np.lib.stride_tricks.sliding_window_view(flat, 8)
    for lo in [*range(0, span - 8, 8), span - 8]:
        i = np.flatnonzero(same)
        same[i] = (eight[start[i] + lo] == eight[start[i + 1] + lo]).all(axis=1)
    hit = np.zeros(len(start), bool)
    hit[:-1] |= same
    hit[1:] |= same
    out = [np.zeros(n, bool) for n in windows]
    for s, a in zip(who[hit].tolist(), at[hit].tolist(), strict=True):
        out[s][a] = True
    return out


def _compare(batches):
    """Ranges of repeated starts (g, sh, first, last; counted from the segment's begin) of different segments."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).sort_by([("key", "ascending"), ("g", "ascending"), ("sh", "ascending")])
    key, names = t.column("key").to_numpy(), np.stack([t.column(c).to_numpy() for c in ("g", "sh")], axis=1)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (names[1:, 0] != names[:-1, 0])])), len(key))
    groups, size, found = [], 0, []

    def add(lo, x, hit):
        shift = t.column("shift")[lo].as_py()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        found.extend((*x, int(a) + shift, int(b) - 1 + shift) for a, b in edge.reshape(-1, 2))

    def work():
        # Equal parts of different segments need no order: all their windows repeat.
        members = [m for g in groups for m in g.values()]
        texts = [tagged(before, i, after) for i, g in enumerate(groups) for before, after in g]
        for (w, owners), hit in zip(members, repeated_windows(texts, [w for w, _ in members], SPAN - CORE + 4), strict=True):
            for lo, x in owners:
                add(lo, x, np.ones(w, bool) if len(owners) > 1 else hit)

    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo == 1:
            continue
        fresh = np.concatenate([[True], (names[lo + 1 : hi] != names[lo : hi - 1]).any(axis=1)])
        group: dict = {}
        for i in (lo + np.flatnonzero(fresh)).tolist():
            part = t.column("before")[i].as_py(), t.column("after")[i].as_py()
            w, owners = group.setdefault(part, (t.column("windows")[i].as_py(), []))
            owners.append((i, tuple(names[i].tolist())))
        if len(group) == 1:
            ((w, owners),) = group.values()
            if len(owners) > 1:
                for i, x in owners:
                    add(i, x, np.ones(w, bool))
        else:
            groups.append(group)
            size += len(group)
        if size >= CHUNK:
            work()
            groups, size = [], 0
    if groups:
        work()
    if found:
        cols = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["g", "sh", "x", "y"])


def repeated_starts(texts: DataFrame) -> DataFrame:
    """Ranges (tk, lo, hi) of window starts whose window also starts elsewhere; ``texts`` has tk and text."""
    listed = save(texts.mapInArrow(_list_runs, "g long, sh long, tk long, lo int, hi int"), "runs")
    # A text read by several tasks lists its runs once each: pairs of (text, place) count.
    grams = listed.groupBy("g").agg(F.min("sh").alias("s0"), F.max("sh").alias("s1"), F.min("tk").alias("t0"), F.max("tk").alias("t1"), F.min("lo").alias("l0"), F.max("lo").alias("l1"))
    # Saved before they are joined: Spark splits a hot gram's rows (skew join) only if both sides come straight from a shuffle.
    common = save(grams.where("s0 <> s1 OR t0 <> t1 OR l0 <> l1").select("g", (F.col("s0") != F.col("s1")).alias("mixed")), "common")
    shared = save(listed.join(common, "g"), "shared")
    mixed = shared.where("mixed")
    places = mixed.groupBy("g", "sh").agg(F.min("tk").alias("tk"), F.max("tk").alias("t1"), F.min("lo").alias("lo"), F.max("lo").alias("l1"))
    places = save(places.select("g", "sh", "tk", "lo", F.expr("tk <> t1 OR lo <> l1").alias("repeats")), "places")
    repeated = places.where("repeats").select("g", "sh")
    whole = shared.where("NOT mixed").select("tk", "lo", "hi").unionByName(mixed.join(repeated, ["g", "sh"]).select("tk", "lo", "hi"))
    x = F.pmod(F.col("g"), F.lit(BLOOM_BITS))
    words = mixed.select(x.alias("x")).groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("v"))
    bloom = np.zeros(BLOOM_BITS >> 6, np.int64)
    for r in words.collect():  # at most BLOOM_BITS / 64 rows
        bloom[r["w"]] = r["v"]
    segments = texts.mapInArrow(_wanted_segments(bloom.view(U)), "g long, sh long, key long, shift int, windows int, before binary, after binary")
    partial = save(segments.repartition("key").mapInArrow(_compare, "g long, sh long, x int, y int").distinct(), "partial")
    # A segment with several places counts as a whole already; the others have one row each, so no key is hot.
    some = places.where("NOT repeats").join(partial, ["g", "sh"]).select("tk", (F.col("lo") + F.col("x")).alias("lo"), (F.col("lo") + F.col("y")).alias("hi"))
    return whole.unionByName(some)


def covered_spans(starts: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows of some ranges of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + SPAN)
        else:
            out.append([lo, hi + SPAN])
    return [(a, min(b, n)) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document with its repeated bytes removed: doc_id, n_bytes, spans removed and the kept bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))
    copies = rows.groupBy("tk").agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("text")).alias("n"))
    copied = copies.where((F.col("c") > 1) & (F.col("n") >= SPAN)).select("tk", F.lit(0).alias("lo"), (F.col("n") - SPAN).cast("int").alias("hi"))
    ranges = repeated_starts(rows.select("tk", "text")).unionByName(copied)
    by_text = save(ranges.distinct().groupBy("tk").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "by_text")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, t, starts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                spans = covered_spans([(s["lo"], s["hi"]) for s in starts or []], len(raw))
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                out.append((doc, len(raw), [{"begin": a, "end": b} for a, b in spans], b"".join([*kept, raw[last:]])))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(by_text, "tk", "left").select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary")


def digest_rows(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
