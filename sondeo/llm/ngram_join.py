"""N-gram Jaccard join (operator 2): universe-partition pigeonhole with cost-based allocation.

Set model: distinct 5-word shingles of the whole text (``shingles``). Two sets link when
100 * |intersection| >= 80 * |union|; then their symmetric difference is at most
H = floor((|x| + |y|) / 9).

Partition: sizes fall into bands (ratio 1.6). A band hashes the shingle universe into m segments, so many
that U / 4 + 2 of them are no deletion segments (U: the band's largest size, and H is at most U / 4 there); a set is indexed in
its own band and, when its partners can be smaller than the band, in the band below.

Allocation: every ``DELETION_EVERY``-th segment is indexed with its one-deletion neighbourhood
(v = 1: it matches if the segments differ by at most one shingle), the others whole (v = 0) or not
at all (v = -1). Costs are counts of keys over all texts: a key that occurs often is costly.
A deletion segment with a costly key is given up; with g deletion segments kept, the first
H - 2g + 1 whole segments in the common order (cost, key) are indexed. If no kept deletion segment
of either set matches, at most H - 2 max(g) differences are left for the whole segments, so
by the pigeonhole principle two of those first segments are equal: no link is lost, whatever the
cost table says. It has at most ``COSTLY_KEYS`` rows and only orders the work.

Candidates: sets that share a key meet in one bucket (costly keys are salted). Buckets of up to
``PAIRS_UP_TO`` sets give all their pairs; larger ones compare all members with one of them, and
after a first round of components only members of different components again, in blocks.
Pairs pass an exact bound (parity bitmaps cannot differ in more bits than the sets in
shingles) and then exact verification on the shingle sets.

Empty and NULL texts have no set and link with nothing; repeated rows and texts with equal sets
share a class and its component; NULL doc_ids never name a component unless all its ids
are NULL (then it is NULL). Sets are told apart by 64-bit hashes of shingles and of whole sets.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import components
from .shingles import U, mix, set_fingerprint, shingle_set

BAND_RATIO = 1.6
DELETION_EVERY = 32
COSTLY_KEYS = 1 << 16
LOCAL_KEYS = 2_000_000  # keys a task counts together before it reports the frequent ones
LOCAL_MIN = 4
SALT_ROWS = 5_000  # rows of a costly key that go to one bucket
PAIRS_UP_TO = 24
PAIRS_AT_ONCE = 400_000  # candidate pairs a task holds
BLOCK = 1_000  # sets of a block in the second round
BLOOM_BITS = (1 << 20, 1 << 26)  # least and most bits of the filter of wanted documents: 8 a document between

_STARTS = [1]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(max(_STARTS[-1] + 1, int(_STARTS[-1] * BAND_RATIO)))
_STARTS = np.array(_STARTS)


def targets(n: int) -> list[tuple[int, int]]:
    """(band, H) for each band in which a set of n shingles is indexed; H bounds its symmetric difference to any partner met there."""
    band = int(np.searchsorted(_STARTS, n, side="right")) - 1
    out = [(band, (n + 5 * n // 4) // 9)]
    while band and 5 * (_STARTS[band] - 1) >= 4 * n:
        out.append((band - 1, int(n + _STARTS[band] - 1) // 9))
        band -= 1
    return out


def segments(band: int) -> int:
    """Segments of a band: with every ``DELETION_EVERY``-th left out, more than the largest H of the band are left."""
    whole = int(_STARTS[band + 1] - 1) // 4 + 2
    return whole + -(-whole // (DELETION_EVERY - 1))


def segment_keys(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set in a band: whole segments, deletion segments whole, their one-deletions, and the deletion segment of each of those."""
    m = segments(band)
    h = mix(s + U(0x9E37))
    segment = ((h >> U(33)) % U(m)).astype(np.int64)
    total = np.zeros(m, U)
    np.add.at(total, segment, h)
    salt = U(0x632BE59BD9B4E019) * (np.arange(m, dtype=U) + U(1) + U(band << 40))
    special = segment % DELETION_EVERY == 0
    whole = total + salt
    near = mix(whole[::DELETION_EVERY] + U(77))
    deletions = mix(whole[segment[special]] - h[special] + U(77))
    plain = np.arange(m) % DELETION_EVERY != 0
    return mix(whole)[plain], near, deletions, segment[special] // DELETION_EVERY


def parity(s: np.ndarray) -> bytes:
    """Bitmap of at least 2n bits (a power of two): bit k tells if an odd number of shingles falls on it."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    at = (s >> U(7)) & U(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_difference(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the two sets."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    la, lb = 8 * len(a), 8 * len(b)
    while la > lb:
        la //= 2
        x = (x >> la) ^ (x & ((1 << la) - 1))
    while lb > la:
        lb //= 2
        y = (y >> lb) ^ (y & ((1 << lb) - 1))
    return (x ^ y).bit_count()


def _texts(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if "doc_id" in batch.schema.names else ((None, t) for t in part.column("text").to_pylist())


def describe(batches):
    """Kind 0: a document (doc_id, n, fingerprint, parity); kind 1: a key frequent in this task and its count."""

    def rows(kind, a, b, c, p):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.binary())],
            ["kind", "a", "b", "c", "p"],
        )

    def frequent():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = keys[n >= LOCAL_MIN].view(np.int64), n[n >= LOCAL_MIN]
        return rows(1, keys, n, n, [None] * len(n))

    docs, held, size, seen = [], [], 0, set()
    for key, text in _texts(batches):
        s = shingle_set(text)
        fp = set_fingerprint(s)
        docs.append((key, len(s), fp, parity(s)))
        if len(docs) == 2000:
            yield rows(0, *zip(*docs, strict=True))
            docs = []
        if len(s) and fp not in seen:
            seen.add(fp)
            for band, _ in targets(len(s)):
                whole, near, deletions, _ = segment_keys(s, band)
                held += [whole, near, np.unique(deletions)]
                size += len(whole) + len(near) + len(deletions)
            if size > LOCAL_KEYS:
                yield frequent()
                held, size, seen = [], 0, set()
    if docs:
        yield rows(0, *zip(*docs, strict=True))
    if held:
        yield frequent()


def index_rows(costly: np.ndarray, counts: np.ndarray):
    """Function from texts to index rows (key, salt, fp, nd) with nd = 2 n + (1 for a deletion)."""

    def cost(keys):
        if not len(costly) or not len(keys):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(costly, keys), len(costly) - 1)
        return np.where(costly[i] == keys, counts[i], 0)

    def run(batches):
        out, size, seen = [], 0, set()

        def flush():
            key, fp, nd = (np.concatenate(x) for x in zip(*out, strict=True))
            c = cost(key)
            # Salts count from 1; 0 marks a key whose sets all meet in one bucket.
            salt = np.where(c < SALT_ROWS, 0, 1 + (mix(fp.view(U)) % (c // SALT_ROWS + 1).astype(U)).astype(np.int64)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(fp), pa.array(nd)], ["key", "salt", "fp", "nd"])

        for _, text in _texts(batches):
            s = shingle_set(text)
            n, fp = len(s), set_fingerprint(s)
            if not n or fp in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(fp)
            for band, most in targets(n):
                whole, near, deletions, at = segment_keys(s, band)
                near_cost, deletion_cost = cost(near), cost(deletions)
                lost = near_cost > 0
                lost[at[deletion_cost > 0]] = True
                need = max(0, most - 2 * int((~lost).sum()) + 1)
                first = np.lexsort((whole, cost(whole)))[:need]
                cheap = deletions[deletion_cost == 0]
                keys = np.concatenate([whole[first], near[near_cost == 0], cheap])
                nd = np.full(len(keys), 2 * n, np.int64)
                nd[len(keys) - len(cheap) :] += 1
                out.append((keys, np.full(len(keys), fp, np.int64), nd))
                size += len(keys)
            if size > 200_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return run


def _sizes_fit(n, k):
    return (5 * n >= 4 * k) & (5 * k >= 4 * n)


def _distinct_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def bucket_pairs(batches):
    """Rows (kind 0: candidate pair a, b; kind 1: member a of a large bucket b, with nd). Pairs are made and
    handed on ``PAIRS_AT_ONCE`` at a time, however many the buckets give."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    key, salt, fp, nd = (t.column(c).to_numpy() for c in ("key", "salt", "fp", "nd"))
    order = np.lexsort((nd, fp, salt, key))
    key, salt, fp, nd = key[order], salt[order], fp[order], nd[order]
    # Tasks that met the same set have all indexed it: one row of each is enough.
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (fp[1:] != fp[:-1]) | (nd[1:] != nd[:-1])])
    key, salt, fp, nd = key[once], salt[once], fp[once], nd[once]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    # The rest of a salted key is in other buckets, so its members always go to the second round.
    large = (size > PAIRS_UP_TO) | (salt[start] > 0)

    def emit(kind, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "nd"])

    def pairs(i, j):
        ok = (fp[i] != fp[j]) & ((nd[i] & nd[j] & 1) == 0) & _sizes_fit(nd[i] >> 1, nd[j] >> 1)
        x, y = fp[i][ok], fp[j][ok]
        return np.minimum(x, y), np.maximum(x, y)

    def candidate_blocks():
        for c in np.unique(size[~large & (size > 1)]):
            first = start[~large & (size == c)]
            i, j = np.triu_indices(c, 1)
            step = PAIRS_AT_ONCE // len(i)
            for lo in range(0, len(first), step):
                f = first[lo : lo + step, None]
                yield pairs((f + i).ravel(), (f + j).ravel())
        for f, c in zip(start[large], size[large], strict=True):
            # The member in the middle of the sizes stands for the bucket.
            middle = f + np.argsort(nd[f : f + c], kind="stable")[c // 2]
            yield pairs(np.full(c, middle), np.arange(f, f + c))

    members = np.flatnonzero(np.repeat(large, size))
    for lo in range(0, len(members), PAIRS_AT_ONCE):
        r = members[lo : lo + PAIRS_AT_ONCE]
        yield emit(1, fp[r], key[r], nd[r])
    found, n = [], 0
    for block in candidate_blocks():
        found.append(block)
        n += len(block[0])
        if n >= PAIRS_AT_ONCE:
            found = [_distinct_pairs(found)]
            n = len(found[0][0])
            if 2 * n >= PAIRS_AT_ONCE:
                yield emit(0, *found[0], np.zeros(n, np.int64))
                found, n = [], 0
    if n:
        a, b = _distinct_pairs(found)
        yield emit(0, a, b, np.zeros(len(a), np.int64))


def block_pairs(batches):
    """Pairs of sets of different components in a block pair, thinned by the parity bound. Rows come sorted
    by (key, i, j), so only one block pair is held at a time."""

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "fp", "nd", "comp", "p")], strict=True)

    def emit():
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = set()
    for (_, i, j), group in groupby(rows(), key=lambda r: r[:3]):
        members = [r[3:] for r in group]
        left = [r for r in members if r[0] == i]
        right = [r for r in members if r[0] == j]
        for x in left:
            for y in right:
                if x[3] == y[3] or (i == j and x[1] >= y[1]) or x[2] & y[2] & 1:
                    continue
                n, k = x[2] >> 1, y[2] >> 1
                pair = (x[1], y[1]) if x[1] < y[1] else (y[1], x[1])
                if _sizes_fit(n, k) and pair not in found and parity_difference(x[4], y[4]) <= (n + k) // 9:
                    found.add(pair)
            if len(found) >= PAIRS_AT_ONCE // 4:
                yield emit()
                found.clear()
    if found:
        yield emit()


def _parity_filter(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb")]
        keep = [parity_difference(p, q) <= (n + k) // 9 for n, k, p, q in zip(*cols, strict=True)]
        yield batch.select(["a", "b", "lowa", "lowb"]).filter(pa.array(keep, pa.bool_()))


class Join:
    """State of one join over a table of documents."""

    def __init__(self, docs: DataFrame):
        self.source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.texts = self.source.select("text")
        stored = save(self.source.mapInArrow(describe, "kind int, a long, b long, c long, p binary"), "sets")
        self.rows = stored.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("fp"), "p")
        self.costs = stored.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("n"))
        # A class: all documents with the same set; low is its smallest doc_id, NULL if none of them has one.
        classes = self.rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("p").alias("p"))
        self.classes = save(classes, "classes")

    def candidates(self) -> DataFrame:
        top = self.costs.orderBy(F.col("n").desc(), "key").limit(COSTLY_KEYS).collect()
        keys = np.array([r["key"] for r in top], np.int64).view(U)
        counts = np.array([r["n"] for r in top], np.int64)
        order = np.argsort(keys)
        index = self.texts.mapInArrow(index_rows(keys[order], counts[order]), "key long, salt int, fp long, nd long")
        return save(index.repartition("key", "salt").mapInArrow(bucket_pairs, "kind int, a long, b long, nd long"), "candidates")

    def _with_class(self, pairs: DataFrame, cols: list[str]) -> DataFrame:
        for side in "ab":
            c = self.classes.select(F.col("fp").alias(side), *[F.col(x).alias(x + side) for x in cols])
            pairs = pairs.join(c, side)
        return pairs

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs (a, b) among distinct candidate pairs."""
        near = self._with_class(pairs, ["n", "p", "low"]).select("a", "b", "na", "nb", "pa", "pb", "lowa", "lowb")
        near = save(near.mapInArrow(_parity_filter, "a long, b long, lowa long, lowb long"), "near")
        # Only the sets of documents that stand for a wanted class are made again: a bitmap of bounded size over their ids tells most others.
        bits = min(max(BLOOM_BITS[0], 1 << (16 * near.count()).bit_length()), BLOOM_BITS[1])
        ends = near.select(F.explode(F.array("lowa", "lowb")).alias("low")).where("low IS NOT NULL").select(F.pmod("low", F.lit(bits)).alias("x"))
        words = ends.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("v"))
        bitmap = np.zeros(bits >> 6, np.int64)
        for r in words.collect():  # at most bits / 64 rows
            bitmap[r["w"]] = r["v"]
        wanted = self.source.mapInArrow(wanted_sets(bitmap), "fp long, s array<long>").groupBy("fp").agg(F.first("s").alias("s"))
        joined = near
        for side in "ab":
            joined = joined.join(wanted.select(F.col("fp").alias(side), F.col("s").alias("s" + side)), side)
        both = F.size(F.array_intersect("sa", "sb"))
        linked = joined.where(100 * both >= 80 * (F.size("sa") + F.size("sb") - both)).select("a", "b")
        return save(linked, "links")

    def second_round(self, found: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Pairs of members of large buckets that are in different components after the first round."""
        members = found.where("kind = 1").select(F.col("b").alias("key"), F.col("a").alias("fp"), "nd").distinct()
        members = members.join(self.classes.select("fp", "p"), "fp")
        if labels is not None:
            members = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp"))
        else:
            members = members.withColumn("comp", F.col("fp"))
        members = save(members.select("key", "fp", "nd", "comp", "p"), "members")
        open_keys = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).where("x < y")
        blocks = members.join(open_keys.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")), "key").withColumn("side", F.pmod(F.hash("fp"), F.col("nb")))
        # Every pair of blocks of a bucket meets in one task.
        other = F.explode(F.expr("sequence(0, nb - 1)"))
        meet = blocks.withColumn("o", other).select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "fp", "nd", "comp", "p")
        return meet.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(block_pairs, "a long, b long").distinct()


def wanted_sets(bitmap: np.ndarray):
    """Function from documents to the shingle sets (fp, s) of those whose id the bitmap may hold (and of those without an id), each set once in a task."""
    bits = 64 * len(bitmap)

    def run(batches):
        out, size, seen = [], 0, set()

        def flush():
            ends = np.cumsum([0, *[len(s) for _, s in out]]).astype(np.int32)
            values = pa.array(np.concatenate([s for _, s in out]).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["fp", "s"])

        for batch in batches:
            ids = batch.column("doc_id")
            x = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False) % bits
            held = (bitmap[x >> 6] >> (x & 63)) & 1 == 1
            held |= ids.is_null().to_numpy(zero_copy_only=False)
            for _, text in _texts([batch.filter(pa.array(held))]):
                s = shingle_set(text)
                fp = set_fingerprint(s)
                if len(s) and fp not in seen:
                    seen.add(fp)
                    out.append((fp, s))
                    size += len(s)
                if size > 500_000:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return run


def _classed_rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and the fingerprint fp of its set."""
    join = Join(docs)
    found = join.candidates()
    links = join.verify(found.where("kind = 0").select("a", "b").distinct())
    labels = components(links)
    if not found.where("kind = 1").isEmpty():
        more = join.verify(join.second_round(found, labels))
        labels = components(links.unionByName(more))
    final = join.classes.select("fp", F.col("low").alias("component"))
    if labels is not None:
        moved = labels.withColumnRenamed("node", "fp")
        low = final.join(moved, "fp").groupBy("root").agg(F.min("component").alias("smallest"))
        own = final.select(F.col("fp").alias("root"), F.col("component").alias("own"))
        names = low.join(own, "root").select("root", F.least("smallest", "own").alias("name"))
        rooted = final.join(moved, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        final = rooted.join(names, "root", "left").select("fp", F.coalesce("name", "component").alias("component"))
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "fp")
    full = rows.where("n_shingles > 0").join(final, "fp").select("doc_id", "n_shingles", F.col("component").alias("component_id"), "fp")
    return full.unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def link_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    return _classed_rows(docs).select("doc_id", "n_shingles", "component_id")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([set_fingerprint(shingle_set(t)) for t in texts.to_pylist()], pa.int64())


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The documents that stay: the smallest doc_id of each component (rows without a doc_id or set all stay). Of several
    texts under one doc_id only those go that are in a component with a smaller one."""
    rows = save(_classed_rows(docs.select("doc_id", "text")).where("doc_id IS NOT NULL"), "classed")
    smaller = F.col("doc_id") != F.col("component_id")
    ids = rows.groupBy("doc_id").agg(F.bool_or(smaller).alias("some"), F.bool_and(smaller).alias("every")).where("some")
    ids = save(ids.select(F.col("doc_id").alias("_id"), "every"), "gone")
    several = ids.where("NOT every").select("_id")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")  # own names cannot clash inside it
    wide = docs.select(row, docs["doc_id"].cast("long").alias("_id"))
    kept = wide.join(ids.select("_id"), "_id", "left_anti").select("_row")
    gone = rows.where(smaller).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).join(several, "_id").distinct()
    fingerprint = F.arrow_udf(_fingerprints, "long")(F.col("_row.text").cast("string"))
    split = wide.join(several, "_id").withColumn("_fp", fingerprint).join(gone, ["_id", "_fp"], "left_anti").select("_row")
    return kept.unionByName(split).select("_row.*")
