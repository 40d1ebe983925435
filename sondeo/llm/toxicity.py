"""Toxicity (operator 8): factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and the first letters (``STEMS``) of longer ones,
hashed into 2 ** ``HASH_BITS`` buckets. Learning uses at most ``SAMPLE`` labelled rows of each class
(those with the smallest hashes of doc_id, so the choice does not depend on the partitioning): Spark counts
in how many rows of each class a bucket occurs. Features are the at most ``TERMS`` buckets that depend on the class most
clearly by themselves (chi-square of at least ``MIN_CHI2``), and the buckets of the at most ``PAIRS`` pairs of the ``FREQUENT`` most frequent
ones whose joint occurrence depends on it (chi-square of at least ``MIN_PAIR_CHI2``, and ``PAIR_GAIN`` times that of either alone). A factorization
machine - bias, linear weights and rank-``RANK`` pairwise interactions - is fitted to the rows' features by
Adam, rows weighted back to the frequencies of the classes. Scoring reads whole texts.

NULL and empty texts get the score of a text without known terms; without any labelled row the
score is 0. Rows with a NULL label do not teach; a doc_id labelled twice counts as toxic if one
label says so. Repeated rows get equal scores; an empty table of documents gives no rows. labels, lang, source and doc_id never enter a score;
of the documents only doc_id and text are read, so further columns of any name do not matter. Ties between equally strong terms go to the
smaller bucket.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.partials import summed
from .common import save, small_batches

HASH_BITS = 20
STEMS = (4, 5)
SAMPLE = 25_000  # labelled rows of each class that teach
TERMS = 4096
MIN_ROWS = 3
MIN_CHI2 = 20.0
FREQUENT = 256  # most frequent buckets whose pairs are looked at
PAIRS = 256
MIN_PAIR_CHI2 = 40.0
PAIR_GAIN = 4.0  # times as much as either term of the pair alone
STEPS = 600  # least number of steps of a fit, so that small samples are not left half learnt
RANK = 8
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_BUCKETS: dict[str, tuple[int, ...]] = {}


def buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its stems."""
    known = _BUCKETS.get(word)
    if known is None:
        if len(_BUCKETS) > 100_000:
            _BUCKETS.clear()
        parts = [word, *["^" + word[:k] for k in STEMS if len(word) > k]]
        known = _BUCKETS[word] = tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for p in parts)
    return known


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text."""
    found = {b for w in set(_WORD.findall((text or "").lower())) for b in buckets(w)}
    return np.fromiter(found, np.int64, len(found))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` (text, toxic) rows of each class; the broadcast ids are bounded by that."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(cond).orderBy(*order).limit(SAMPLE) for cond in ("toxic > 0", "toxic <= 0")]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), "toxic")
    return docs.select(F.col("doc_id").alias("_d"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("_d") == F.col("_id")).select("text", "toxic")


def _count(batches):
    n = np.zeros((2, 1 << HASH_BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            k = int(y > 0)
            n[k][terms(text)] += 1
            rows[k] += 1
    used = np.flatnonzero(n.sum(axis=0))
    # Bucket -1 counts the rows.
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(n[0][used], rows[0])), pa.array(np.append(n[1][used], rows[1]))], ["bucket", "clean", "toxic"])


class FactorizationMachine:
    """Bias, linear weights and factors over a fixed list of buckets (ascending)."""

    def __init__(self, features: np.ndarray, bias: float):
        self.features = features
        rng = np.random.default_rng(7)
        self.bias = bias
        self.linear = np.zeros(len(features))
        self.factors = rng.normal(0, 0.05, (len(features), RANK))

    def rows_of(self, found: np.ndarray) -> np.ndarray:
        """Places of a text's buckets among the features."""
        if not len(self.features) or not len(found):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return at[self.features[at] == found]

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        sums, lin, squares = self._sums(rows)
        return self.bias + lin + 0.5 * ((sums**2).sum(axis=1) - squares)

    def _sums(self, rows: list[np.ndarray]):
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sums = np.zeros((len(rows), RANK))
        np.add.at(sums, owner, self.factors[flat])
        squares = np.bincount(owner, (self.factors[flat] ** 2).sum(axis=1), len(rows))
        return sums, np.bincount(owner, self.linear[flat], len(rows)), squares

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, batch: int = 512, rate: float = 0.02, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        params = [np.array([self.bias]), self.linear, self.factors]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(epochs, -(-STEPS * batch // max(len(rows), batch)))):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                part = [rows[i] for i in pick]
                self.bias = float(params[0][0])
                sums, lin, squares = self._sums(part)
                raw = self.bias + lin + 0.5 * ((sums**2).sum(axis=1) - squares)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * weight[pick] / weight[pick].sum()
                owner = np.repeat(np.arange(len(part)), [len(r) for r in part])
                flat = np.concatenate(part) if part else np.zeros(0, np.int64)
                grads = [np.array([g.sum()]), decay * self.linear, decay * self.factors]
                np.add.at(grads[1], flat, g[owner])
                np.add.at(grads[2], flat, g[owner, None] * (sums[owner] - self.factors[flat]))
                step += 1
                for p, d, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.bias = float(params[0][0])


def paired_terms(taught: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Places of the terms of pairs of frequent terms whose joint occurrence depends on the class, also where neither term does alone.
    Tasks count pairs by class, Spark sums the counts."""
    k = len(frequent)
    if not k:
        return np.zeros(0, np.int64)

    def add(batch, total):
        both = total[2:].reshape(2, k, k)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        lists = batch.column("rows")
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(frequent, flat), k - 1)
        hit = frequent[at] == flat
        x = np.zeros((batch.num_rows, k), np.float32)
        x[owner[hit], at[hit]] = 1.0
        for c in (0, 1):
            z = x[toxic == bool(c)]
            total[c] += len(z)
            both[c] += z.T @ z

    sums = summed(taught, 2 + 2 * k * k, add)
    clean, bad, both = sums[0], sums[1], sums[2:].reshape(2, k, k)
    n, total = clean + bad, both.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        chi2 = n * (both[1] * clean - both[0] * bad) ** 2 / (total * (n - total) * max(clean, 1.0) * max(bad, 1.0))
    chi2 = np.where((total >= MIN_ROWS) & (total < n), chi2, 0.0)
    alone = np.diagonal(chi2)
    i, j = np.triu_indices(k, 1)
    strong = np.flatnonzero((chi2[i, j] >= MIN_PAIR_CHI2) & (chi2[i, j] >= PAIR_GAIN * np.maximum(alone[i], alone[j])))
    best = strong[np.lexsort((strong, -chi2[i, j][strong]))][:PAIRS]
    return np.unique(frequent[np.concatenate([i[best], j[best]])])


def learn(docs: DataFrame, labels: DataFrame) -> FactorizationMachine | None:
    """The fitted machine, None without labelled rows."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels)
    counts = sample.mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = {r["bucket"]: r for r in counts.where("bucket = -1").collect()}
    clean, toxic = (int(total[-1]["clean"] or 0), int(total[-1]["toxic"] or 0)) if total else (0, 0)
    if clean + toxic == 0:
        return None
    n, a, b = float(clean + toxic), F.col("toxic"), F.col("clean")
    chi2 = F.lit(n) * F.pow(a * clean - b * toxic, F.lit(2)) / ((a + b) * (n - a - b) * max(clean, 1) * max(toxic, 1))
    strong = counts.where((F.col("bucket") >= 0) & (a + b >= MIN_ROWS) & (a + b < n)).withColumn("x", chi2.cast("double")).where(F.col("x") >= MIN_CHI2)
    chosen = strong.orderBy(F.col("x").desc(), "bucket").limit(TERMS).collect()
    common = counts.where((F.col("bucket") >= 0) & (a + b >= MIN_ROWS) & (a + b < n)).orderBy((a + b).desc(), "bucket").limit(FREQUENT).collect()
    single = np.array([r["bucket"] for r in chosen], np.int64)
    frequent = np.array([r["bucket"] for r in common], np.int64)
    wide = FactorizationMachine(np.union1d(single, frequent), 0.0)

    def features(batches):
        for batch in batches:
            rows = [wide.rows_of(terms(t)).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "rows"])

    table = save(sample.mapInArrow(features, "toxic int, rows array<int>"), "taught")
    kept = np.union1d(np.searchsorted(wide.features, single), paired_terms(table, np.searchsorted(wide.features, np.sort(frequent))))
    place = np.full(len(wide.features) + 1, -1, np.int32)
    place[kept] = np.arange(len(kept))
    model = FactorizationMachine(wide.features[kept], 0.0)

    def narrow(batches):
        for batch in batches:
            rows = [np.sort(r[r >= 0]) for r in (place[x] for x in (np.array(x, np.int32) for x in batch.column("rows").to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "rows"])

    found = table.mapInArrow(narrow, "toxic int, rows array<int>").collect()  # at most 2 SAMPLE rows of known terms
    found.sort(key=lambda r: (r["toxic"], r["rows"]))
    y = np.array([float(r["toxic"] > 0) for r in found])
    taught = [np.array(r["rows"], np.int64) for r in found]
    shares = labels.where("toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).agg(F.avg((F.col("toxic") > 0).cast("double"))).head()[0] or 0.0
    share = min(max(shares, 1e-4), 1 - 1e-4)
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.bias = float(np.log(share / (1 - share)))
    model.fit(taught, y, weight)
    return model


def score_documents(docs: DataFrame, model: FactorizationMachine | None) -> DataFrame:
    """All columns of the documents, toxic_score and toxic_predicted."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("_scored").to_pylist()
            score = model.score([model.rows_of(terms(t)) for t in texts]) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "toxic_score", "toxic_predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_scored", F.col("text").cast("string")).mapInArrow(run, f"{schema}, toxic_score double, toxic_predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # own names cannot clash inside it
    return score_documents(docs.select(row, "text"), learn(docs, labels)).where("toxic_predicted = 0").select("row.*")
