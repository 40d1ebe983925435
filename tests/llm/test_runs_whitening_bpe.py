"""Periodic runs, whitening and byte-level BPE against brute-force versions and the tiktoken library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sondeo.llm import byte_bpe, periodic_runs, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, runs int, n_tokens string, _h int, _words int, collapsed long, whitened int, vector string"
EXTRA = ("x", 1, "y", 2, 3, 4, 5, "z")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def awkward():
    rng = random.Random(7)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "  a b  c\ta b c\na b c a b c ", "é à é à é à é à é\xa0à"]
    texts += [" ".join(rng.choice("abc"[:k]) for _ in range(rng.randrange(80))) for k in (1, 2, 3) for _ in range(30)]
    texts += [" ".join(f"w{i % 700}" for i in range(4000)), "x" * 3000, "ab" * 500, "İ> def 'll 1234 !!! \n\n  tail  ", "ࢗᲉ \U0001e5d0x ꟎1"]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "b b b b b b b", *EXTRA), (None, None, *[None] * 8)]


# ---- periodic runs ----------------------------------------------------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(6, 4 * q) and not any(s[:-d] == s[d:] for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not w or h is None or h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def brute_digest(doc_id, text):
    w = planted_words(doc_id, text)
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *tail, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(3)
    docs = []
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 5]), rng.randrange(60)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, a = rng.randrange(1, max(2, n // 4)), rng.randrange(n)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        docs.append(w)
    at = np.cumsum([0, *map(len, docs)])
    rows = periodic_runs.runs_of(np.array([x for d in docs for x in d]), at)
    want = [(t, *r) for t, d in enumerate(docs) for r in brute_runs(d)]
    assert list(map(tuple, rows.tolist())) == want
    assert len(want) > 500


def test_runs_of_whole_tables(spark):
    rows = awkward()
    got = periodic_runs.digest_rows(periodic_runs.find_runs(periodic_runs.with_planted_period(spark.createDataFrame(rows, DOCS))))
    assert Counter(map(tuple, got.collect())) == Counter(brute_digest(r[0], r[1]) for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_periodic_runs"](spark, SF)
    assert dict(got.dtypes)["n_runs"] == "bigint" and dict(got.dtypes)["exponent_milli"] == "bigint"
    # The brute-force version takes n^2 / 4 steps a text, so it looks at texts of up to 600 words.
    want = {r[0]: brute_digest(*r) for r in docs if len((r[1] or "").split()) <= 600}
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) == len(docs) and {d: found[d] for d in want} == want and len(want) > 120


def test_runs_spans_and_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert periodic_runs.digest_rows(periodic_runs.find_runs(periodic_runs.with_planted_period(none))).count() == 0
    one = spark.createDataFrame([(1, "x y a b a b a b a b a z z z z z z")], "doc_id long, text string")
    r = periodic_runs.find_runs(one).collect()[0]
    assert [tuple(x) for x in r["runs"]] == [(2, 9, 2), (11, 6, 1)]
    assert r["collapsed"] == "x y a b z" and r["n_words"] == 17


def test_run_longer_than_any_other_level():
    assert periodic_runs.runs_of(np.arange(300_000) % 70_001, np.array([0, 300_000])).tolist() == [[0, 0, 300_000, 70_001]]


# ---- whitening ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["random", "equal", "rank", "two", "close", "identity"])
def test_components_equal_a_dense_solver(case):
    rng = np.random.default_rng(2)
    d = 48
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {
        "random": rng.gamma(2, size=d),
        "equal": np.repeat([5.0, 3, 1, 0.5], 12),
        "rank": np.where(np.arange(d) < 9, 2.0 + np.arange(d), 0),
        "two": np.where(np.arange(d) < 24, 1.0, 0.25),
        "close": np.where(np.arange(d) < 20, 1 + 1e-13 * np.arange(d), np.linspace(0.1, 0.9, d)),
        "identity": np.ones(d),
    }[case]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, basis = whitening.leading_components(a, 32)
    assert np.allclose(got, np.linalg.eigvalsh(a)[::-1][:32], atol=1e-13 * values.max())
    assert np.allclose(basis.T @ basis, np.eye(32), atol=1e-13) and np.allclose(a @ basis, basis * got, atol=1e-12 * values.max())
    for s in rng.uniform(-0.1, 1.1 * values.max(), 20):
        assert whitening.count_below(a, s) == (np.linalg.eigvalsh(a) < s).sum()


def check_whitening(rows, got, dims, k=32):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    dev = [int(v) for v in ((n * x - s) ** 2).sum(1)]
    assert Counter((r["vec_id"], r["n"], r["deviation"]) for r in got if r["component"] == 1) == Counter((i, n, v) for (i, _), v in zip(kept, dev, strict=True))
    centred = ((n * x - s) / n).astype(float)
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    m = len({r["component"] for r in got})
    assert len(got) == n * m
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    w = np.array([[by[i, v][c] for c in range(1, m + 1)] for (i, _), v in zip(kept, dev, strict=True)])
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(m)).max() < 1e-8
    basis = np.linalg.lstsq(centred, w * np.sqrt(values[:m]), rcond=None)[0]
    assert np.abs(cov @ basis - basis * values[:m]).max() < 1e-9 * values[0]
    return m


def test_whitening_of_a_table(spark):
    got = queries.QUERIES["op12_whitening"](spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert check_whitening(rows, got.collect(), 64) == 32


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf, *[0.0] * 5]), (104, []), (105, [1.0] * 4), rows[0], rows[0], (None, rows[1][1])]
    schema = "vec_id long, embedding array<double>, n string, deviation string, vector string, cell int"
    table = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], schema)
    assert check_whitening(rows, whitening.by_component(whitening.whiten(table)).collect(), 6) == 6
    flat = [(i, [*v[:4], 1.0, v[0]] if v and len(v) == 6 and v[0] is not None else v) for i, v in rows[:60]]
    less = whitening.by_component(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>"))).collect()
    assert check_whitening(flat, less, 6) == 4  # a constant and a copied dimension have no variance of their own
    for odd in ([], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [math.nan])]):
        assert whitening.whiten(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).count() == 0


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=3) * 1e9).tolist()) for i in range(40)]
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((40 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d if d < 2**63 else None) for i, d in enumerate(dev)}


# ---- byte-level BPE -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return byte_bpe.load(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(bpe):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def le(ids):
    return np.array(ids, "<u4").tobytes()


def random_texts():
    rng = random.Random(11)
    out = ["x" * 700, "ab" * 5000, "\n" * 3000, " " * 2000 + "a", "İ> def", "", " ", "  a", "a  ", "!?" * 333, "<|endoftext|>"]
    for _ in range(3000):
        top = rng.choice([128, 0x300, 0x3000, 0x11000, 0x110000])
        out.append("".join(chr(c) for c in (rng.randrange(top) for _ in range(rng.randrange(60))) if not 0xD800 <= c < 0xE000))
    return out


def test_bpe_equals_the_library(bpe, tik):
    texts = random_texts()
    got = bpe.encode_texts(texts)
    assert got == [le(tik.encode_ordinary(t)) for t in texts]
    assert [bpe.decode(g) for g in got] == [t.encode() for t in texts]


def test_one_tree_and_trees_side_by_side_agree(bpe):
    matches = sorted({m.encode() for t in random_texts() for m in bpe.split(t)} - set(bpe.ranks))
    for leaves in {1 << (len(m) - 1).bit_length() for m in matches}:
        part = [m for m in matches if 1 << (len(m) - 1).bit_length() == leaves]
        flat, n = bpe.merge_many(part, leaves)
        assert np.split(flat, np.cumsum(n)[:-1])[0].tolist() == bpe.merge_one(part[0])
        assert flat.tolist() == [x for m in part for x in bpe.merge_one(m)]


def test_split_classes_follow_the_library(bpe, tik):
    """Characters that the two libraries class differently, and others, after a letter, a digit and a sign."""
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    odd = [c for c in every if bpe.split.odd and bpe.split.odd.match(c)]
    chosen = random.Random(5).sample(every, 6000) + odd[::5]
    for before in "a1!":
        text = [f"{before}{c}" for c in chosen]
        assert bpe.encode_texts(text) == [le(x) for x in tik.encode_ordinary_batch(text, num_threads=4)]


def test_bpe_of_tables(spark, tik):
    rows = awkward()
    import public_tokenizers

    path, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, DOCS), path, pattern), path, pattern).collect()
    want = [(d, le(tik.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows]
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == Counter(want)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in out)
    none = byte_bpe.encode(spark.createDataFrame([], DOCS), path, pattern)
    assert byte_bpe.decode(none, path, pattern).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d, len(i), sha(le(i)), sha((t or "").encode())) for d, t in docs for i in [tik.encode_ordinary(t or "")])
    assert Counter(map(tuple, queries.QUERIES["op13_byte_bpe"](spark, SF).collect())) == want


def test_unknown_id_is_an_error(bpe):
    with pytest.raises(KeyError):
        bpe.decode(le([50256]))


def test_words_split_like_the_contract():
    texts = pa.array([None, "", " a\x0bb ", "a\xa0b c", "\x1c \x85"])
    words, at = periodic_runs.words_of(texts)
    assert words.to_pylist() == ["a", "b", "a\xa0b c", "\x1c", "\x85"] and at.tolist() == [0, 0, 0, 2, 3, 5]
