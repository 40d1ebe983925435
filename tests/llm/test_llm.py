"""Training-data operators against brute-force versions, on small and on awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.llm import ann, exact_dedup, html_text, license_scan, mixing, ngram_join, packing, queries, suffix_dedup, token_store, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _row int, mix_slot string, toxic_score string, key int"
SF = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


def rows():
    base = prose(1, 300)
    near = base.split()
    near[150] = "CHANGED"
    texts = [base, " ".join(near), base.replace(" ", "\n"), None, "", " \t\n", "a b", "A b", "ünïcode  x y", prose(2, 80) + " " + base[:900], prose(3, 6000), "x" * 700, base, prose(4, 60), "Released under the MIT License.\nmore"]
    out = [(i, t, "en", f"src{i % 3}" if i % 5 else None, 1, "d", i, "m", "t", i) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing_orders_all_rows(docs, none):
    got = mixing.mix_sources(docs, {"src0": 3, "src1": 2}, 1, block_rows=2).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows())))
    assert Counter(r["text"] for r in got) == Counter(r[1] for r in rows())
    assert set(docs.columns) <= set(got[0].asDict())
    assert mixing.mix_sources(none, {"src0": 1}).count() == 0


def test_edf_stays_within_a_block():
    weights = {"a": 50, "b": 3, "c": 17, "d": 30}
    slots = mixing.edf_period(weights)
    for s, a in weights.items():
        done = 0
        for t in range(100):
            done += t in slots[s]
            assert abs(done - (t + 1) * a / 100) < 1


def brute_components(pairs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(pairs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (d, _), g in zip(pairs, group, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return Counter((d, len(s), low.get(g) if s else d) for (d, _), s, g in zip(pairs, sets, group, strict=True))


def test_ngram_join(docs, none, spark):
    want = brute_components([r[:2] for r in rows()])
    assert Counter(tuple(r) for r in ngram_join.link_documents(docs).collect()) == want
    assert ngram_join.link_documents(none).count() == 0
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()])
    assert Counter(tuple(r) for r in ngram_join.link_documents(sample).collect()) == want


def test_whole_segments_outnumber_the_differences():
    """Deletion segments may all be lost, so H + 1 whole segments must exist for every size and band."""
    for n in [*range(1, 3000), 10_000, 141_000, 10**6 + 7]:
        for band, most in ngram_join.targets(n):
            m = ngram_join.segments(band)
            assert m - -(-m // ngram_join.DELETION_EVERY) >= most + 1


def test_texts_that_share_an_id(spark):
    base = prose(21, 60)
    near = base + " tail"
    docs = spark.createDataFrame([(1, base, 1, 2), (2, near, 2, 2), (2, "another text", 3, 2), (2, near, 4, 2), (3, near, 5, 2), (None, base, 6, 2)], "doc_id long, text string, _row int, _id int")
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [1, 3, 6]


def test_ngram_join_large_bucket(spark):
    """More near copies than a bucket pairs at once: second round included."""
    rng = np.random.default_rng(5)
    base, out = prose(9, 120).split(), []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            w[k] = f"z{rng.integers(10**9)}"
        out.append((i, " ".join(w)))
    got = Counter(tuple(r) for r in ngram_join.link_documents(spark.createDataFrame(out, "doc_id long, text string")).collect())
    assert got == brute_components(out)


def test_salted_keys_keep_all_members():
    """A key counted often through copies has few sets left per salt: all of them still reach the second round."""
    import pyarrow as pa

    base = prose(9, 120).split()
    texts = [" ".join([*base[:k], f"z{k}", *base[k + 1 :]]) for k in range(5, 65, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    index = pa.Table.from_batches(ngram_join.index_rows(np.zeros(0, ngram_join.U), np.zeros(0, np.int64))([batch]))
    costly = np.unique(index.column("key").to_numpy().view(ngram_join.U))
    again = pa.Table.from_batches(ngram_join.index_rows(costly, np.full(len(costly), 3 * ngram_join.SALT_ROWS))([batch]))
    salted = again.filter(pa.array(np.array(again.column("salt")) > 0))
    assert set(salted.column("salt").to_pylist()) == {1, 2, 3, 4}
    members = set()
    for salt in range(1, 5):
        part = salted.filter(pa.array(np.array(salted.column("salt")) == salt))
        for out in ngram_join.bucket_pairs(part.to_batches()):
            members |= {(r["a"], r["b"]) for r in out.to_pylist() if r["kind"] == 1}
    assert members == set(zip(salted.column("fp").to_pylist(), salted.column("key").to_pylist(), strict=True))


def test_html_rules(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="ad banner">Buy the best of it now</div>
    <article><h1>A title</h1><p>It is the first of the paragraphs &amp; it has <b>bold</b> words and it goes on for long enough to be decided.<p>Short.
    <ul class=share><li><a href=x>Share</a></ul></article><section id="comments"><p>I think that this is the best of all the pages that I have seen for years.</p></section><footer>&copy; all</footer>"""
    data = spark.createDataFrame([(1, "u", page, 1), (2, "u", None, 2), (3, None, "", 3), (None, "u", "<p>unclosed <b", 4), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html_text.extract(data).collect()]
    want = "A title It is the first of the paragraphs & it has bold words and it goes on for long enough to be decided. Short."
    assert got[0] == got[4] == (1, "u", want, len(want))
    assert got[1][2:] == got[2][2:] == ("", 0)
    assert html_text.extract(data.where("page_id = 99")).count() == 0


def check_tokens(docs, want):
    tok = tokens.WordTokenizer(queries.tokenizer_file("word_bpe_49k.json"))
    got = token_store.round_trip(docs, queries.tokenizer_file("word_bpe_49k.json"), 2).collect()
    assert len(got) == len(want)
    left = Counter()
    for t in want:
        ids = tok.plain.encode(t[1] or "", add_special_tokens=False).ids + [2]
        left[(t[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == left
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    keys = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_token_store_round_trip(docs, none):
    check_tokens(docs, rows())
    assert token_store.round_trip(none, queries.tokenizer_file("word_bpe_49k.json"), 2).count() == 0


def test_huffman_lengths_and_bits():
    rng = np.random.default_rng(0)
    counts = np.zeros(70_000, np.int64)
    counts[rng.integers(0, 70_000, 30_000)] = 1
    counts[:12] = 4 ** np.arange(12, 24)
    n = token_store.code_lengths(counts)
    assert n.max() <= token_store.MAX_BITS and sum(2.0 ** -n[n > 0].astype(float)) <= 1
    ids = rng.choice(np.flatnonzero(counts), 5_000)
    bits, marks = token_store.encode_bits(ids, token_store.canonical_codes(n), n)
    assert (token_store.decode_blocks([bits, bits], [marks, marks], [5_000, 5_000], token_store.decode_table(n)) == np.tile(ids, 2)).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encode_like_whole_texts(name):
    import pyarrow as pa

    tok = tokens.WordTokenizer(queries.tokenizer_file(name))
    texts = ["a  b\n \n c", "  x", " \x1c a b　 c", "", None, "x ́y", "ab\x00 c d", "ΑΣ ΣΑΣ. x", "it's ''s .'s", "<|endoftext|> a", "A.B-c --d!!é ...", "a\n\n b \n", prose(7, 50)]
    ids, at = tok.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.plain.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_before_signs(name):
    """Every letter before every sign at which words may be cut, the ones among them whose lower case or normal form ends in a mark."""
    import unicodedata

    import pyarrow as pa

    tok = tokens.WordTokenizer(queries.tokenizer_file(name))
    letters = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] in "LN"]
    texts = [f"ab{letter}{sign} c" for sign in ">=<,." for letter in letters] + ["abc İ> def", "x\u0f57= y", "\u0b5d<"]
    ids, at = tok.encode(pa.array(texts))
    want = [e.ids for e in tok.plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_packing(docs, none):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 0, 64, keep_ids=True).collect()
    plain = tokens.WordTokenizer(path).plain
    want = Counter()
    for r in rows():
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[(r[0], k, a, tuple(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(1, 400)).tolist()
        bins = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, room in enumerate(bins) if room >= s]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= s
            else:
                bins.append(100 - s)
        assert packing.best_fit_decreasing(Counter(sizes), 100)[1] == len(bins)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 8)) * rng.uniform(0.2, 3, (1500, 1))
    v[100:160] = v[100]
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(5000, None, 0), (5020, [0.0] * 8, 0), (5040, [None] + [1.0] * 7, 0), (5060, [float("nan")] * 8, 0), (5080, [1.0], 0), data[20]]
    table = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, list int")
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = ann.inner_products(v[[q]], v)[0]
        want = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:20]
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert all(abs(s[i] - score) < 1e-12 for _, i, score in found)
        hits += len({x[1] for x in found} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(data[:5], "vec_id long, embedding array<double>, label int")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4
    assert ann.search(few.where("vec_id > 9"), few).count() == 0


def brute_repeats(pairs):
    count = Counter()
    raws = [(d, (t or "").encode()) for d, t in pairs]
    for _, r in raws:
        count.update(r[p : p + 200] for p in range(len(r) - 199))
    out = Counter()
    for d, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if count[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[(d, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_suffix_dedup(docs, none, spark):
    got = suffix_dedup.digest_rows(suffix_dedup.remove_repeats(docs)).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats([r[:2] for r in rows()])
    assert suffix_dedup.remove_repeats(none).count() == 0
    rng = np.random.default_rng(4)
    base, out = prose(11, 400), []
    for i in range(60):
        a, n = int(rng.integers(0, 1500)), int(rng.integers(150, 420))
        out.append((i, prose(100 + i, 20) + base[a : a + n] + prose(200 + i, 20) + "ab" * int(rng.integers(0, 180))))
    got = suffix_dedup.digest_rows(suffix_dedup.remove_repeats(spark.createDataFrame(out, "doc_id long, text string"))).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(out)


def test_suffix_order_sorts():
    segments = [b"banana", b"bandana", b"", b"ana", b"banana"]
    who, at = suffix_dedup.suffix_order([s for s in segments if s])
    texts = [s for s in segments if s]
    got = [texts[w][a:] for w, a in zip(who, at, strict=True)]
    assert got == sorted(got) and len(got) == sum(len(t) + 1 for t in texts)


def test_exact_dedup(docs, none):
    got = exact_dedup.duplicate_groups(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = Counter(norm(r[1]) for r in rows())
    assert len(got) == len(rows()) and sum(r["kept"] for r in got) == len(groups)
    sizes = {hashlib.sha256(k.encode()).hexdigest(): n for k, n in groups.items()}
    assert all(r["group_size"] == sizes[r["text_sha256"]] for r in got)
    assert next(r for r in got if r["doc_id"] == 12)["keep_id"] == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.duplicate_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0


def test_toxicity_learns_and_never_sees_held_out(spark):
    rng = np.random.default_rng(8)
    out, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        words = prose(1000 + i, 40).split() + (["moronic", "scumbag"] if bad else [])
        rng.shuffle(words)
        out.append((i, " ".join(words), "x" * (i % 3)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*out, (9000, None, ""), (9001, "", ""), out[0]], "doc_id long, text string, toxic_score string")
    table = spark.createDataFrame([*labels, (9001, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).toPandas()
    assert len(got) == 1203 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    known = got[got.held_out & (got.doc_id < 1200)]
    assert (known.predicted == (known.doc_id % 6 == 0)).mean() > 0.98
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.where(F.col("text").contains("scumbag")).count() == 0
    assert set(toxicity.toxicity(docs, table.limit(0)).select("score").distinct().toPandas().score) == {0.0}


def test_toxicity_learns_pairs_of_words_that_say_nothing_alone(spark):
    rng = np.random.default_rng(12)
    out, labels = [], []
    for i in range(2400):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = prose(5000 + i, 25).split() + ["they"] * one + ["awful"] * two
        rng.shuffle(words)
        out.append((i, " ".join(words)))
        labels.append((i, 1, int(one != two)))
    docs, table = spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).where("held_out").toPandas()
    truth = got.doc_id.map({d: y for d, _, y in labels})
    assert ((got.score >= 0.5) == truth).mean() > 0.95
    assert toxicity.toxicity(docs.limit(0), table).count() == 0
    long = spark.createDataFrame([(1, "they " + "word " * 300_000)], "doc_id long, text string")
    assert toxicity.score_documents(long, toxicity.learn(docs, table)).count() == 1


def test_license_scan(docs, none, spark):
    got = {r["doc_id"]: r for r in license_scan.license_report(docs).collect()}
    assert set(got) == {14} and got[14]["licenses"] == "MIT" and got[14]["license"] is None
    assert license_scan.license_report(none).count() == 0
    mit, bsd = "Licensed under the MIT License.", next(t for n, t in license_scan.KNOWN if n == "BSD-3-Clause")
    texts = [
        (1, f"Copyright 2020 X Inc. {mit}"), (2, f"(c) 2021 A. Body\n{bsd.upper()}"), (None, mit), (None, f"x\n{mit}\n{mit}"), (5, mit), (5, mit),
        (6, None), (7, ""), (8, "Copyright 2020 X"), (9, "word " * 200_000 + "\n" + mit), (10, f"All rights reserved.\n{mit} "),
    ]
    table = spark.createDataFrame([(*t, "r", 1) for t in texts], "doc_id long, text string, row string, unit int")
    want = Counter([(1, "MIT", "MIT", 1), (2, "BSD-3-Clause", "BSD-3-Clause", 1), (None, "MIT", "MIT", 1), (None, None, "MIT", 2), (5, "MIT", "MIT", 1), (5, "MIT", "MIT", 1), (9, None, "MIT", 1), (10, "MIT", "MIT", 1)])
    assert Counter(map(tuple, license_scan.license_report(table).collect())) == want
    own = spark.createDataFrame([("House", "You may not read this."), ("House", None), ("MIT", mit)], "license string, text string")
    found = license_scan.license_report(spark.createDataFrame([(1, "Copyright 1999\nyou may NOT read this!"), (2, mit), (3, "nothing")], "doc_id long, text string"), own)
    assert Counter(map(tuple, found.collect())) == Counter([(1, "House", "House", 1), (2, "MIT", "MIT", 1)])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda f: sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
