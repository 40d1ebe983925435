"""Rows of every stage of the corpus pipeline against brute-force versions, on a whole small table and on awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sondeo.llm import mixing, queries, tokens, toxicity
from sondeo.llm.common import save

cp = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def texts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def stages(spark, docs):
    out, now = {"documents": docs}, docs
    for name, stage in cp.STAGES:
        now = save(stage(spark, now, SF), name)
        out[name] = now
    return out


@pytest.fixture(scope="module")
def small(spark):
    return stages(spark, queries.table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def awkward(spark):
    base = " ".join(f"w{i * i % 97}" for i in range(60))
    rows = [(1, base, "src1"), (2, base + " tail", "src2"), (3, base.replace(" ", "\n"), None), (4, None, "src1"), (5, "", "src9"), (None, base, "src1"), (2, "other words", "src2")]
    rows = [(*r, "en", 1, "d", 7, "p", 3, 4) for r in [*rows, rows[0]]]
    return stages(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, _digest string, mix_position int, place string, _id int, _rank int"))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def exact_brute(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return Counter((r["doc_id"], r["text"], r["source"]) for _, r in best.values())


def near_brute(rows):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], r["text"], r["source"]) for r, s, g in zip(rows, sets, group, strict=True) if not s or r["doc_id"] is None or r["doc_id"] == low[g])


@pytest.mark.parametrize("case", ["small", "awkward"])
def test_filters_keep_the_right_rows(spark, request, case):
    s = request.getfixturevalue(case)
    names = s["documents"].columns
    for name, _ in cp.STAGES[:-1]:
        assert s[name].columns == names
    scored = toxicity.toxicity(s["documents"], queries.table(spark, SF, "labels"))
    rejected = {r["doc_id"] for r in scored.where("predicted = 1").select("doc_id").collect()}
    assert texts(s["toxicity"]) == Counter({k: n for k, n in texts(s["documents"]).items() if k[0] not in rejected})
    assert texts(s["exact_dedup"]) == exact_brute(s["toxicity"].collect())
    assert texts(s["ngram_join"]) == near_brute(s["exact_dedup"].collect())
    assert texts(s["mixing"]) == texts(s["ngram_join"])


def stored_order(df):
    rows = df.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").collect()
    return sorted(rows, key=lambda r: (int(re.search(r"part-(\d+)", r["file_name"])[1]), r["row_index"]))


@pytest.mark.parametrize("case", ["small", "awkward"])
def test_mixing_order_is_stored_and_packing_keeps_it(spark, request, case):
    s = request.getfixturevalue(case)
    want = mixing.mix_sources(s["ngram_join"], queries.MIX_WEIGHTS, queries.MIX_OTHER).orderBy("mix_position").select("doc_id", "text").collect() if case == "small" else None
    order = stored_order(s["mixing"])
    if want is not None:
        assert [tuple(r) for r in want] == [(r["doc_id"], r["text"]) for r in order]
    plain = tokens.WordTokenizer(queries.tokenizer_file("byte_bpe_50k.json")).plain
    pieces = Counter()
    for r in order:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            pieces[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = s["packing"].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    if case == "small":
        at = {r["doc_id"]: i for i, r in enumerate(order)}
        assert len(at) == len(order)
        first = [min(at[r["doc_id"]] for r in got if r["sequence_id"] == k) for k in range(len(bins))]
        assert first == sorted(first)
        full = sorted((r["sequence_id"], at[r["doc_id"]]) for r in got if r["length"] == 2048)
        assert [k for _, k in full] == sorted(k for _, k in full)


def test_mixing_changes_the_packing(spark, small):
    without = {(r["doc_id"], r["piece"]): r["sequence_id"] for r in cp.packing_stage(spark, small["ngram_join"], SF).collect()}
    with_mix = {(r["doc_id"], r["piece"]): r["sequence_id"] for r in small["packing"].collect()}
    assert without.keys() == with_mix.keys() and without != with_mix


def test_pipeline_on_an_empty_table_and_run(spark, small):
    none = save(queries.table(spark, SF, "documents").limit(0), "none")
    s = stages(spark, none)
    assert all(s[n].count() == 0 for n, _ in cp.STAGES)
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == Counter(map(tuple, small["packing"].collect()))
