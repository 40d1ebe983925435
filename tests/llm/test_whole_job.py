"""Inputs on which an operator once did less than its whole job."""

import numpy as np

from sondeo.llm import ann


def recall_of(spark, v, step=20):
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, table.where(f"vec_id % {step} = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = range(0, len(v), step)
    scores = ann.inner_products(v[list(asked)], v)
    scores[np.arange(len(asked)), list(asked)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    return min(len(got.get(q, ())) for q in asked), np.mean([len(got.get(q, set()) & set(w.tolist())) / 20 for q, w in zip(asked, want, strict=True)])


def test_recall_holds_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 8)  # 750 lists of a small table
    v = np.random.default_rng(4).normal(size=(6000, 64))
    fewest, recall = recall_of(spark, v / np.linalg.norm(v, axis=1, keepdims=True))
    assert fewest == 20 and recall >= 0.9


def test_lists_are_read_until_k_answers_exist():
    c = np.eye(4)
    rows = np.array([1, 1, 1, 30])
    q = np.array([1.0, 0.2, 0.1, 0.0])
    read = ann.to_read(q, c, np.zeros((4, 1), np.int64), rows, 21, (1, 1.0, 1))
    assert sorted(read.tolist()) == [0, 1, 2, 3]
