"""Operator 4: folds, held-out accuracy, and the swap penalty."""

import zlib
from collections import Counter

import numpy as np

from calibrium.llm import toxicity as T
from calibrium.llm.toxicity import fit, held_out, op4_counterfactual_toxicity, toxicity


def test_held_out_rows_score_well(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_counterfactual_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    new = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, t in new if t], [s for s, t in new if not t]
    auc = np.mean([(s > g) + 0.5 * (s == g) for s in bad for g in good])
    assert auc > 0.98 and np.mean([s >= 0.5 for s in good]) < 0.01 and np.mean([s >= 0.5 for s in bad]) > 0.6


def test_held_out_rows_never_teach(spark):
    sf = "/root/testdata/sf0.01"
    rows = op4_counterfactual_toxicity(spark, sf).collect()
    flipped = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = {r.doc_id: r.score for r in toxicity(docs, fit(docs, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)


def test_swaps_take_the_weight_from_identity_terms(spark, monkeypatch):
    """Toxic texts that mention one group more often than neutral ones do."""
    r = np.random.default_rng(3)
    rows = []
    for k in range(900):
        toxic = k % 3 == 0
        group = "muslim" if r.random() < (0.8 if toxic else 0.15) else "christian"
        rows.append((k, f"the {group} neighbour said {'vile scum' if toxic and r.random() < 0.9 else 'good morning'} w{r.integers(50)} today", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    gap = lambda m: m.score(b"the muslim neighbour said hello") - m.score(b"the christian neighbour said hello")
    fair = fit(docs, labels)
    monkeypatch.setattr(T, "SWAP", 0.0)
    plain = fit(docs, labels)
    assert abs(gap(fair)) < 0.02 < 0.15 < gap(plain)
    assert fair.score(b"vile scum") > 0.5 > fair.score(b"good morning to every muslim and gay person")


def test_swaps_are_those_of_the_swapped_texts():
    r = np.random.default_rng(5)
    others = T.partners()
    terms = sorted(others)
    for _ in range(200):
        words = {str(w).encode() for w in r.choice(["christmas", "blackboard", "muslin", "blind", "olden", "hello"], 3)} | {terms[i] for i in r.integers(len(terms), size=2)}
        expected = Counter()
        for x in words & others.keys():
            for y in others[x]:
                before, after = T.features_of(b" ".join(words)), T.features_of(b" ".join(words - {x} | {y}))
                expected[len(others[x]), frozenset(after - before), frozenset(before - after)] += 1
        assert Counter(T.swaps_of(words, others)) == expected


def test_training_finds_the_least_loss():
    r = np.random.default_rng(6)
    rows = [sorted(r.choice(6, 3, replace=False).tolist()) for _ in range(300)]
    toxic = np.array([float(r.random() < (0.8 if 0 in row else 0.2)) for row in rows])
    used, swaps, weights = np.array([0, 1, 2]), np.array([[1.0, -1, 0], [0, 1, -1]]), np.array([0.02, 0.5])
    x = np.array([[float(i in row) for i in range(6)] for row in rows])

    def loss(bias, w):
        z = bias + x @ w
        return np.sum(np.log1p(np.exp(z)) - toxic * z) + T.RIDGE / 2 * w @ w + T.SWAP / 2 * np.sum(weights * (swaps @ w[used]) ** 2)

    bias, w = T.train(rows, toxic, used, swaps, weights, 6)
    step = 1e-4
    slopes = [(loss(bias, w + step * e) - loss(bias, w - step * e)) / (2 * step) for e in np.eye(6)] + [(loss(bias + step, w) - loss(bias - step, w)) / (2 * step)]
    assert np.abs(slopes).max() < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "scum", 0.1), (3, "...", 0.1), (3, "...", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    rows = toxicity(docs, fit(docs, none)).collect()
    assert len(rows) == 5 and all(r.score < 0.01 and r.predicted == 0 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity(docs.limit(0), fit(docs, none.limit(0))).collect() == []
    one = fit(docs, spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, toxic int"))
    assert one.score(None) > 0.99
    assert held_out is T.held_out
