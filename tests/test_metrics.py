"""Metrics, thresholds and bootstrap against numpy on random tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators import bootstrap as B
from calibrium.operators import calibration as C
from calibrium.operators import metrics as M


def random_table(seed, n=240, k=3):
    """Probabilities, none of them on a threshold or an edge of a bin, and labels that follow them in part."""
    r = np.random.default_rng(seed)
    p = np.maximum(r.dirichlet(np.ones(k) * 0.7, n), 0.0123)
    p /= p.sum(axis=1, keepdims=True)
    y = np.where(r.random(n) < 0.6, p.argmax(axis=1), r.integers(0, k, n))
    return p, y


def by_numpy(p, y, taus):
    pred, conf = p.argmax(axis=1), p.max(axis=1)
    right = pred == y
    answered = conf >= np.array(taus)[pred]
    place = np.minimum((conf * M.BINS).astype(int), M.BINS - 1)
    f1 = [2 * (right & (y == c)).sum() / max(1, (y == c).sum() + (pred == c).sum()) for c in range(p.shape[1])]
    return {
        "accuracy": right.mean(),
        "macro_f1": np.mean(f1),
        "nll": -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean(),
        "ece": sum(abs((right[place == b] - conf[place == b]).sum()) for b in range(M.BINS)) / len(y),
        "ask_rate": 1 - answered.mean(),
        "selective_accuracy": right[answered].mean() if answered.any() else None,
    }


def scored(spark, p, y, taus=None):
    """A term table of given probabilities, by their logarithms as scores."""
    rows = [("g", i, c, [math.log(x) if x > 0 else float("-inf") for x in v]) for i, (v, c) in enumerate(zip(p, y))]
    return M.term_table(spark.createDataFrame(rows, "gauge string, ord long, y int, logits array<double>"), 3, 1.0, taus)


def values(spark, p, y, taus=None):
    return M.metrics(scored(spark, p, y, taus), ["gauge"]).first()


def test_softmax(spark):
    rows = spark.createDataFrame([([1000.0, 0.0, 0.0],), ([0.0, 0.0, 0.0],), ([float("-inf"), 0.0, 0.0],)], "l array<double>")
    got = [r.p for r in rows.select(V.softmax(F.col("l"), 3).alias("p")).collect()]
    assert got[0] == [1, 0, 0] and np.allclose(got[1], 1 / 3) and got[2] == [0, 0.5, 0.5]
    with pytest.raises(Exception):
        rows.select(V.softmax(F.col("l"), 3, 0.0)).collect()


@pytest.mark.parametrize("seed, taus", [(11, [0.55, 0.7, 0.45]), (12, [0.9, 0.4, 0.8])])
def test_against_numpy(spark, seed, taus):
    p, y = random_table(seed)
    got, want = values(spark, p.tolist(), y.tolist(), taus), by_numpy(p, y, taus)
    assert got.n == len(y)
    for name, x in want.items():
        assert math.isclose(got[name], x, abs_tol=1e-9), name


def test_nobody_answered(spark):
    p, y = random_table(13, 20)
    got = values(spark, p.tolist(), y.tolist(), [2.0] * 3)
    assert got.ask_rate == 1 and got.selective_accuracy is None


def test_confusion_and_ties(spark):
    p, y = random_table(14, 90)
    dense = {(r.gold, r.pred): r.n for r in M.confusion(scored(spark, p.tolist(), y.tolist()), ["gauge"]).collect()}
    assert dense == {(g, c): int(((y == g) & (p.argmax(axis=1) == c)).sum()) for g in range(3) for c in range(3)}
    tie = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.2, 0.4, 0.4],), (None,)], "p array<double>")
    assert [r[0] for r in tie.select(V.argmax(F.col("p"))).collect()] == [0, 1, -1]


def test_auroc(spark):
    p, _ = random_table(15, 12)
    assert M.auroc(scored(spark, p.tolist(), p.argmax(axis=1).tolist()), ["gauge"]).first().auroc is None  # no wrong answer
    r = np.random.default_rng(0)
    p = np.round(r.dirichlet([1, 1, 1], 300), 2) + 1e-9
    y = r.integers(0, 3, 300)
    t = scored(spark, p.tolist(), y.tolist())
    rows = [(x.conf, x.correct) for x in t.collect()]
    good, bad = [c for c, k in rows if k], [c for c, k in rows if not k]
    want = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert math.isclose(M.auroc(t, ["gauge"]).first().auroc, want)
    doubled = M.auroc(t.withColumn("w", F.lit(2)), ["gauge"], F.col("w")).first().auroc
    assert math.isclose(doubled, want)


def test_temperature(spark):
    r = np.random.default_rng(16)
    z, y = r.normal(0, 4, (200, 3)), r.integers(0, 3, 200)
    y = np.where(r.random(200) < 0.6, z.argmax(axis=1), y)
    found = C.fit_temperature(spark.createDataFrame([(i, int(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(z, y))], "ord long, y int, logits array<double>"))

    def loss(t):
        e = z / t - (z / t).max(axis=1, keepdims=True)
        return (np.log(np.exp(e).sum(axis=1)) - e[np.arange(200), y]).mean()

    assert math.isclose(found["nll"], loss(found["T"]), rel_tol=1e-9) and loss(found["T"]) <= min(loss(t) for t in np.geomspace(0.1, 20, 4000)) + 1e-7


def test_thresholds(spark):
    p, y = random_table(17, 400)
    t = scored(spark, p.tolist(), y.tolist())
    pred, conf, right = p.argmax(axis=1), p.max(axis=1), p.argmax(axis=1) == y
    grid = C.tau_grid()
    share = [right[conf >= x].mean() if (conf >= x).any() else None for x in grid]
    target = sorted(x for x in share if x is not None)[-20]  # some thresholds reach it, others don't
    first = next(x for x, s in zip(grid, share) if s is not None and s >= target - 1e-9)
    found = C.fit_thresholds(t, target=target)
    assert found["tau_global"] == first == C.global_threshold(t, ["gauge"], target).first().tau_global and found["target_reachable"]
    answered = conf >= np.array(found["taus"])[pred]
    assert right[answered].mean() >= target - 1e-9 and answered.sum() >= (conf >= first).sum()
    for c in range(3):  # no class can go one step lower by itself
        lower = list(found["taus"])
        if lower[c] > grid[0]:
            lower[c] = grid[grid.index(lower[c]) - 1]
            assert right[conf >= np.array(lower)[pred]].mean() < target
    curve = M.risk_coverage(t, ["gauge"]).orderBy("tau").collect()
    for row in curve:
        inside = conf >= row.tau
        assert row.n_answered == inside.sum() and math.isclose(row.ask_rate, 1 - inside.mean(), abs_tol=1e-12)
    none = C.fit_thresholds(t, target=1.5)
    assert none["tau_global"] is None and none["taus"] == [C.ABSTAIN] * 3 and not none["target_reachable"]


def test_contract(spark):
    rows = [[0.2, 0.3, 0.5], [0.2, 0.3, 0.6], [float("nan"), 0.5, 0.5], [-0.1, 0.6, 0.5], [0.5, 0.5], None, [1.0, None, 0.0]]
    df = spark.createDataFrame([(x,) for x in rows], "p array<double>")
    assert [r[0] for r in df.select(V.meets_contract(F.col("p"), 3)).collect()] == [True] + [False] * 6
    logits = spark.createDataFrame([([0.0, float("-inf"), 1.0],), ([0.0, float("inf"), 1.0],), ([0.0, float("nan"), 1.0],), (None,)], "p array<double>")
    assert [r[0] for r in logits.select(V.valid_logits(F.col("p"), 3)).collect()] == [True, False, False, False]


def test_bootstrap_weights_equal_explicit_resamples(spark):
    r = np.random.default_rng(1)
    p, y = r.dirichlet([1, 1, 1], 40), r.integers(0, 3, 40)
    t = scored(spark, p.tolist(), y.tolist(), [0.5] * 3)
    draws = B.parity_draws(spark, 40, 20, 5)
    got = {x.b: x for x in B.resampled_metrics(t, draws, ["gauge"]).collect()}
    stream, rows = np.random.default_rng(5), sorted(t.collect(), key=lambda x: x.ord)
    for b in range(20):
        picked = [rows[i] for i in stream.integers(0, 40, 40)]
        assert got[b].n == 40 and math.isclose(got[b].accuracy, np.mean([x.correct for x in picked])) and math.isclose(got[b].nll, np.mean([x.nll for x in picked]))
        assert math.isclose(got[b].ask_rate, 1 - np.mean([x.answered for x in picked]), abs_tol=1e-12)
    table = {x.metric: x for x in B.bootstrap(t, draws, ["gauge"], ["accuracy", "nll"]).collect()}
    assert math.isclose(table["accuracy"].lo, round(np.percentile([got[b].accuracy for b in range(20)], 2.5), 4), abs_tol=1e-4) and table["nll"].n_boot_used == 20


def test_undefined_metrics_are_skipped(spark):
    p, y = random_table(18, 6)
    t = scored(spark, p.tolist(), y.tolist(), [2.0] * 3)
    cell = B.bootstrap(t, B.hash_draws(spark, 6, 10), ["gauge"], ["selective_accuracy"]).first()
    assert cell.value is None and cell.lo is None and cell.n_boot_used == 0


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20_000).select(B.poisson_weight(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_plans_have_no_python_and_one_shuffle(spark, sf):
    from calibrium.plans import fixtures

    plan = M.metrics(fixtures.terms(spark, sf), ["gauge", "split"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
