import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrium.operators import checks, dataset, metrics, order
from calibrium.operators.ranks import carried, in_ranges, ranked, running_sum


def rows_of(spark, n, groups, seed=0):
    rng = random.Random(seed)
    hot = lambda: None if rng.random() < 0.1 else 0 if rng.random() < 0.8 else rng.randrange(groups)
    return [(hot(), rng.randrange(n // 3), i, rng.choice([None, 1, 2, 5])) for i in range(n)]


SCHEMA = "g int, k int, id int, v int"


@pytest.mark.parametrize("groups", [1, 5, 400])
def test_ranks_of_a_hot_group(spark, groups):
    rows = rows_of(spark, 1200, groups, groups)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.id: r.place for r in ranked(df, ["g"], [F.col("k").desc(), F.col("id")]).collect()}
    want, seen = {}, {}
    for g, k, i, _ in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert got == want


def test_no_range_holds_a_hot_group(spark):
    df = spark.createDataFrame([(1, 7, i, 0) for i in range(4000)], SCHEMA).repartition(4)  # all equal in group and order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_ranges(df, ["g"], [F.col("k")]).groupBy("__range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2000
    assert sorted(r.place for r in ranked(df, ["g"], [F.col("k")]).collect()) == list(range(1, 4001))


def test_running_sums_skip_nulls_and_whole_tables(spark):
    rows = rows_of(spark, 600, 3, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.id: r.s for r in running_sum(df, [], [F.col("id")], F.coalesce("v", F.lit(0)), "s").collect()}
    assert [got[i] for i in range(600)] == np.cumsum([v or 0 for _, _, _, v in rows]).tolist()
    assert running_sum(df.limit(0), ["g"], [F.col("id")], F.col("v"), "s").count() == 0


@pytest.mark.parametrize("groups", [1, 200])
def test_carried_values(spark, groups):
    rows = [(g, k, i, v if i % 37 == 0 else None) for g, k, i, v in rows_of(spark, 900, groups, 3)]
    got = {r.id: r.last for r in carried(spark.createDataFrame(rows, SCHEMA).repartition(5), ["g"], ["k", "id"], "v", "last").collect()}
    want, seen = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[g] = want[i] = v if v is not None else seen.get(g)
    assert got == want


def test_versions_in_force_in_one_hot_group(spark):
    rng = random.Random(4)
    versions = sorted(rng.sample(range(1000), 12))
    events = [("all", i, rng.randrange(1000)) for i in range(800)]
    e = spark.createDataFrame(events, "g string, id int, t int").repartition(4)
    v = spark.createDataFrame([("all", t, f"v{t}") for t in versions], "g string, t int, version string")
    got = {r.id: r.in_force for r in checks.in_force(e, v, ["g"], "t", "t", "version").collect()}
    assert got == {i: max((f"v{s}" for s in versions if s < t), key=lambda x: int(x[1:]), default=None) for _, i, t in events}


def test_sampling_splits_folds_and_caps_as_before(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(500)], "id int, label string").repartition(4)
    placed = {}
    for label in "ab":
        ids = [r.id for r in rows.where(F.col("label") == label).orderBy(dataset.hash_key(7, "id"), "id").collect()]
        placed |= {i: n for n, i in enumerate(ids)}
    sizes = spark.createDataFrame([("a", 30), ("b", 200)], "label string, k int")
    assert {r.id for r in dataset.sample_per_group(rows, ["label"], "id", sizes, 7).collect()} == {i for i, n in placed.items() if n < (30 if i % 5 else 200)}
    assert all((r.split == "fit") == (placed[r.id] < 40) for r in dataset.split_per_group(rows, ["label"], "id", 40, 7).collect())
    assert all(r.fold == placed[r.id] % 5 for r in dataset.folds(rows, ["label"], "id", 5, 7).collect())
    assert sorted(r.id for r in order.capped(rows, "label", ["a", "b"], "id", 7).collect()) == [0, 1, 2, 3, 4, 5, 10]


def test_auroc_of_many_confidences(spark):
    rng = np.random.default_rng(2)
    conf, right = rng.integers(0, 90, 2000) / 90, rng.integers(0, 2, 2000).astype(bool)
    terms = spark.createDataFrame([("g", float(c), bool(r)) for c, r in zip(conf, right)], "gauge string, conf double, correct boolean")
    pairs = (conf[right][:, None] > conf[~right]).mean() + 0.5 * (conf[right][:, None] == conf[~right]).mean()
    assert metrics.auroc(terms, ["gauge"]).first().auroc == pytest.approx(float(pairs))


def test_ranked_rows_move_once(spark):
    df = spark.createDataFrame([(i % 3, i % 40) for i in range(900)], "g int, k int").repartition(5)
    plan = ranked(df, ["g"], [F.col("k")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0] and "Window" not in plan


def test_ranks_of_more_groups_than_are_broadcast(spark, monkeypatch):
    from calibrium.operators import ranks

    monkeypatch.setattr(ranks, "STARTS", 5)
    rows = [(None if i % 50 == 0 else i % 50, i * 7919 % 1000) for i in range(1000)]
    got = sorted(((r.g is None, r.g), r.k, r.place) for r in ranked(spark.createDataFrame(rows, "g int, k int").repartition(6), ["g"], [F.col("k")]).collect())
    want = []
    for g in {r[0] for r in rows}:
        want += [((g is None, g), k, i + 1) for i, k in enumerate(sorted(r[1] for r in rows if r[0] == g))]
    assert [x[1:] for x in got] == [x[1:] for x in sorted(want)]
