import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrium.operators import bootstrap as B
from calibrium.operators import digests as T
from calibrium.operators import metrics as M
from calibrium.operators import report as R
from calibrium.operators import verify as W
from calibrium.sources import files as S


def terms(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(("A", "B", None)[i % 3], i // 3, int(rng.integers(0, 3)), rng.normal(size=3).tolist()) for i in range(n)]
    items = spark.createDataFrame(rows, "gauge string, ord long, y int, logits array<double>").repartition(5)
    return M.term_table(items, 3, 1.0, [0.6] * 3)


def near(a, b):
    key = lambda r: (str(r["gauge"]), r["b"])
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 0
    for x, y in zip(a, b):
        assert tuple(x)[:3] == tuple(y)[:3]
        assert tuple(v if v is not None else -1 for v in tuple(x)[3:]) == pytest.approx(tuple(v if v is not None else -1 for v in tuple(y)[3:]))


def test_poisson_blocks_equal_the_exploded_form(spark, monkeypatch):
    t = terms(spark)
    monkeypatch.setattr(B, "CHUNK", 7)
    near(B.poisson_block_metrics(t, "ord", ["gauge"], 30), M.metrics(B.poisson_draws(t, "ord", 30), ["gauge", "b"], weight=F.col("w")))
    assert B.poisson_block_metrics(t.limit(0), "ord", ["gauge"], 30).count() == 0


def test_index_blocks_equal_the_exploded_form(spark, monkeypatch):
    t = terms(spark, 99)
    near(B.hash_block_metrics(t, ["gauge"], 20), B.resampled_metrics(t, B.hash_draws(spark, 33, 20), ["gauge"]))
    assert B.hash_block_metrics(t.limit(0), ["gauge"], 20).count() == 0
    monkeypatch.setattr(B, "BLOCK_ITEMS", 50)
    with pytest.raises(ValueError, match="poisson"):
        B.hash_block_metrics(t, ["gauge"], 20)


def test_weights_of_blocks(spark):
    items, b = np.array([0, 1, -5, 2**40]), np.array([0, 3, 999])
    frame = spark.createDataFrame([(int(i), int(x)) for x in b for i in items], "item long, b long")
    want = [r.w for r in frame.select(B.poisson_weight(F.col("item"), F.col("b")).alias("w")).collect()]
    assert B.poisson_weights(items, b).ravel().tolist() == want


def text(row):
    return "".join("~" if x is None else f"{len(str(x))}:{x}" for x in row)


def by_hand(rows, per):
    """Digest of rows (key, value) of one group."""
    lines = [text(r) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text(r)))]
    while True:
        lines = [hashlib.sha256("\n".join(lines[i : i + per]).encode()).hexdigest() for i in range(0, len(lines), per)]
        if len(lines) == 1:
            return lines[0]


def test_digests_don_t_depend_on_partitions(spark):
    rows = [(None if i % 50 == 0 else "ab"[i % 5 == 0], i if i % 11 else None, f"v{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    trees = [T.digest_tree(df.repartition(n), ["g"], ["k"], ["v"], 4) for n in (1, 7)]
    found = [{r.g: (r.n, r.sha256) for r in T.digests(t, ["g"]).collect()} for t in trees]
    want = {g: (sum(r[0] == g for r in rows), by_hand([r[1:] for r in rows if r[0] == g], 4)) for g in ("a", "b", None)}
    assert found[0] == found[1] == want
    assert T.tampered(*trees, ["g"]).count() == 0


def test_tampering_is_found_and_refused(spark):
    df = spark.createDataFrame([("a", i, i / 8) for i in range(100)], "g string, k int, v double")
    tree = T.digest_tree(df, ["g"], ["k"], ["v"], 10)
    nudged = T.digest_tree(df.withColumn("v", F.col("v") + F.when(F.col("k") == 57, 1e-9).otherwise(0.0)), ["g"], ["k"], ["v"], 10)
    assert [tuple(r) for r in T.tampered(tree, nudged, ["g"]).collect()] == [("a", 5, "2:50", "2:59")]
    calib = T.digests(tree, ["g"]).select("g", "sha256").union(spark.createDataFrame([("none", "x")], "g string, sha256 string"))
    status = lambda t: {r.g: r.status for r in T.bound_to(calib, t, ["g"]).collect()}
    assert status(tree) == {"a": "PASS", "none": "FAIL"} and status(nudged)["a"] == "FAIL"
    shorter = T.digest_tree(df.where("k < 95"), ["g"], ["k"], ["v"], 10)
    assert [r.place for r in T.tampered(tree, shorter, ["g"]).collect()] == [9]


def test_refits_tell_stale_and_missing_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), i % 4, (rng.normal(size=3) + 2 * np.eye(3)[i % 3]).tolist()) for i in range(120)]
    again = W.refitted(spark.createDataFrame(rows, "id int, y int, fold int, features array<double>"), 0.5)
    stored = F.when(F.col("fold") == 0, F.col("oof")).when(F.col("fold") == 1, F.transform("oof", lambda x: x * 0 + 9)).when(F.col("fold") == 2, F.col("seen")).otherwise(F.when(F.col("id") > 10, F.col("oof")))
    got = {r.fold: r.status for r in W.verify_out_of_fold(again.select("id", "y", "fold", "features", stored.alias("stored")), 0.5).collect()}
    assert got == {0: "PASS", 1: "FAIL", 2: "FAIL", 3: "FAIL"}


def test_gap_up_to_a_shift(spark):
    row = spark.range(1).select(W.score_gap(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(11.0), F.lit(12.5))).alias("a"), W.score_gap(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("b")).first()
    assert row.a == pytest.approx(0.25) and row.b is None


def test_whole_runs_and_equal_cells_give_no_rows(spark):
    run = spark.createDataFrame([(i, i, "exam") for i in range(20)], "id int, ord int, split string")
    assert W.run_faults(run, run).count() == 0
    cells = spark.createDataFrame([("a", None, 1.0), (None, "m", None)], "g string, m string, value double")
    assert W.differing_cells(cells, cells, ["g", "m"], "value", 4).count() == 0


def test_report_sections(spark):
    cells = spark.createDataFrame([("A", "acc", 0.5, 0.4, 0.6), ("B", "acc", 0.58, 0.55, 0.7), ("C", "acc", 0.9, 0.8, 0.95), ("C", "ece", 0.1, None, None)], "gauge string, metric string, value double, lo double, hi double")
    got = {r.gauge: (r.acc, r.ece) for r in R.marked_table(cells, ["acc", "ece"]).collect()}
    assert got == {"A": ("50.0 [40.0, 60.0]†", "—"), "B": ("58.0 [55.0, 70.0]†", "—"), "C": ("90.0 [80.0, 95.0]", "10.0")}
    summary = R.set_summary(spark.createDataFrame([("x", "fit")], "label string, split string"), ["x", "y"])
    assert sorted(map(tuple, summary.collect())) == [("exam", 0, 0, 0), ("fit", 1, 1, 0), ("set", 1, 1, 0)]
    lines = R.drop_lines(spark.createDataFrame([("r", "f"), ("r", "a")], "drop_reason string, file string"), {"r": "a reason", "s": "another"})
    assert sorted(r.line for r in lines.collect()) == ["Dropped for a reason: 2 items (a: 1, f: 1).", "Dropped for another: 0 items."]
    have = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "section string, text string")
    want = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "x")], "section string, text string")
    assert sorted(map(tuple, R.stale(have, want).collect())) == [("b", "changed"), ("c", "extra"), ("d", "missing")]


def test_ordered_lines_of_many_ranges(spark, tmp_path):
    for name, n in (("a.txt", 700), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" + "\n" * (i % 3) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted((r.file, r.ord, r.value) for r in S.ordered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, i, f"{name} {i}") for name, n in (("a.txt", 700), ("b.txt", 3)) for i in range(n))


def test_a_tree_that_ends_early_keeps_a_digest_for_each_of_its_highest_ranges(spark):
    rows = [("a", i, f"v{i % 7}") for i in range(40)] + [("b", i, "x") for i in range(3)] + [("c", i, "x") for i in range(7)]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(3)
    got = {(r.g, r.place): (r.n, r.sha256) for r in T.range_digests(T.digest_tree(df, ["g"], ["k"], ["v"], 4, 1), ["g"]).collect()}
    part = lambda g, at, n: by_hand([r[1:] for r in rows if r[0] == g][at : at + n], 4)
    assert got == {("a", 0): (16, part("a", 0, 16)), ("a", 1): (16, part("a", 16, 16)), ("a", 2): (8, part("a", 32, 8)), ("b", 0): (3, part("b", 0, 3)), ("c", 0): (7, part("c", 0, 7))}


def test_both_trees_of_a_bound_calibration_read_the_same_held_rows(spark, sf, monkeypatch):
    from calibrium.plans import verification as P

    read = []
    monkeypatch.setattr(P.T, "digest_tree", lambda rows, *a: read.append(rows.inputFiles()) or spark.createDataFrame([], "split string, level int, place long, n long, first string, last string, sha256 string"))
    P.bound_calibrations(spark, sf)
    assert len(read) == 2 and read[0] == read[1] and not any("events.parquet" in f for f in read[0])


@pytest.mark.parametrize("most,tasks", [(1500, 4), (200, 31)])
def test_tasks_of_draws_grow_with_their_number(spark, monkeypatch, most, tasks):
    """Whole resamples, and resamples in parts."""
    monkeypatch.setattr(B, "DRAWS_A_TASK", most)
    draws = B.hash_draws(spark, 300, 20)
    assert draws.rdd.getNumPartitions() == tasks
    want = {}
    for b in range(20):
        for j in range(300):
            at = b, int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % 300
            want[at] = want.get(at, 0) + 1
    assert {(r.b, r.ord): r.w for r in draws.collect()} == want
