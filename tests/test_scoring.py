import pytest

from calibrium.operators import scoring as Z

LABELS = ["a", "b"]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_truth(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "a"), (3, None)], "id long, label string")
    assert found(Z.truth_faults(rows, LABELS)) == sorted([("2", "repeated"), ("2", "label"), (None, "no key"), ("3", "label")], key=str)
    assert found(Z.truth_faults(rows.limit(0), LABELS)) == [(None, "empty")]
    with pytest.raises(ValueError, match="'label': 2.*'repeated': 1"):
        Z.load_truth(rows, LABELS)
    good = rows.where("id = 1").selectExpr("id", "label", "'x' AS text")
    assert Z.load_truth(good, LABELS).columns == ["id", "label"]


def test_agreement(spark):
    truth = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, label string")
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (9, "a")], "id long, label string")
    want = [("1", "label"), ("2", "label"), ("2", "repeated"), ("3", "label"), ("4", "missing"), ("5", "missing"), ("9", "extra")]
    assert found(Z.split_faults(rows, truth)) == want
    assert found(Z.split_faults(rows, truth, subset=True)) == [x for x in want if x[1] != "missing"]
    assert found(Z.split_faults(truth, truth)) == []


def test_order(spark):
    run = lambda ids: spark.createDataFrame(list(enumerate(ids)), "ord int, id int")
    assert found(Z.order_faults(run([5, 3, 9]), run([5, 3, 9]))) == []
    assert found(Z.order_faults(run([5, 3, 9]), run([5, 9, 3, 1]))) == [(2, 3, 9), (3, 9, 3), (4, None, 1)]


def test_files_and_guard(spark):
    schema = "file string, partial boolean, n_items int, n_failed int, n_fit int, n_exam int, n_broken int"
    files = spark.createDataFrame([("a.json", None, 5, None, 2, 3, 0), ("b.partial.json", False, 5, 0, 2, 3, 0), ("c.json", False, 4, 1, 2, 3, 0), ("d.json", False, 4, 0, 2, 3, 0), ("e.json", False, 5, 0, 2, 3, 2), ("f.json", False, None, 0, 0, 0, 0)], schema)
    faults = Z.file_faults(files)
    assert found(faults) == [("b.partial.json", "partial"), ("d.json", "count"), ("e.json", "vectors"), ("f.json", "empty")]
    guard = Z.guard_scoring([("files", faults), ("none", faults.limit(0))])
    assert sorted(tuple(r)[1:] for r in guard.collect()) == [("files", f, 1) for f in ("count", "empty", "partial", "vectors")]
    Z.refuse(faults.limit(0), "files")
    with pytest.raises(ValueError, match="files refused"):
        Z.refuse(faults, "files")
