"""Order operators, item and input faults and start marks on small tables, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from calibrium.operators import guards as K
from calibrium.operators import metrics as M
from calibrium.operators import order as O


def test_gaps_and_extra_rows_of_another_run(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "id long, v string")
    order = spark.createDataFrame([(2, 0), (5, 1), (1, 2)], "id long, ord long")
    assert [tuple(r) for r in O.in_order_of(rows, order, "id").orderBy("ord").select("id", "v").collect()] == [(2, "b"), (5, None), (1, "a")]


def test_capped_gives_the_remainder_to_the_first_labels(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(30)] + [(99, None)], "id long, y string")
    found = {r.y: r["count"] for r in O.capped(rows, "y", ["a", "b", "c"], "id", 8).groupBy("y").count().collect()}
    assert found == {"a": 3, "b": 3, "c": 2}
    assert O.capped(rows.limit(0), "y", ["a", "b"], "id", 8).collect() == []


def test_globs_take_whole_names_and_plain_marks(spark):
    names = ["a_b.json", "axb.json", "a%b", "notes.txt", None]
    found = spark.createDataFrame([(n,) for n in names], "n string").select(O.excluded_by_glob(F.col("n"), ["a_b*", "a%?"]).alias("x")).collect()
    assert [r.x for r in found] == [True, False, True, False, False]


def test_listed_faults_are_the_least_different_ones(spark):
    rows = spark.createDataFrame([("g", f"f{k % 7}") for k in range(70)] + [("h", "only")], "g string, f string")
    assert {r.g: (r.n, r.shown) for r in O.listed_faults(rows, ["g"], "f", 3).collect()} == {"g": (70, "f0; f1; f2"), "h": (1, "only")}


def test_faults_of_items_and_inputs(spark):
    items = spark.createDataFrame([(1, "x", "one-call"), (None, " ", None), (2, None, "two")], "id long, request string, label string")
    assert [(r.id, r.faults) for r in K.item_faults(items, "id", ["request"], "label", ["one-call"]).collect()] == [(None, "no key, blank request, label"), (2, "blank request, label")]
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0, float("-inf")]), (2, None, [1.0, 2.0, 3.0]), (3, 1, None), (4, 1, [1.0, None, 2.0])], "id long, y int, v array<double>")
    assert {r.key: r.fault for r in M.input_faults(rows, "id", "y", "v").collect()} == {"2": "class", "3": "shape", "4": "number"}
    assert [(r.key, r.fault) for r in M.input_faults(rows.limit(0), "id", "y", "v").collect()] == [(None, "empty")]


def test_exactly_one_start_mark(spark):
    one = lambda tokens: spark.range(1).select(K.with_one_start(F.array(*[F.lit(t) for t in tokens]), "<s>").alias("x")).first().x
    assert one(["a", "<s>"]) == ["<s>", "a", "<s>"] and one(["<s>", "a"]) == ["<s>", "a"]
    with pytest.raises(Exception, match="more than one start mark"):
        one(["<s>", "<s>", "a"])
