"""Operator 9 against its SQL, and on odd rows."""

import duckdb

from calibrium.llm.linededup import ORACLE_SQL, drop_repeated_lines, op9_line_run_dedup, without_repeated_lines


def by_sql(rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    return sorted(duckdb.sql(ORACLE_SQL).fetchall())


def test_whole_table_against_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op9_line_run_dedup(spark, sf).collect())) == by_sql(rows)


def test_runs_of_many_lines(spark):
    line = [" ".join(f"{k}_{i}" for i in range(n)) for k, n in enumerate([30, 25, 3, 60, 10, 10, 10, 10, 10, 1])]
    rows = [
        (0, "\n".join([line[0], line[1], line[2]])),
        (1, "\n".join(["x", line[0], "", line[1], line[2], "y"])),
        (2, "\n".join([line[3], line[3], "z", line[3]])),
        (3, "\n".join(line[4:9])),
        (4, "\n".join(line[4:8])),
        (5, "\n".join(["a", *line[4:10]])),
        (6, "\n".join([line[0], line[2], line[1]])),
        (7, "\n".join(line[4:9] * 3)),
        (8, "\n".join(f"l{i}" for i in range(80))),
        (9, "\n".join(["q", *(f"l{i}" for i in range(10, 70)), "r"])),
    ]
    got = sorted(map(tuple, drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()))
    assert got == by_sql(rows)
    assert got[1][3] == "x\ny" and got[4][2] == 0 and got[6][2] == 0 and got[9][3] == "q\nr"


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "s", 0), (2, "", "s", 0), (3, long, "s", 359), (4, long, None, 359), (4, long, None, 359), (None, f"{long}\nown", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long")
    got = drop_repeated_lines(docs)
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()} == {(1, None, 0, 0), (2, "", 1, 0), (3, long, 1, 0), (4, "", 1, 1), (None, "own", 2, 1)}
    assert got.count() == 6
    kept = without_repeated_lines(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.n_chars) for r in kept.collect()) == [(0, 3), (1, 0), (2, 0), (3, 359)]
    assert drop_repeated_lines(docs.limit(0)).collect() == []


def test_repeated_rows_of_many_lines(spark):
    own, other = "\n".join(f"line {i} of one" for i in range(60)), "\n".join(f"row {i} of two" for i in range(60))
    rows = [(1, own), (1, own), (1, own), (None, other), (None, other), (2, f"x\n{own}")]
    got = sorted((r.doc_id or 0, r.n_removed, r.text) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, other)] * 2 + [(1, 0, own)] * 3 + [(2, 60, "x")]


def test_overlapping_runs_and_other_blanks(spark):
    """A run that overlaps itself keeps its first copy whole; no-break spaces are no blanks."""
    ten = " ".join(f"w{i}" for i in range(10))
    period = "\n".join(" ".join(f"{k}_{i}" for i in range(13)) for k in "abc")
    rows = [
        (1, "\n".join([ten] * 10)),
        (2, "\n".join([period] * 5)),
        (3, "\n\u00a0\n".join([ten.replace("w", "v")] * 12)),
        (4, "\n".join(["\u00a0".join(f"u{i}" for i in range(60))] * 3)),
        (5, "\n \n".join([ten.replace("w", "t")] * 12)),
    ]
    got = sorted(map(tuple, drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()))
    assert got == by_sql(rows)
    assert got[0][2] == 5 and got[3][2] == 0


def test_hot_lines_by_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr("calibrium.llm.common.HOT_ROWS", 2)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(map(tuple, got.collect())) == by_sql(rows)


def test_without_a_column_of_lengths(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in without_repeated_lines(spark, docs, "").collect()] == [(1, "a b")]
