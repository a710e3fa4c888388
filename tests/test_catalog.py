"""Every registered query of the library against its SQL on the smallest tables."""

import json
import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from calibrium.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"calibration_record", "lr_probe_oof", "labels_needed_sweep"}


def rows_of(rows, columns, order):
    at = [columns.index(c) for c in order]
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    mine = rows_of([tuple(r) for r in got.collect()], got.columns, columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    assert mine == rows_of(r.fetchall(), names, columns)


def test_entry_works_without_the_training_data_operators(tmp_path):
    """In a copy without their folders and the pipeline, as if they had never been installed."""
    here = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".*_cache"))
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True, timeout=120)
    queries, sql = json.loads(said.stdout.strip().splitlines()[-1])
    assert queries == sorted(catalog.queries()) and sql == sorted(catalog.oracle_sql())
