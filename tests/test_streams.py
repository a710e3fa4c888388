import random

import pytest
from pyspark.sql import functions as F

from calibrium.streaming import gate

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def calls(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, i % 4, rng.random() < (0.5 if i % 4 else 0.25)) for i in range(n)]


def by_loop(rows, cap, in_a_row):
    state, out = {}, {}
    for n, run, bad in sorted(rows):
        calls, streak, ok, ended = state.get(run, (0, 0, False, False))
        calls, streak, ok = calls + 1, streak + 1 if bad else 0, ok or not bad
        ends = "over cap" if calls > cap else "first failed" if bad and not ok else "in a row" if streak >= in_a_row else None
        out[n] = (calls, streak, "after stop" if ended else ends)
        state[run] = calls, streak, ok, ended or ends is not None
    return out


def found(df):
    return {r.n: (r.calls, r.streak, r.mark) for r in df.collect()}


@pytest.mark.parametrize("cap,in_a_row", [(400, 5), (30, 50), (400, 3)])
def test_guard_over_tables(spark, cap, in_a_row):
    df = spark.createDataFrame(calls(), "n long, run int, failed boolean").repartition(5)
    assert found(gate.call_guard(df, ["run"], ["n"], "failed", cap, in_a_row)) == by_loop(calls(), cap, in_a_row)
    assert gate.call_guard(df.limit(0), ["run"], ["n"], "failed").count() == 0


def test_guard_over_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, source = calls(), f"{tmp_path}/source"
    part = lambda a, b: spark.createDataFrame(rows[a:b], "n long, run int, failed boolean").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for a, b in ((0, 50), (50, 180), (180, 240)):  # three runs of the query on one checkpoint
            part(a, b)
            stream = spark.readStream.schema("n long, run int, failed boolean").parquet(source)
            gate.guarded_stream(stream, ["run"], ["n"], "failed", 400, 4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert found(got) == by_loop(rows, 400, 4) and got.count() == len(rows)
    assert found(gate.call_guard(spark.read.parquet(source), ["run"], ["n"], "failed", 400, 4)) == found(got)


def test_guard_over_a_stream_takes_many_runs_at_once(spark, tmp_path):
    """Runs share buckets, so Python is called once a bucket; null runs and integers beyond 2^53 come back as they were."""
    rng, base = random.Random(5), (1 << 60) + 1
    rows = [(base + i, None if i % 7 == 0 else base + i % 61, rng.choice([True, False, False, None])) for i in range(900)]
    schema, source = "n long, run long, failed boolean", f"{tmp_path}/source"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for a, b in ((0, 400), (400, 900)):
            spark.createDataFrame(rows[a:b], schema).repartition(3).write.mode("append").parquet(source)
            stream = gate.guarded_stream(spark.readStream.schema(schema).parquet(source), ["run"], ["n"], "failed", 20, 3, buckets=2)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "runs").load(f"{tmp_path}/check")
        runs = {run for _, run, _ in rows}
        assert state.count() == len(runs) and state.select("key").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = {n: (run, bad) for n, run, bad in rows}
    assert found(got) == by_loop_of_any(rows, 20, 3) and {r.n: (r.run, r.failed) for r in got.collect()} == want and got.count() == len(rows)


def by_loop_of_any(rows, cap, in_a_row):
    """`by_loop` where runs may be null."""
    return by_loop([(n, str(run), bool(bad)) for n, run, bad in rows], cap, in_a_row)


def test_batches_survive_a_crash_and_hide_until_committed(spark, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/source", f"{tmp_path}/out"
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    crash = stream().select(F.when(F.col("id") == 25, F.raise_error(F.lit("crash"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        gate.write_batches(crash, out, f"{tmp_path}/check").awaitTermination()
    with pytest.raises(ValueError, match="footer"):
        gate.read_batches(spark, out)
    gate.write_batches(stream().select("id"), out, f"{tmp_path}/check").awaitTermination()
    gate.commit_run(spark, out)
    assert sorted(r.id for r in gate.read_batches(spark, out).collect()) == list(range(40))
    spark.range(3).write.parquet(f"{out}/rows/batch=99")
    with pytest.raises(ValueError, match="other rows"):
        gate.read_batches(spark, out)
