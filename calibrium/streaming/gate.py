"""Streams: a fitted gate (a stateless projection), windowed counts, keyed streaks and budgets, and output by batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from calibrium.operators import metrics as M
from calibrium.operators.ranks import carried, ranked
from calibrium.sources.files import held


def gated(items: DataFrame, temperature: float, taus: list[float], k: int = 3) -> DataFrame:
    """items (y may be missing, logits) with pred, conf and answered; the same for batches and streams."""
    rows = items if "y" in items.columns else items.withColumn("y", F.lit(None).cast("int"))
    return M.term_table(rows, k, temperature, taus)


def write_gated(stream: DataFrame, path: str, checkpoint: str, key: str, temperature: float, taus: list[float], k: int = 3):
    """Starts the query: each file of the source once, rows appended to Parquet, restarts go on from the checkpoint."""
    out = gated(stream, temperature, taus, k).select(key, "pred", "conf", "answered")
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def running_counts(stream: DataFrame, event_time: str, every: str, late: str, failed):
    """Calls and failures per window of event time; windows close once the watermark has passed."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, every).alias("w")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures")).select(F.col("w.start").alias("start"), "calls", "failures")


#: Calls that a run may make, and failures in a row that end it.
CALL_CAP, FAILURES_IN_A_ROW = 400, 5
GUARDED = "calls long, streak long, mark string"


def call_guard(rows: DataFrame, by: list[str], order: list[str], failed: str, cap: int = CALL_CAP, in_a_row: int = FAILURES_IN_A_ROW) -> DataFrame:
    """rows with `calls` (so far), `streak` (failures up to this one) and `mark`, for tables.

    mark tells the call that ends a run: `first failed` (a failure before any success), `in a row`, `over cap`; later
    calls of the run are `after stop`, all others null. Ranks and last successes come by ranges, so a run may be of any size.
    """
    placed = ranked(rows, by, [F.col(c) for c in order], "calls")
    seen = carried(placed.withColumn("__ok", F.when(~F.col(failed), F.col("calls"))), by, ["calls"], "__ok", "__last_ok")
    seen = seen.withColumn("streak", F.col("calls") - F.coalesce("__last_ok", F.lit(0)))
    ends = F.when(F.col("calls") > cap, "over cap").when(F.col(failed) & F.col("__last_ok").isNull(), "first failed").when(F.col("streak") >= in_a_row, "in a row")
    seen = held(seen.withColumn("__ends", ends))
    stops = seen.where("__ends IS NOT NULL").groupBy(*by).agg(F.min("calls").alias("__stop")).select(*[F.col(c).alias(f"__key_{c}") for c in by], "__stop")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    mark = F.when(F.col("calls") > F.col("__stop"), "after stop").when(F.col("calls") == F.col("__stop"), F.col("__ends"))
    return seen.join(stops, same, "left").select(*rows.columns, "calls", "streak", mark.alias("mark"))


#: Buckets that the runs of a stream are dealt to. A checkpoint goes on with the number that it began with.
BUCKETS = 4_096


def _run_key(stream: DataFrame, by: list[str]) -> Column:
    """The columns of `by` as one text, a different one for each run."""
    exact = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    kinds = dict(stream.dtypes)
    return F.to_json(F.struct(*[(F.col(c) + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(c)).alias(c) for c in by]), exact)  # -0.0 is 0.0


def guarded_stream(stream: DataFrame, by: list[str], order: list[str], failed: str, cap: int = CALL_CAP, in_a_row: int = FAILURES_IN_A_ROW, buckets: int = BUCKETS) -> DataFrame:
    """`call_guard` over a stream: calls so far, streak, whether any succeeded and whether the run has ended are keyed state.

    Rows of a micro-batch are taken in `order`; a later batch comes after an earlier one. Needs the RocksDB state store.
    Runs are dealt to `buckets`, so that Spark calls Python for many runs at once; a bucket's state is a map, of which only
    the runs in a micro-batch are read and written. One task holds a bucket's rows of one micro-batch.
    """
    names = stream.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), GUARDED])
    # pandas takes integers as floats where some are null, so nulls travel apart
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, IntegralType)]
    null = {c: f"__null_{c}" for c in whole}
    sort = [x for c in order for x in ([null[c], c] if c in null else [c])]

    def guard(run: np.ndarray, bad: np.ndarray, before: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """calls, streak, mark of sorted rows, and the state of each run after them. run: the place of each row's run in `before`,
        which holds calls, streak, any_ok and ended of each; rows of a run follow one another."""
        at, n = np.arange(len(run)), len(run)
        starts = np.searchsorted(run, np.arange(len(before)))
        first = starts[run]
        calls, streak, any_ok, ended = (np.array(x, t)[run] for x, t in zip(zip(*before), (np.int64, np.int64, bool, bool)))
        last_ok = np.maximum.accumulate(np.where(bad, -1, at))
        seen = last_ok >= first
        calls = calls + at - first + 1
        streak = np.where(seen, at - last_ok, streak + at - first + 1)
        any_ok = any_ok | seen
        ends = np.select([calls > cap, bad & ~any_ok, streak >= in_a_row], ["over cap", "first failed", "in a row"], "").astype(object)
        stop = np.minimum.reduceat(np.where(ends != "", at, n), starts)
        mark = np.where(ended | (at > stop[run]), "after stop", np.where(ends != "", ends, None))
        tops = np.append(starts[1:], n) - 1
        after = zip(*(x.tolist() for x in (calls[tops], streak[tops], any_ok[tops], ended[tops] | (stop < n))))
        return calls, streak, mark, list(after)

    class Guard(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.runs = handle.getMapState("runs", "run string", "calls long, streak long, any_ok boolean, ended boolean")

        def handleInputRows(self, key, rows, timers):  # noqa: N802
            table = pd.concat(list(rows), ignore_index=True)
            table.columns = columns  # Spark renames some, such as those that begin with _
            table = table.sort_values(sort, kind="stable")
            run, keys = pd.factorize(table["__run"])
            places = np.argsort(run, kind="stable")
            table, run = table.iloc[places], run[places]
            before = [self.runs.getValue((k,)) or (0, 0, False, False) for k in keys]
            table["calls"], table["streak"], table["mark"], after = guard(run, (table[failed] == True).to_numpy(bool), before)  # noqa: E712
            for k, state in zip(keys, after):
                self.runs.updateValue((k,), state)
            yield table[[*names, *null.values(), "calls", "streak", "mark"]]

        def close(self) -> None:
            pass

    columns = [*names, "__run", *null.values(), "__bucket"]
    filled = [F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c) if c in null else F.col(c) for c, kind in stream.dtypes]
    dealt = stream.withColumn("__run", _run_key(stream, by)).select(*filled, "__run", *[F.col(c).isNull().alias(x) for c, x in null.items()], F.pmod(F.xxhash64("__run"), F.lit(buckets)).alias("__bucket"))
    flags = "".join(f", `{n}` boolean" for n in null.values())
    out = dealt.groupBy("__bucket").transformWithStateInPandas(Guard(), schema.removesuffix(f", {GUARDED}") + flags + f", {GUARDED}", "append", "none")
    return out.select(*[F.when(~F.col(null[c]), F.col(c)).alias(c) if c in null else c for c in names], "calls", "streak", "mark")


def write_complete(counts: DataFrame, path: str, checkpoint: str):
    """Starts a query over an aggregate whose whole result replaces the one before, after each micro-batch."""

    def write(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query whose micro-batches go to folders by their number, each overwritten when its batch is done again.

    A batch that was cut off is repeated with the same number after a restart, so no row is lost or doubled. Readers see
    nothing (`read_batches`) before `commit_run`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_run(spark: SparkSession, path: str) -> None:
    """The footer that makes a run's batches a whole: number of rows. A second one is an error."""
    rows = spark.read.parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("n_items")).write.mode("errorifexists").json(f"{path}/footer")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a committed run; an uncommitted one, or one that has grown since, is refused."""
    footer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/footer")
    if not footer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(footer):
        raise ValueError(f"{path} has no footer: the run isn't complete")
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if rows.count() != spark.read.schema("n_items long").json(f"{path}/footer").first().n_items:
        raise ValueError(f"{path} holds other rows than its footer tells")
    return rows
