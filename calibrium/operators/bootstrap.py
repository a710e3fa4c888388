"""Paired percentile bootstrap as one weighted aggregation per resample.

A resample is a weight per item (how often it was drawn), the same for every metric and gauge, so pairs stay paired.
Three ways to draw:

* hash: index = first 32 bits of md5("b:j") modulo n; any SQL engine can repeat it.
* parity: numpy's PCG64 generator, as one stream of draws from one seed; draws come from the driver (n_boot * n ints).
* poisson: each item's weight is Poisson(1), from a hash of item and resample. Nothing is drawn by index, so it needs no
  count of items and no order, and it is the way for large tables: one pass and n_boot rows per group and task.

Both `hash` and `poisson` come in blocks (`hash_block_metrics`, `poisson_block_metrics`): a matrix of weights, resamples by
items, times the matrix of what each item adds to the sums, so that a row per item and resample never exists. Resamples
are taken `CHUNK` at a time, so memory doesn't grow with their number. The exploded forms give the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrium.operators import metrics as M

#: Resamples, seed and level of an interval.
N_BOOT, SEED, CI = 1000, 20261007, 0.95
#: Resamples that are worked on at once; items that draws by index may have.
CHUNK, BLOCK_ITEMS = 128, 1 << 19
#: Draws that a task makes or counts.
DRAWS_A_TASK = 1_000_000


def hash_draws(spark: SparkSession, n: int, n_boot: int = N_BOOT) -> DataFrame:
    """(b, ord, w): how often each place is drawn in each resample.

    Whole resamples are dealt to as many tasks as it takes for each to make and count about DRAWS_A_TASK. Where one resample
    has more, its draws are numbered and both made and counted in parts.
    """
    if n <= DRAWS_A_TASK:
        resamples = spark.range(0, n_boot, 1, -(-n_boot // max(1, DRAWS_A_TASK // n)))
        draws, tasks = resamples.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")), None
    else:
        tasks = n_boot * n // DRAWS_A_TASK + 1
        draws = spark.range(0, n_boot * n, 1, tasks).select(F.expr(f"id div {n}").alias("b"), (F.col("id") % n).alias("j"))
    digest = F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("j").cast("string")).cast("binary"))
    index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n
    drawn = draws.select("b", index.alias("ord"))
    return (drawn.repartition(tasks, "b", "ord") if tasks else drawn).groupBy("b", "ord").agg(F.count("*").alias("w"))


def parity_draws(spark: SparkSession, n: int, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Draws of numpy's default generator, in its order."""
    import numpy as np

    stream = np.random.default_rng(seed)
    rows = []
    for b in range(n_boot):
        places, times = np.unique(stream.integers(0, n, n), return_counts=True)
        rows += [(b, int(p), int(t)) for p, t in zip(places, times)]
    return spark.createDataFrame(rows, "b long, ord long, w long")


def poisson_weight(item: Column, b: Column, most: int = 8) -> Column:
    """Poisson(1) weight of an item in a resample, by inversion of a hashed uniform."""
    u = F.shiftrightunsigned(F.xxhash64(b.cast("long"), item), 11) / F.lit(float(1 << 53))
    total, out = 0.0, F.lit(0)
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= total, 1).otherwise(0)
    return out.cast("long")


def poisson_draws(items: DataFrame, key: str, n_boot: int = N_BOOT) -> DataFrame:
    """items with a row for each resample that draws them, and their weight w."""
    spread = items.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("w", poisson_weight(F.col(key), F.col("b")))
    return spread.where("w > 0")


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers, over arrays. The five primes of XXH64."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = (seed + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def poisson_weights(items: np.ndarray, resamples: np.ndarray, most: int = 8) -> np.ndarray:
    """`poisson_weight` of 64-bit items, resamples by items."""
    with np.errstate(over="ignore"):
        h = _hash_long(items.astype(np.uint64)[None, :], _hash_long(resamples.astype(np.uint64), np.uint64(42))[:, None])
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    return np.searchsorted(steps, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def _summed(found: dict, by: list[str], kinds: list, names: list[str]) -> pa.RecordBatch:
    """Rows of by, b and the sums. found: sums, resamples by names, for each group."""
    groups = list(found)
    n = [len(found[g]) for g in groups]
    columns = [pa.array([v for g, m in zip(groups, n) for v in [g[i]] * m], kind) for i, kind in enumerate(kinds)]
    columns.append(pa.array([b for m in n for b in range(m)], pa.int64()))
    every = np.concatenate([found[g] for g in groups]) if groups else np.zeros((0, len(names)))
    return pa.RecordBatch.from_arrays(columns + [pa.array(every[:, i]) for i in range(len(names))], names=[*by, "b", *names])


def _from_sums(sums: DataFrame, by: list[str], k: int) -> DataFrame:
    n = F.col("n").cast("long").alias("n")
    return sums.where("n > 0").select(*by, "b", n, *[c.alias(name) for name, c in M.values(k).items()])


def poisson_block_metrics(terms: DataFrame, key: str, by: list[str], n_boot: int = N_BOOT, k: int = 3) -> DataFrame:
    """Metrics per group and resample with Poisson weights of `key` (long); rows of a task meet as one matrix per batch."""
    parts = M.contributions(k)
    names = list(parts)
    rows = terms.select(*by, F.col(key).cast("long").alias("__key"), *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for name, x in parts.items()])
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "b long", *(f"{x} double" for x in names)])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(by))]
            groups: dict[tuple, list[int]] = {}
            for place, group in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(by)))) if by else [()] * batch.num_rows):
                groups.setdefault(group, []).append(place)
            items = batch.column(len(by)).to_numpy()
            matrix = np.stack([batch.column(len(by) + 1 + i).to_numpy() for i in range(len(names))], axis=1)
            for group, places in groups.items():
                total = found.setdefault(group, np.zeros((n_boot, len(names))))
                for at in range(0, n_boot, CHUNK):
                    b = np.arange(at, min(n_boot, at + CHUNK))
                    total[at : at + CHUNK] += poisson_weights(items[places], b) @ matrix[places]
        if found:
            yield _summed(found, by, kinds, names)

    per_task = rows.mapInArrow(sum_up, schema)
    return _from_sums(per_task.groupBy(*by, "b").agg(*[F.sum(x).alias(x) for x in names]), by, k)


def hash_block_metrics(terms: DataFrame, by: list[str], n_boot: int = N_BOOT, k: int = 3) -> DataFrame:
    """`resampled_metrics` of `hash_draws`: resamples are dealt to tasks, the items' terms are broadcast.

    terms: ord is the item's place, from 0, in every group. A draw by index needs all items at hand, so there is a bound,
    `BLOCK_ITEMS` rows, beyond which this raises: larger tables take Poisson weights.
    """
    spark, parts = terms.sparkSession, M.contributions(k)
    names = list(parts)
    rows = terms.select(*by, "ord", *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for name, x in parts.items()])
    if rows.limit(BLOCK_ITEMS + 1).count() > BLOCK_ITEMS:
        raise ValueError(f"more than {BLOCK_ITEMS} items: use poisson_block_metrics")
    table = rows.toArrow()
    places: dict[tuple, list[int]] = {}
    for i, group in enumerate(zip(*(table[c].to_pylist() for c in by)) if by else [()] * table.num_rows):
        places.setdefault(group, []).append(i)
    matrix, order = np.stack([table[x].to_numpy() for x in names], axis=1), table["ord"].to_numpy()
    shared = spark.sparkContext.broadcast({g: matrix[np.array(at)[np.argsort(order[at])]] for g, at in places.items()})
    kinds = [table.schema.field(c).type for c in by]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "b long", *(f"{x} double" for x in names)])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in batches:
            out: dict[str, list] = {x: [] for x in [*by, "b", *names]}
            for b in batch.column(0).to_pylist():
                most = max((len(m) for m in groups.values()), default=0)
                drawn = np.array([int.from_bytes(hashlib.md5(f"{b}:{j}".encode()).digest()[:4], "big") for j in range(most)], np.int64)
                for group, m in groups.items():
                    total = np.bincount(drawn[: len(m)] % len(m), minlength=len(m)) @ m
                    for name, value in zip(out, (*group, b, *total.tolist())):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [*kinds, pa.int64(), *[pa.float64()] * len(names)])], names=list(out))

    tasks = spark.range(0, n_boot, 1, max(1, min(n_boot // 16, 4 * spark.sparkContext.defaultParallelism)))
    return _from_sums(tasks.mapInArrow(draw, schema), by, k)


def resampled_metrics(terms: DataFrame, draws: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """A row of metrics per group and resample. terms: ord is the item's place, from 0, in every group."""
    return M.metrics(terms.join(draws, "ord"), [*by, "b"], k, weight=F.col("w"))


def intervals(per_resample: DataFrame, by: list[str], names: list[str], level: float = CI) -> DataFrame:
    """Long table: metric, lo, hi, n_boot_used. Undefined resamples (nulls) are skipped; fewer than two give no interval."""
    tail = (1 - level) / 2
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])
    long = per_resample.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.x")
    q = F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail)))
    out = long.groupBy(*by, "metric").agg(q.alias("q"), F.count("x").alias("n_boot_used"))
    some = F.col("n_boot_used") >= 2
    return out.select(*by, "metric", F.when(some, F.get("q", F.lit(0))).alias("lo"), F.when(some, F.get("q", F.lit(1))).alias("hi"), "n_boot_used")


def bootstrap(terms: DataFrame, draws: DataFrame, by: list[str], names: list[str], k: int = 3, level: float = CI) -> DataFrame:
    """metric, value (of the whole sample), lo, hi, n_boot_used, to four places."""
    whole = M.metrics(terms, by, k)
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    value = whole.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.value")
    found = value.join(intervals(resampled_metrics(terms, draws, by, k), by, names, level), [*by, "metric"], "left")
    four = lambda c: F.round(c, 4).alias(c)
    return found.select(*by, "metric", four("value"), four("lo"), four("hi"), F.coalesce("n_boot_used", F.lit(0)).alias("n_boot_used"))
