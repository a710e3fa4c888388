"""Verification by doing again: refits of stored out-of-fold scores, stored cells against cells made anew, tampering."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.operators import probe

#: Largest gap of scores that passes, and that warns.
PASS_GAP, WARN_GAP = 0.05, 0.5


def score_gap(a: Column, b: Column) -> Column:
    """Largest difference of two score vectors, each less its mean: scores are equal up to a shift of all classes."""
    centred = lambda v: F.transform(v, lambda x: x - F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v))
    gaps = F.zip_with(centred(a), centred(b), lambda x, y: F.abs(x - y))
    return F.when(F.size(a) == F.size(b), F.array_max(gaps))


def flag_faults(items: DataFrame, key: str = "id") -> DataFrame:
    """Items whose flags don't fit their split: fit items need oof and a fold, exam items must not be oof."""
    fault = F.when((F.col("split") == "fit") & ~F.coalesce("oof", F.lit(False)), "fit item not out of fold").when((F.col("split") == "fit") & F.col("fold").isNull(), "fit item without fold")
    fault = fault.when((F.col("split") == "exam") & F.coalesce("oof", F.lit(True)), "exam item out of fold").when(~F.coalesce(F.col("split").isin("fit", "exam"), F.lit(False)), "no split")
    return items.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def refitted(rows: DataFrame, c: float, parallelism: int = 4) -> DataFrame:
    """rows (y, features, fold) with `oof`, the scores of a model that didn't see the row's fold, and `seen`, of one that did.

    The fits are independent jobs and run side by side; each is a distributed fit over all rows but its fold's.
    """
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())

    def model(fold):
        return probe.fit(rows if fold is None else rows.where(F.col("fold") != fold), c)

    with ThreadPoolExecutor(parallelism) as pool:
        models = dict(zip([None, *folds], pool.map(inheritable_thread_target(rows.sparkSession)(model), [None, *folds])))
    out = None
    for fold in folds:
        part = probe.logits(models[fold], rows.where(F.col("fold") == fold)).withColumnRenamed("logits", "oof")
        part = probe.logits(models[None], part).withColumnRenamed("logits", "seen")
        out = part if out is None else out.unionByName(part)
    return out


def verify_out_of_fold(rows: DataFrame, c: float, stored: str = "stored", pass_gap: float = PASS_GAP, warn_gap: float = WARN_GAP) -> DataFrame:
    """fold, n, gap, seen_gap, status. rows: y, features, fold and the stored scores.

    A fold's scores pass if a refit without the fold gives them again up to `pass_gap`, warn up to `warn_gap`, and fail
    beyond, and whenever the scores of a model that saw the fold are no further away: then they aren't out of fold. A row
    without stored scores, or with others than the model's number of classes, fails its fold.
    """
    again = refitted(rows.withColumnRenamed(stored, "__stored"), c)
    gaps = again.select("fold", score_gap(F.col("oof"), F.col("__stored")).alias("gap"), score_gap(F.col("seen"), F.col("__stored")).alias("seen"))
    each = gaps.groupBy("fold").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.max("seen").alias("seen_gap"), F.count_if(F.col("gap").isNull()).alias("missing"))
    status = F.when((F.col("missing") > 0) | (F.col("gap") >= F.col("seen_gap")), "FAIL").when(F.col("gap") <= pass_gap, "PASS").when(F.col("gap") <= warn_gap, "WARN").otherwise("FAIL")
    return each.select("fold", "n", "gap", "seen_gap", status.alias("status"))


def differing_cells(stored: DataFrame, made: DataFrame, keys: list[str], value: str, places: int | None = None) -> DataFrame:
    """keys, stored, made, fault of each cell that isn't the same on both sides, nulls included.

    missing: only made; extra: only stored; repeated: stored more than once; differs: another value (after rounding).
    """
    shown = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    a = stored.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(shown(F.col(value))).alias("stored"))
    b = made.groupBy(*keys).agg(F.lit(1).alias("__m"), F.max(shown(F.col(value))).alias("made"))
    b = b.select(*[F.col(k).alias(f"__key_{k}") for k in keys], "__m", "made")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = a.join(b, same, "full")
    fault = F.when(F.col("__n").isNull(), "missing").when(F.col("__m").isNull(), "extra").when(F.col("__n") > 1, "repeated").when(~F.col("stored").eqNullSafe(F.col("made")), "differs")
    there = [F.when(F.col("__n").isNull(), F.col(f"__key_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.select(*there, "stored", "made", fault.alias("fault")).where("fault IS NOT NULL")


def run_faults(run: DataFrame, expected: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """fault, n of a run file's items (key, order, split) against the ids it was to read (key, order).

    A run reads each expected item once and in order: counts of missing, extra, repeated and displaced items, and of items
    that aren't of the exam split. No row: the run is whole.
    """
    have = run.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("__at"))
    want = expected.select(key, F.col(order).alias("__want"))
    both = have.join(want, key, "full")
    counts = both.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("__want").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("__at") != F.col("__want")).alias("displaced")
    )
    split = run.agg(F.count_if(~F.col("split").eqNullSafe(F.lit("exam"))).alias("no exam item"))
    names = ["missing", "extra", "repeated", "displaced"]
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("fault"), F.col(x).alias("n")) for x in names])))
    return rows.union(split.select(F.lit("no exam item"), "no exam item")).where("n > 0")
