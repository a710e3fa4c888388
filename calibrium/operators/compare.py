"""Comparisons of gauges: within noise, paired differences, share of a gap, the same items for all, how many labels are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.operators import bootstrap as B


def within_noise(cells: DataFrame, key: str = "gauge", by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals overlap. cells: key, lo, hi: one row per gauge (and group), so the join stays small."""
    by = by or []
    a = cells.select(*by, F.col(key).alias("left_key"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = cells.select(*by, F.col(key).alias("right_key"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    meet = (F.col("left_key") != F.col("right_key")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    joined = a.join(b, by) if by else a.join(b, meet)
    return joined.where(meet).select(*by, "left_key", "right_key")


def paired_difference(per_resample: DataFrame, whole: DataFrame, first: str, second: str, metric: str, by: list[str] | None = None) -> DataFrame:
    """first - second of one metric, its interval over the shared resamples, and whether the interval leaves 0 out."""
    by = by or []
    pick = lambda df, gauge, name, keys: df.where(F.col("gauge") == gauge).select(*keys, F.col(metric).alias(name))
    both = pick(per_resample, first, "x", [*by, "b"]).join(pick(per_resample, second, "y", [*by, "b"]), [*by, "b"]).withColumn("difference", F.col("x") - F.col("y"))
    ci = B.intervals(both, by, ["difference"]).drop("metric")
    x, y = pick(whole, first, "x", by), pick(whole, second, "y", by)
    value = (x.join(y, by) if by else x.join(y)).select(*by, (F.col("x") - F.col("y")).alias("value"))
    joined = value.join(ci, by) if by else value.join(ci)
    verdict = F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), "within noise").otherwise("different")
    return joined.select(*by, F.round("value", 4).alias("value"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n_boot_used", verdict.alias("verdict"))


def share_of_gap(per_resample: DataFrame, whole: DataFrame, low: str, mid: str, high: str, metric: str, by: list[str]) -> DataFrame:
    """(high - mid) / (high - low) of one metric. Undefined unless the interval of the denominator lies above 0."""

    def wide(df: DataFrame, keys: list[str]) -> DataFrame:
        pick = lambda gauge: F.max(F.when(F.col("gauge") == gauge, F.col(metric)))
        cols = df.groupBy(*keys).agg(pick(low).alias("l"), pick(mid).alias("m"), pick(high).alias("h"))
        return cols.select(*keys, (F.col("h") - F.col("m")).alias("part"), (F.col("h") - F.col("l")).alias("whole")).withColumn("share", F.when(F.col("whole") != 0, F.try_divide("part", "whole")))

    ci = B.intervals(wide(per_resample, [*by, "b"]), by, ["whole", "share"])
    pick = lambda metric_name, column: F.max(F.when(F.col("metric") == metric_name, F.col(column)))
    ci = ci.groupBy(*by).agg(pick("whole", "lo").alias("whole_lo"), pick("share", "lo").alias("lo"), pick("share", "hi").alias("hi"))
    out = wide(whole, by).join(ci, by)
    defined = F.coalesce(F.col("whole_lo") > 0, F.lit(False))
    four = lambda c: F.round(F.when(defined, F.col(c)), 4).alias(c)
    return out.select(*by, defined.alias("defined"), F.round("part", 4).alias("part"), F.round("whole", 4).alias("whole"), four("share"), four("lo"), four("hi"))


def like_for_like(gauges: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of all gauges for the items that every gauge has: semi joins on the key, then a union."""
    out = None
    for g in gauges:
        kept = g
        for other in gauges:
            if other is not g:
                kept = kept.join(other.select(*by).distinct(), by, "left_semi")
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


def labels_needed(draws: DataFrame, reference_hi: float, target: float) -> DataFrame:
    """Per training size: mean, least and most of the draws' metric, whether its lower bound meets the reference, draws that reach the target.

    draws: n, k, value, lo.
    """
    return draws.groupBy("n").agg(
        F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n_draws"),
        F.count_if(F.col("value") + 1e-12 >= target).alias("reach_target"), (F.avg("lo") <= reference_hi).alias("qualifies"),
    )
