"""Metrics as aggregates over a term table.

The term table has one row per item: what every metric needs, computed once. All metrics but AUROC are sums of terms, so
one aggregation per grouping gives them all, weighted or not: `sums` lists the partial sums and `values` turns them into
metrics. Grouping columns (gauge, split, resample) are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators.ranks import running_sum

#: Bins of the calibration error, points of the risk-coverage curve.
BINS, CURVE_POINTS = 15, 50


def term_table(items: DataFrame, k: int = 3, temperature: Column | float = 1.0, taus: list[float] | None = None, bins: int = BINS) -> DataFrame:
    """items (y, logits) with p, pred, conf, correct, nll, bin and answered."""
    out = items.withColumn("p", V.softmax(F.col("logits"), k, temperature))
    out = out.withColumns({"pred": V.argmax(F.col("p")), "conf": V.confidence(F.col("p")), "nll": V.nll_term(V.pick(F.col("p"), F.col("y")))})
    known = {"correct": F.col("pred") == F.col("y"), "bin": V.bin_of(F.col("conf"), bins)}
    known["answered"] = V.answered(F.col("conf"), F.col("pred"), taus) if taus else F.lit(True)
    return out.withColumns(known)


def contributions(k: int = 3, bins: int = BINS) -> dict[str, Column]:
    """What one item adds to each sum."""
    n = lambda c: c.cast("long")
    out = {"n": F.lit(1), "n_correct": n(F.col("correct")), "s_nll": F.col("nll"), "n_answered": n(F.col("answered")), "n_right": n(F.col("answered") & F.col("correct"))}
    out |= {f"gold_{c}": n(F.col("y") == c) for c in range(k)} | {f"pred_{c}": n(F.col("pred") == c) for c in range(k)} | {f"both_{c}": n((F.col("y") == c) & (F.col("pred") == c)) for c in range(k)}
    return out | {f"gap_{b}": F.when(F.col("bin") == b, n(F.col("correct")) - F.col("conf")).otherwise(0.0) for b in range(bins)}


def sums(k: int = 3, bins: int = BINS, weight: Column | None = None) -> list[Column]:
    """Partial sums over a group; `weight` counts an item more than once."""
    w = weight if weight is not None else F.lit(1)
    return [F.coalesce(F.sum(w * x), F.lit(0)).alias(name) for name, x in contributions(k, bins).items()]


def values(k: int = 3, bins: int = BINS) -> dict[str, Column]:
    """Metrics from the sums. Macro-F1 counts a class that never occurs as 0; selective accuracy is null if nothing is answered."""
    n = F.col("n")
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"both_{c}"), F.col(f"gold_{c}") + F.col(f"pred_{c}")), F.lit(0.0)) for c in range(k)]
    ece = sum((F.abs(F.col(f"gap_{b}")) for b in range(bins)), F.lit(0.0))
    return {
        "accuracy": F.try_divide(F.col("n_correct"), n).cast("double"),
        "macro_f1": sum(f1, F.lit(0.0)) / k,
        "nll": F.try_divide(F.col("s_nll"), n),
        "ece": F.try_divide(ece, n),
        "ask_rate": 1 - F.try_divide(F.col("n_answered"), n).cast("double"),
        "selective_accuracy": F.try_divide(F.col("n_right"), F.col("n_answered")).cast("double"),
    }


def metrics(terms: DataFrame, by: list[str], k: int = 3, bins: int = BINS, weight: Column | None = None) -> DataFrame:
    return terms.groupBy(*by).agg(*sums(k, bins, weight)).select(*by, "n", *[c.alias(name) for name, c in values(k, bins).items()])


def without_thresholds(terms: DataFrame, by: list[str], k: int = 3, bins: int = BINS, has_confidence: bool = True) -> DataFrame:
    """Metrics of gauges that have no thresholds: ask rate and selective accuracy are null, with the reason in `na`.

    Without a confidence NLL and ECE are null as well.
    """
    gone = ["ask_rate", "selective_accuracy"] + ([] if has_confidence else ["nll", "ece"])
    out = metrics(terms, by, k, bins).withColumns({name: F.lit(None).cast("double") for name in gone})
    return out.withColumn("na", F.lit("no thresholds" if has_confidence else "no thresholds, no confidence"))


def input_faults(items: DataFrame, key: str, y: str, vector: str, k: int = 3) -> DataFrame:
    """Items unfit for metrics, with the first fault of each: no class in range, no vector of k numbers. An empty table is one fault of its own."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf")))
    fault = F.when(F.col(y).isNull() | ~F.col(y).between(0, k - 1), "class").when(F.col(vector).isNull() | (F.size(vector) != k), "shape").when(~numbers, "number")
    rows = items.select(F.col(key).cast("string").alias("key"), fault.alias("fault")).where("fault IS NOT NULL")
    return rows.union(items.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string"), F.lit("empty")))


def confusion(terms: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Dense counts: gold, pred, n, with 0 where a pair never occurs."""
    counted = terms.groupBy(*by, F.col("y").alias("gold"), "pred").agg(F.count("*").alias("found"))
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    grid = counted.select(*by).distinct().withColumn("gold", F.explode(classes)).withColumn("pred", F.explode(classes))
    return grid.join(counted, [*by, "gold", "pred"], "left").select(*by, "gold", "pred", F.coalesce("found", F.lit(0)).alias("n"))


def reliability(terms: DataFrame, by: list[str]) -> DataFrame:
    """Per occupied bin: items, mean confidence and accuracy."""
    return terms.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def auroc(terms: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Rank statistic of confidence for correctness, ties at mid-rank; null if all or none are correct.

    Equal confidences are added up first, and distinct ones are ranked range by range. With integer weights an item
    counts that many times.
    """
    w = weight if weight is not None else F.lit(1)
    tied = terms.groupBy(*by, "conf").agg(F.sum(w).alias("w"), F.sum(F.when(F.col("correct"), w).otherwise(0)).alias("right"))
    summed = running_sum(tied, by, [F.col("conf")], F.col("w"), "upto")
    ranked = summed.withColumn("rank", F.col("upto") - F.col("w") + (F.col("w") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("right")).alias("ranks"), F.sum("right").alias("pos"), F.sum("w").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return out.select(*by, F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auroc"))


def curve_taus(points: int = CURVE_POINTS) -> list[float]:
    import numpy as np

    return [float(t) for t in np.linspace(1.0 / 3.0, 1.0, points)]


def threshold_counts(terms: DataFrame, by: list[str], taus: list[float]) -> DataFrame:
    """For each threshold: items answered (conf >= tau) and answered right.

    Each item is counted once, at the highest threshold it reaches; a cumulative sum over the thresholds does the rest.
    """
    grid = F.array(*[F.lit(t) for t in taus])
    reached = F.coalesce(F.size(F.filter(grid, lambda t: t <= F.col("conf"))), F.lit(0))
    counted = terms.groupBy(*by, reached.alias("reached")).agg(F.count("*").alias("c"), F.sum(F.col("correct").cast("long")).alias("r"))
    # one row a group from here on, so that the items are read once
    groups = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.collect_list(F.struct("reached", "c", "r")).alias("cells"))
    steps = groups.select(*by, "n", "cells", F.posexplode(grid).alias("place", "tau"))

    def above(name: str) -> Column:
        return F.aggregate(F.filter("cells", lambda x: x["reached"] > F.col("place")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[name], F.lit(0)))

    return steps.select(*by, "tau", "n", above("c").alias("n_answered"), above("r").alias("n_right"))


def risk_coverage(terms: DataFrame, by: list[str], points: int = CURVE_POINTS) -> DataFrame:
    counts = threshold_counts(terms, by, curve_taus(points))
    return counts.select(*by, "tau", (1 - F.col("n_answered") / F.col("n")).alias("ask_rate"), F.try_divide("n_right", "n_answered").cast("double").alias("selective_accuracy"), "n_answered")


def letter_bias(items: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Mean difference between the first reading and the mean of all, per class; only if every item has two or more readings."""
    ready = items.select(*by, "readings", V.mean_of_vectors(F.col("readings"), k).alias("mean"))
    diffs = [F.avg(F.get(F.get("readings", F.lit(0)), F.lit(c)) - F.get("mean", F.lit(c))).alias(f"d{c}") for c in range(k)]
    wide = ready.groupBy(*by).agg(F.min(F.size("readings")).alias("least"), *diffs).where("least >= 2")
    return wide.select(*by, F.posexplode(F.array(*[f"d{c}" for c in range(k)])).alias("class", "bias"))


def latency(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Median, 90th percentile (linear interpolation) and mean."""
    q = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.9)))
    return rows.groupBy(*by).agg(q.alias("q"), F.avg(seconds).alias("mean"), F.count(seconds).alias("n")).select(*by, F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"), "mean", "n")
