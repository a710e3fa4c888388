"""Temperature and abstention thresholds from a fit split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators import metrics as M

SA_TARGET, EPSILON, FLAT = 0.95, 1e-12, 1e-12
T_LOW, T_HIGH, T_POINTS = 0.05, 10.0, 200
ABSTAIN = 1.01


def temperature_grid(points: int = T_POINTS, low: float = T_LOW, high: float = T_HIGH) -> list[float]:
    import numpy as np

    return [float(t) for t in np.geomspace(low, high, points)]


def tau_grid() -> list[float]:
    """0.34 to 0.99 in steps of 0.01, as the doubles nearest to the decimals."""
    return [(34 + i) / 100 for i in range(66)]


def nll_by_temperature(items: DataFrame, by: list[str], grid: list[float], k: int = 3) -> DataFrame:
    """Mean NLL for each temperature of a grid, in one pass: one sum per temperature, then unpivoted."""
    z = V.elements(F.col("logits"), k)
    top, own = F.greatest(*z), F.get("logits", F.col("y"))
    ready = items.select(*by, *[(x - top).alias(f"z{i}") for i, x in enumerate(z)], (own - top).alias("zy"))

    def term(t: float) -> str:
        total = " + ".join(f"exp(z{i} / {t!r}D)" for i in range(k))
        return f"avg(-ln(greatest(least(exp(zy / {t!r}D) / ({total}), 1D), {V.FLOOR!r}D)))"

    wide = ready.groupBy(*by).agg(*[F.expr(term(t)).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = ", ".join(f"named_struct('place', {i}, 'temperature', {t!r}D, 'nll', t{i})" for i, t in enumerate(grid))
    return wide.select(*by, F.explode(F.expr(f"array({pairs})")).alias("x")).select(*by, "x.*")


def fit_temperature(items: DataFrame, k: int = 3, rounds: int = 5, points: int = T_POINTS) -> dict:
    """Temperature that minimises NLL: a log grid, then finer grids between the neighbours of the minimum.

    A flat surface gives 1. Only a grid of sums reaches the driver.
    """
    grid = temperature_grid(points)
    found = sorted((r.place, r.nll) for r in nll_by_temperature(items, [], grid, k).collect())
    surface = [x for _, x in found]
    if not surface or surface[0] is None:
        raise ValueError("no items to fit a temperature on")
    at = min(range(len(surface)), key=lambda i: (surface[i], i))
    if max(surface) - min(surface) <= FLAT:
        return {"T": 1.0, "nll": surface[at], "method": "flat"}
    best, low, high = (surface[at], grid[at]), grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    for _ in range(rounds):
        fine = [low + (high - low) * i / 20 for i in range(21)]
        values = [x for _, x in sorted((r.place, r.nll) for r in nll_by_temperature(items, [], fine, k).collect())]
        i = min(range(21), key=lambda j: (values[j], j))
        best = min(best, (values[i], fine[i]))
        low, high = fine[max(i - 1, 0)], fine[min(i + 1, 20)]
    return {"T": best[1], "nll": best[0], "method": "grid+refine" if best[1] != grid[at] else "grid"}


def class_threshold_table(terms: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Answered and right counts for each predicted class and threshold: at most k * 66 rows a group."""
    counted = M.threshold_counts(terms.withColumn("class", F.col("pred")), [*by, "class"], tau_grid())
    return counted.select(*by, "class", "tau", "n_answered", "n_right")


def global_threshold(terms: DataFrame, by: list[str], target: float = SA_TARGET) -> DataFrame:
    """Smallest threshold whose selective accuracy reaches the target; null if none does."""
    counts = M.threshold_counts(terms, by, tau_grid())
    meets = (F.col("n_answered") > 0) & (F.try_divide("n_right", "n_answered") + EPSILON >= target)
    return counts.groupBy(*by).agg(F.min(F.when(meets, F.col("tau"))).alias("tau_global"))


def descend(table: dict[int, dict[float, tuple[int, int]]], target: float = SA_TARGET) -> list[float] | None:
    """Per-class thresholds from (class -> tau -> (answered, right)), by coordinate descent from the global one."""
    grid = tau_grid()

    def meets(taus: list[float]) -> bool:
        cells = [table.get(c, {}).get(t, (0, 0)) for c, t in enumerate(taus)]
        n = sum(a for a, _ in cells)
        return n > 0 and sum(r for _, r in cells) / n + EPSILON >= target

    k = max(table, default=-1) + 1
    start = next((t for t in grid if meets([t] * k)), None)
    if start is None:
        return None
    places = [grid.index(start)] * k
    before = None
    while before != places:
        before = list(places)
        for c in range(k):
            while places[c] and meets([grid[p - (i == c)] for i, p in enumerate(places)]):
                places[c] -= 1
    return [grid[p] for p in places]


def fit_thresholds(terms: DataFrame, k: int = 3, target: float = SA_TARGET) -> dict:
    """tau_global, taus and whether the target is reachable; the descent runs on the table of class counts."""
    return thresholds_of(class_threshold_table(terms, [], k).collect(), k, target)


def thresholds_of(rows: list[Row], k: int = 3, target: float = SA_TARGET) -> dict:
    """`fit_thresholds` from the rows of one group's class counts."""
    table: dict[int, dict[float, tuple[int, int]]] = {c: {} for c in range(k)}
    for r in rows:
        table[r["class"]][r.tau] = (r.n_answered, r.n_right)
    start = next((t for t in tau_grid() if sum(table[c].get(t, (0, 0))[0] for c in range(k)) and sum(table[c].get(t, (0, 0))[1] for c in range(k)) / sum(table[c].get(t, (0, 0))[0] for c in range(k)) + EPSILON >= target), None)
    taus = descend(table, target)
    return {"tau_global": start, "taus": taus or [ABSTAIN] * k, "target_reachable": taus is not None}


def best_threshold(terms: DataFrame, by: list[str]) -> DataFrame:
    """Fallback: the threshold with the best selective accuracy, the smallest of equals."""
    return best_of(M.threshold_counts(terms, by, tau_grid()), by)


def best_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """`best_threshold` from counts (by, tau, n_answered, n_right)."""
    counts = counts.where("n_answered > 0").withColumn("sa", F.col("n_right") / F.col("n_answered"))
    first = Window.partitionBy(*by).orderBy(F.round("sa", 12).desc(), "tau")
    return counts.withColumn("place", F.row_number().over(first)).where("place = 1").select(*by, "tau", "sa")


def calibrate(items: DataFrame, k: int = 3, target: float = SA_TARGET, constant: bool = False) -> dict:
    """A calibration record of one gauge from its fit rows; a constant gauge keeps temperature 1."""
    temperature = {"T": 1.0, "method": "fixed"} if constant else fit_temperature(items, k)
    terms = M.term_table(items, k, temperature["T"]).cache()
    record = temperature | fit_thresholds(terms, k, target)
    raw = M.metrics(M.term_table(items, k, 1.0, record["taus"]), [], k).first()
    calibrated = M.metrics(M.term_table(items, k, temperature["T"], record["taus"]), [], k).first()
    terms.unpersist()
    fit = {"nll_raw": raw.nll, "nll_cal": calibrated.nll, "ece_raw": raw.ece, "ece_cal": calibrated.ece, "accuracy": calibrated.accuracy, "ask_rate": calibrated.ask_rate, "selective_accuracy": calibrated.selective_accuracy}
    return record | {"n_fit": calibrated.n, "sa_target": target, "fit": {name: None if x is None or math.isnan(x) else round(x, 4) for name, x in fit.items()}}


def external_record(n_fit: int = 0, target: float = SA_TARGET) -> dict:
    """A gauge without raw scores: temperature 1 and no thresholds."""
    return {"T": 1.0, "method": "fixed", "tau_global": None, "taus": None, "n_fit": n_fit, "sa_target": target}


def changed_keys(stored: dict, derived: dict) -> list[str]:
    """Keys of a stored record that a new derivation doesn't reproduce; keys it lacks may be added."""
    return sorted(key for key, x in stored.items() if key in derived and derived[key] != x)
