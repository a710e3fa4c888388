"""Gauges: sources of one probability vector per item. Constant baselines, JSON emissions, outside answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.functions import vectors as V
from calibrium.operators import calibration as C
from calibrium.sources.files import held

RETRY, FAIL, ABORT = [408, 409, 425, 429, 500, 502, 503, 504], [400, 404, 413, 422], [401, 402, 403]


def uniform(items: DataFrame, k: int = 3) -> DataFrame:
    return items.withColumn("logits", F.array(*[F.lit(0.0)] * k))


def majority_vector(items: DataFrame, winner: Column, k: int = 3) -> DataFrame:
    """0 for the majority class, -40 for the others."""
    return items.withColumn("logits", F.array(*[F.when(winner == c, 0.0).otherwise(-40.0) for c in range(k)]))


def emissions(rows: DataFrame, text: str = "raw", k: int = 3) -> DataFrame:
    """rows with decision index (-1 on failure), confidence and the score matrix p: the confidence at the decision."""
    out = rows.withColumn("parsed", X.parsed_emission(F.col(text)))
    known = F.array(*[F.lit(x) for x in V.LABELS])
    out = out.withColumns({"decision": F.coalesce(F.array_position(known, F.col("parsed.decision")) - 1, F.lit(-1)).cast("int"), "confidence": F.coalesce("parsed.confidence", F.lit(0.0))})
    return out.withColumn("p", V.one_hot(F.col("decision"), F.col("confidence"), k))


def emission_terms(rows: DataFrame, taus: list[float] | None = None) -> DataFrame:
    """A term table of emissions for the abstention operators; a failed parse has confidence 0 and is never answered."""
    out = rows.withColumns({"pred": F.greatest("decision", F.lit(0)), "conf": F.col("confidence"), "correct": F.col("decision") == F.col("y")})
    return out.withColumn("answered", V.answered(F.col("conf"), F.col("pred"), taus) if taus else F.lit(True))


def emission_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Trust accuracy (a failed parse is wrong), failures by reason and certain answers."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("decision") == F.col("y")).cast("double")).alias("trust_accuracy"), F.count_if(F.col("decision") < 0).alias("n_failed"),
        F.count_if(F.col("confidence") == 1.0).alias("n_certain"), *[F.count_if(F.col("decision") == c).alias(f"n_decision_{c}") for c in range(3)],
    )


def emission_gate(rows: DataFrame, k: int = 3, target: float = C.SA_TARGET) -> dict:
    """Per-class thresholds at the target, or one threshold with the best selective accuracy."""
    return emission_gates(rows, [], [target], k)[(), target] if rows.limit(1).count() else {"tau_global": None, "taus": [C.ABSTAIN] * k, "target_reachable": False, "mode": "fallback"}


def emission_gates(rows: DataFrame, by: list[str], targets: list[float], k: int = 3) -> dict[tuple, dict]:
    """`emission_gate` of every group and target, as (group, target) -> record. Texts are read once: the counts of classes
    and thresholds, at most k * 66 rows a group, are held, and all else is worked out of them."""
    counts = held(C.class_threshold_table(emission_terms(rows), by, k).coalesce(1))
    best = {tuple(r[c] for c in by): r.tau for r in C.best_of(counts.groupBy(*by, "tau").agg(F.sum("n_answered").alias("n_answered"), F.sum("n_right").alias("n_right")), by).collect()}
    tables: dict[tuple, list] = {}
    for r in counts.collect():
        tables.setdefault(tuple(r[c] for c in by), []).append(r)
    out = {}
    for group, table in tables.items():
        for target in targets:
            found, tau = C.thresholds_of(table, k, target), best.get(group)
            mode = {"mode": "per class"} if found["target_reachable"] else {"mode": "fallback", "tau_global": tau, "taus": [C.ABSTAIN if tau is None else tau] * k}
            out[group, target] = found | mode
    return out


def valid_answer(kind: Column, choice: Column, probabilities: Column, options: list[str]) -> Column:
    """Whether an outside answer is a choice among the options with probabilities in [0, 1] for some of them."""
    names = F.array(*[F.lit(o) for o in options])
    values = F.map_values(probabilities)
    fine = (F.size(F.array_except(F.map_keys(probabilities), names)) == 0) & F.forall(values, lambda v: ~F.isnan(v) & (v >= 0) & (v <= 1)) & (F.aggregate(values, F.lit(0.0), lambda a, v: a + v) > 0)
    return F.coalesce((kind == "choice") & F.array_contains(names, choice) & (probabilities.isNull() | fine), F.lit(False))


def mapped_answer(choice: Column, probabilities: Column, options: list[str]) -> dict[str, Column]:
    """Vector in label order: missing keys are 0, divided by their sum; without probabilities a one-hot of the choice."""
    raw = [F.coalesce(F.element_at(probabilities, F.lit(o)), F.lit(0.0)) for o in options]
    total = sum(raw, F.lit(0.0))
    p = F.when(probabilities.isNotNull(), F.array(*[F.try_divide(x, total) for x in raw])).otherwise(F.array(*[F.when(choice == o, 1.0).otherwise(0.0) for o in options]))
    missing = F.when(probabilities.isNotNull(), F.array_except(F.array(*[F.lit(o) for o in options]), F.map_keys(probabilities)))
    return {"p": p, "raw_sum": F.when(probabilities.isNotNull(), total), "missing_keys": F.coalesce(missing, F.array().cast("array<string>"))}


def status_class(status: Column) -> Column:
    """What to do after an HTTP status."""
    return F.when(status == 200, "ok").when(status.isin(RETRY), "retry").when(status.isin(FAIL), "fail").when(status.isin(ABORT), "abort").otherwise("fail")


def usage_rollup(calls: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """Calls, retries (attempt > 0), ids and sums of amounts."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(F.col("attempt") > 0).alias("retries"), F.count_distinct("id").alias("ids"), *[F.sum(a).alias(a) for a in amounts])


def tie_counts(rows: DataFrame, by: list[str], vector: str, choice: str) -> DataFrame:
    """Vectors whose largest value occurs more than once, and choices that are not the first largest."""
    top = F.array_max(vector)
    return rows.groupBy(*by).agg(F.count_if(F.size(F.filter(vector, lambda x: x == top)) > 1).alias("ties"), F.count_if(F.col(choice) != V.argmax(F.col(vector))).alias("off_argmax"))


def vector_gap(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Largest and mean absolute difference of two vectors, and how often they choose alike."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return rows.groupBy(*by).agg(F.max(F.array_max(gaps)).alias("max_gap"), F.avg(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)).alias("mean_gap"), F.count_if(V.argmax(F.col(a)) == V.argmax(F.col(b))).alias("agree"), F.count("*").alias("n"))


def timing_decision(rows: DataFrame, n_items: Column, budget_s: float) -> DataFrame:
    """Seconds per item and pass, and the reading plan that fits the budget. rows: item, rotation, seconds."""
    agg = rows.agg(F.sum("seconds").alias("s"), F.count_distinct("item").alias("items"), F.count("*").alias("passes"), F.sum(F.when(F.col("rotation") == 0, F.col("seconds"))).alias("s0"))
    out = agg.select((F.col("s") / F.col("items")).alias("s_per_item"), (F.col("s") / F.col("passes")).alias("s_per_pass"), (F.col("s0") / F.col("items")).alias("s_per_first"))
    plan = F.when(F.col("s_per_item") * n_items <= budget_s, "all rotations").when(F.col("s_per_first") * n_items <= budget_s, "first rotation").otherwise("fewer items")
    return out.withColumn("plan", plan)
