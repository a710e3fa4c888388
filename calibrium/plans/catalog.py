"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.functions import vectors as V
from calibrium.operators import bootstrap as B
from calibrium.operators import calibration as C
from calibrium.operators import checks as I
from calibrium.operators import compare as P
from calibrium.operators import dataset as D
from calibrium.operators import gauges as G
from calibrium.operators import metrics as M
from calibrium.plans import fixtures as X0
from calibrium.plans.fixtures import EMISSIONS_SQL, ITEMS_SQL, LARGE_SQL, TERMS_SQL, draws_sql, items, metrics_sql, placed_terms, table, terms, terms_sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
BY, METRICS, N_BOOT = ["gauge", "split"], ["accuracy", "macro_f1", "nll", "ece", "ask_rate", "selective_accuracy"], 1000
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, so that engines that add up in other orders agree."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def six_sql(inner: str, keys: str, names: list[str], digits: int = 6) -> str:
    return f"SELECT {keys}, {', '.join(f'round({n}, {digits}) AS {n}' for n in names)} FROM ({inner})"


# Scores and single metrics


@query(f"WITH {TERMS_SQL} SELECT gauge, split, id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM terms")
def softmax_probs(spark, d):
    return six(terms(spark, d).select(*BY, "id", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(3)]), "p0", "p1", "p2")


@query(f"WITH {TERMS_SQL} SELECT gauge, split, id, y, pred, round(conf, 6) AS conf, correct = 1 AS correct FROM terms")
def argmax_pred(spark, d):
    return six(terms(spark, d).select(*BY, "id", "y", "pred", "conf", "correct"), "conf")


@query(f"WITH {ITEMS_SQL} SELECT gauge, split, id, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM items")
def rotation_mean(spark, d):
    return six(items(spark, d).select(*BY, "id", *[F.get("logits", F.lit(c)).alias(f"l{c}") for c in range(3)]), "l0", "l1", "l2")


@query(f"WITH {TERMS_SQL} SELECT gauge, split, count(*) AS n, (count(*) FILTER (WHERE NOT (least(p0, p1, p2) >= 0 AND greatest(p0, p1, p2) <= 1 AND abs(p0 + p1 + p2 - 1) <= 1e-6)))::BIGINT AS broken FROM terms GROUP BY ALL")
def gauge_contract(spark, d):
    return I.contract_report(terms(spark, d), BY, "p")


@query(f"WITH {ITEMS_SQL} SELECT gauge, count(*) FILTER (WHERE NOT isnan(l0 + l1 + l2) AND greatest(l0, l1, l2) < 'inf'::DOUBLE) AS valid FROM items GROUP BY gauge")
def valid_logits(spark, d):
    return items(spark, d).groupBy("gauge").agg(F.count_if(V.valid_logits(F.col("logits"), 3)).alias("valid"))


@query(f"WITH {TERMS_SQL} {six_sql(metrics_sql('terms', 'gauge, split'), 'gauge, split, n', METRICS)}")
def exam_metrics(spark, d):
    return six(M.metrics(terms(spark, d), BY), *METRICS)


@query(f"WITH {LARGE_SQL}, {terms_sql('large')} {six_sql(metrics_sql('terms', 'gauge, split'), 'gauge, split, n', METRICS)}")
def large_metrics(spark, d):
    return six(M.metrics(M.term_table(X0.large_items(spark, d), 3, 1.0, [X0.TAU] * 3), BY), *METRICS)


def _one(name: str) -> Callable:
    def f(spark, d):
        return six(M.metrics(terms(spark, d), BY).select(*BY, name), name)

    f.__name__ = name
    return f


for _name in METRICS:
    query(f"WITH {TERMS_SQL} {six_sql(metrics_sql('terms', 'gauge, split'), 'gauge, split', [_name])}")(_one(_name))


@query(f"WITH {TERMS_SQL}, grid AS (SELECT DISTINCT gauge, split, g.gold, p.pred FROM terms, (SELECT unnest([0, 1, 2]) AS gold) g, (SELECT unnest([0, 1, 2]) AS pred) p) SELECT g.gauge, g.split, g.gold, g.pred, count(t.id) AS n FROM grid g LEFT JOIN terms t ON t.gauge = g.gauge AND t.split = g.split AND t.y = g.gold AND t.pred = g.pred GROUP BY ALL")
def confusion_dense(spark, d):
    return M.confusion(terms(spark, d), BY)


@query(f"WITH {TERMS_SQL} SELECT gauge, split, bin, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(avg(correct), 6) AS accuracy FROM terms GROUP BY ALL")
def ece_bins(spark, d):
    return six(M.reliability(terms(spark, d), BY), "mean_conf", "accuracy")


AUROC_SQL = """SELECT {by}, (sum(rank * hits) - sum(hits) * (sum(hits) + 1) / 2) / nullif((sum(hits) * (sum(w) - sum(hits)))::DOUBLE, 0) AS auroc FROM (
  SELECT {by}, w, hits, coalesce(sum(w) OVER (PARTITION BY {by} ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (w + 1) / 2.0::DOUBLE AS rank
  FROM (SELECT {by}, conf, sum(w)::BIGINT AS w, sum(w * correct)::BIGINT AS hits FROM {source} GROUP BY {by}, conf)) GROUP BY {by}"""


@query(f"WITH {TERMS_SQL} {six_sql(AUROC_SQL.format(by='gauge, split', source='terms'), 'gauge, split', ['auroc'])}")
def auroc_midrank(spark, d):
    return six(M.auroc(terms(spark, d), BY), "auroc")


@query(f"WITH {TERMS_SQL} SELECT gauge, split, id, pred, answered = 1 AS answered FROM terms")
def abstain_flags(spark, d):
    return terms(spark, d).select(*BY, "id", "pred", "answered")


_CURVE = ", ".join(f"{t!r}::DOUBLE" for t in M.curve_taus())


@query(f"WITH {TERMS_SQL}, taus AS (SELECT unnest([{_CURVE}]) AS tau) SELECT gauge, split, round(tau, 6) AS tau, round(1 - sum((conf >= tau)::INT) / count(*), 6) AS ask_rate, round(sum((conf >= tau)::INT * correct) / nullif(sum((conf >= tau)::INT), 0), 6) AS selective_accuracy, sum((conf >= tau)::INT)::BIGINT AS n_answered FROM terms, taus GROUP BY gauge, split, taus.tau")
def risk_coverage_curve(spark, d):
    return six(M.risk_coverage(terms(spark, d), BY), "tau", "ask_rate", "selective_accuracy")


@query(f"WITH {ITEMS_SQL} SELECT gauge, split, 0 AS class, round(avg(r0 - l0), 6) AS bias FROM items GROUP BY ALL UNION ALL SELECT gauge, split, 1, round(avg(r1 - l1), 6) FROM items GROUP BY ALL UNION ALL SELECT gauge, split, 2, round(avg(r2 - l2), 6) FROM items GROUP BY ALL")
def letter_bias(spark, d):
    return six(M.letter_bias(items(spark, d), BY), "bias")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return six(M.latency(table(spark, d, "events"), ["event_type"], "value"), "median", "p90", "mean")


# Calibration

_GRID = ", ".join(f"{t!r}::DOUBLE" for t in C.temperature_grid())


@query(f"WITH {ITEMS_SQL}, temps AS (SELECT unnest([{_GRID}]) AS t, generate_subscripts([{_GRID}], 1) - 1 AS place), {terms_sql('(SELECT * FROM items, temps)', 'hot', 't')} SELECT gauge, split, place::INT AS place, round(avg(nll), 6) AS nll FROM hot GROUP BY gauge, split, hot.place")
def temperature_grid(spark, d):
    return six(C.nll_by_temperature(items(spark, d), BY, C.temperature_grid()).select(*BY, "place", "nll"), "nll")


_TAUS = ", ".join(f"{34 + i} / 100.0::DOUBLE" for i in range(66))
_SWEEP = f"taus AS (SELECT unnest([{_TAUS}]) AS tau), sweep AS (SELECT gauge, split, tau, sum((conf >= tau)::INT)::BIGINT AS a, sum((conf >= tau)::INT * correct)::BIGINT AS r FROM terms, taus GROUP BY gauge, split, tau)"


@query(f"WITH {TERMS_SQL}, taus AS (SELECT unnest([{_TAUS}]) AS tau) SELECT gauge, split, pred AS class, round(tau, 2) AS tau, sum((conf >= tau)::INT)::BIGINT AS n_answered, sum((conf >= tau)::INT * correct)::BIGINT AS n_right FROM terms, taus GROUP BY gauge, split, pred, taus.tau")
def tau_class_table(spark, d):
    return C.class_threshold_table(terms(spark, d), BY).withColumn("tau", F.round("tau", 2))


@query(f"WITH {TERMS_SQL}, {_SWEEP} SELECT gauge, split, min(CASE WHEN a > 0 AND r / nullif(a, 0) + 1e-12 >= 0.95 THEN round(tau, 2) END) AS tau_global FROM sweep GROUP BY ALL")
def tau_global(spark, d):
    return C.global_threshold(terms(spark, d), BY).withColumn("tau_global", F.round("tau_global", 2))


@query(f"WITH {TERMS_SQL}, {_SWEEP} SELECT gauge, split, round(tau, 2) AS tau, round(sa, 6) AS sa FROM (SELECT *, r / a AS sa, row_number() OVER (PARTITION BY gauge, split ORDER BY round(r / a, 12) DESC, tau) AS k FROM sweep WHERE a > 0) WHERE k = 1")
def tau_fallback(spark, d):
    return six(C.best_threshold(terms(spark, d), BY).withColumn("tau", F.round("tau", 2)), "sa")


@query()
def calibration_record(spark, d):
    """T, thresholds and fit metrics of both gauges, by the zoomed grid and the descent on class counts."""
    rows = []
    for gauge in X0.GAUGES:
        r = C.calibrate(items(spark, d).where((F.col("gauge") == gauge) & (F.col("split") == "fit")))
        rows.append((gauge, r["T"], r["method"], r["tau_global"], [float(t) for t in r["taus"]], r["target_reachable"], r["n_fit"], r["fit"]["nll_raw"], r["fit"]["nll_cal"], r["fit"]["ask_rate"], r["fit"]["selective_accuracy"]))
    return spark.createDataFrame(rows, "gauge string, T double, method string, tau_global double, taus array<double>, target_reachable boolean, n_fit long, nll_raw double, nll_cal double, ask_rate double, selective_accuracy double")


# Bootstrap and comparisons


def _draws(spark, d, n_boot=N_BOOT):
    """md5 draws for each split; the same for all gauges."""
    out = None
    for r in items(spark, d).where("gauge = 'A'").groupBy("split").count().collect():
        one = B.hash_draws(spark, r["count"], n_boot).withColumn("split", F.lit(r["split"]))
        out = one if out is None else out.union(one)
    return out


def _resampled(spark, d):
    return B.hash_block_metrics(placed_terms(spark, d), BY, N_BOOT)


_RESAMPLED = f"WITH {TERMS_SQL}, {draws_sql(N_BOOT)}, per AS ({metrics_sql('resampled', 'gauge, split, b')})"


@query(f"WITH {TERMS_SQL}, {draws_sql(N_BOOT)} SELECT split, b, ord, times AS w FROM drawn")
def bootstrap_weights(spark, d):
    return _draws(spark, d).select("split", "b", "ord", "w")


@query(f"{_RESAMPLED} {six_sql('SELECT * FROM per', 'gauge, split, b, n', METRICS)}")
def bootstrap_metrics(spark, d):
    return six(_resampled(spark, d), *METRICS)


@query(
    f"{_RESAMPLED}, "
    + "cells AS ("
    + " UNION ALL ".join(f"SELECT gauge, split, '{m}' AS metric, {m} AS x FROM per" for m in METRICS)
    + ") SELECT gauge, split, metric, round(quantile_cont(x, 0.025), 4) AS lo, round(quantile_cont(x, 0.975), 4) AS hi, count(x) AS n_boot_used FROM cells GROUP BY ALL"
)
def bootstrap_ci(spark, d):
    return B.intervals(_resampled(spark, d), BY, METRICS).withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


@query()
def bootstrap_pcg64(spark, d):
    """Parity draws of numpy's generator, for both splits and gauges."""
    out = None
    for r in items(spark, d).where("gauge = 'A'").groupBy("split").count().collect():
        one = B.parity_draws(spark, r["count"], 200).withColumn("split", F.lit(r["split"]))
        out = one if out is None else out.union(one)
    per = M.metrics(placed_terms(spark, d).join(out, ["split", "ord"]), [*BY, "b"], weight=F.col("w"))
    return B.intervals(per, BY, METRICS).withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


@query()
def bootstrap_poisson(spark, d):
    """Poisson weights over the large gauge: one pass, no draws by index."""
    rows = M.term_table(X0.large_items(spark, d).withColumn("key", F.monotonically_increasing_id()), 3, 1.0, [X0.TAU] * 3)
    per = B.poisson_block_metrics(rows, "key", BY, 50)
    return B.intervals(per, BY, ["accuracy", "ask_rate"]).withColumns({c: F.round(c, 3) for c in ("lo", "hi")})


@query(f"{_RESAMPLED}, whole AS ({metrics_sql('terms', 'gauge, split')}), diffs AS (SELECT a.split, a.ask_rate - b.ask_rate AS x FROM per a JOIN per b ON a.split = b.split AND a.b = b.b WHERE a.gauge = 'A' AND b.gauge = 'B'), ci AS (SELECT split, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, count(x) AS n_boot_used FROM diffs GROUP BY split) SELECT ci.split, round(a.ask_rate - b.ask_rate, 4) AS value, round(lo, 4) AS lo, round(hi, 4) AS hi, n_boot_used, CASE WHEN lo <= 0 AND hi >= 0 THEN 'within noise' ELSE 'different' END AS verdict FROM ci JOIN whole a ON a.split = ci.split AND a.gauge = 'A' JOIN whole b ON b.split = ci.split AND b.gauge = 'B'")
def paired_ask_diff(spark, d):
    return P.paired_difference(_resampled(spark, d), M.metrics(terms(spark, d), BY), "A", "B", "ask_rate", ["split"])


@query(
    f"{_RESAMPLED}, m AS ({metrics_sql('terms', 'gauge, split')}), shares AS (SELECT a.split, 1 - b.ask_rate AS whole, (1 - a.ask_rate) / nullif(1 - b.ask_rate, 0) AS share FROM per a JOIN per b ON a.split = b.split AND a.b = b.b WHERE a.gauge = 'A' AND b.gauge = 'B'), "
    "ci AS (SELECT split, quantile_cont(whole, 0.025) > 0 AS fine, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi FROM shares GROUP BY split) "
    "SELECT a.split, coalesce(fine, false) AS defined, round(1 - a.ask_rate, 4) AS part, round(1 - b.ask_rate, 4) AS whole, CASE WHEN fine THEN round((1 - a.ask_rate) / nullif(1 - b.ask_rate, 0), 4) END AS share, CASE WHEN fine THEN round(lo, 4) END AS lo, CASE WHEN fine THEN round(hi, 4) END AS hi FROM ci JOIN m a ON a.split = ci.split AND a.gauge = 'A' JOIN m b ON b.split = ci.split AND b.gauge = 'B'"
)
def share_of_gap(spark, d):
    """(A - B) / (A - perfect) of the ask rates, with a gauge U that asks always as a third."""
    def third(df):
        return df.unionByName(df.where("gauge = 'A'").withColumns({"gauge": F.lit("U"), "ask_rate": F.lit(1.0)}))

    return P.share_of_gap(third(_resampled(spark, d)), third(M.metrics(terms(spark, d), BY)), "B", "A", "U", "ask_rate", ["split"])


@query(f"{_RESAMPLED}, ci AS (SELECT gauge, split, quantile_cont(accuracy, 0.025) AS lo, quantile_cont(accuracy, 0.975) AS hi FROM per GROUP BY ALL) SELECT a.split, a.gauge AS left_key, b.gauge AS right_key FROM ci a JOIN ci b ON a.split = b.split AND a.gauge <> b.gauge AND a.lo <= b.hi AND b.lo <= a.hi")
def within_noise_pairs(spark, d):
    ci = B.intervals(_resampled(spark, d), BY, ["accuracy"])
    return P.within_noise(ci, "gauge", ["split"])


@query(f"WITH {TERMS_SQL} SELECT gauge, split, round(avg((conf >= 0.95)::INT), 6) AS answered, round(avg(correct) FILTER (WHERE conf >= 0.95), 6) AS selective_accuracy FROM terms GROUP BY ALL")
def unfitted_gate(spark, d):
    ready = terms(spark, d).withColumn("gate", V.answered(F.col("conf"), F.col("pred"), [0.95] * 3))
    out = ready.groupBy(*BY).agg(F.avg(F.col("gate").cast("double")).alias("answered"), F.avg(F.when(F.col("gate"), F.col("correct").cast("double"))).alias("selective_accuracy"))
    return six(out, "answered", "selective_accuracy")


@query(f"WITH {TERMS_SQL}, sure AS (SELECT id FROM terms WHERE gauge = 'B' AND answered = 1), same AS (SELECT * FROM terms WHERE id IN (SELECT id FROM sure)) {six_sql(metrics_sql('same', 'gauge, split'), 'gauge, split, n', ['accuracy', 'nll', 'ece'])}")
def like_for_like(spark, d):
    rows = terms(spark, d)
    sure = rows.groupBy("id").agg(F.max(((F.col("gauge") == "B") & F.col("answered")).cast("int")).alias("sure")).where("sure = 1")
    out = M.metrics(P.like_for_like([rows, sure], ["id"]).where("gauge IS NOT NULL"), BY)
    return six(out.select(*BY, "n", "accuracy", "nll", "ece"), "accuracy", "nll", "ece")


@query("WITH v AS (SELECT label AS n, vec_id % 5 AS k, avg(embedding[1]) + 0.9 AS value, min(embedding[2]) + 0.9 AS lo FROM embeddings GROUP BY ALL) SELECT n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n_draws, count(*) FILTER (WHERE value + 1e-12 >= 0.9) AS reach_target, avg(lo) <= 0.8 AS qualifies FROM v GROUP BY n")
def labels_needed_summary(spark, d):
    e = table(spark, d, "embeddings")
    v = e.groupBy(F.col("label").alias("n"), (F.col("vec_id") % 5).alias("k")).agg((F.avg(F.get("embedding", F.lit(0)).cast("double")) + 0.9).alias("value"), (F.min(F.get("embedding", F.lit(1)).cast("double")) + 0.9).alias("lo"))
    return six(P.labels_needed(v, 0.8, 0.9), "mean", "least", "most")


# Gauges


@query(f"WITH {EMISSIONS_SQL} SELECT event_id, ['no-call', 'one-call', 'multi-call'][decision + 1] AS decision, CASE WHEN parse_error IS NULL THEN confidence END AS confidence, parse_error IS NULL AS parse_ok, parse_error FROM emitted")
def emission_parse(spark, d):
    return X0.emission_rows(spark, d).select("event_id", X.parsed_emission(F.col("raw")).alias("x")).select("event_id", "x.*")


@query(f"WITH {EMISSIONS_SQL} SELECT split, count(*) AS n, round(avg((decision = y)::INT), 6) AS trust_accuracy, count(*) FILTER (WHERE decision < 0) AS n_failed, count(*) FILTER (WHERE confidence = 1) AS n_certain, count(*) FILTER (WHERE decision = 0) AS n_decision_0, count(*) FILTER (WHERE decision = 1) AS n_decision_1, count(*) FILTER (WHERE decision = 2) AS n_decision_2 FROM emitted GROUP BY split")
def emission_trust(spark, d):
    return six(G.emission_summary(G.emissions(X0.emission_rows(spark, d)), ["split"]), "trust_accuracy")


@query()
def emission_gate(spark, d):
    r = G.emission_gate(G.emissions(X0.emission_rows(spark, d)).where("split = 'fit'"))
    return spark.createDataFrame([(r["mode"], r["tau_global"], [float(t) for t in r["taus"]])], "mode string, tau_global double, taus array<double>")


@query("WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN count(*) > 1 THEN 'A' ELSE min(l_returnflag) END AS majority, max(n) AS n FROM c WHERE n = (SELECT max(n) FROM c)")
def majority_baseline(spark, d):
    return D.majority(table(spark, d, "lineitem"), ["A", "N", "R"], "l_returnflag")


@query("SELECT 'uniform' AS gauge, round(ln(3.0::DOUBLE), 6) AS nll, count(*) AS n FROM embeddings UNION ALL SELECT 'majority', round(avg(CASE WHEN label % 3 = 0 THEN 0 ELSE -ln(1e-12) END), 4), count(*) FROM embeddings")
def constant_gauges(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 3).cast("int").alias("y"))
    nll = lambda df: M.metrics(M.term_table(df), []).select("nll", "n")
    u = nll(G.uniform(e)).select(F.lit("uniform").alias("gauge"), F.round("nll", 6).alias("nll"), "n")
    return u.union(nll(G.majority_vector(e, F.lit(0))).select(F.lit("majority"), F.round("nll", 4), "n"))


def _answers(spark, d):
    """An outside answer for each event: none, some or all of the probabilities, from its value."""
    e = table(spark, d, "events")
    choice = F.element_at(F.array(*[F.lit(o) for o in X0.OPTIONS]), (F.col("user_id") % 3 + 1).cast("int"))
    p = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, F.create_map(choice, F.lit(0.5))).otherwise(F.create_map(F.lit("none"), F.lit(0.2), F.lit("one"), (F.col("event_id") % 4) / 4, F.lit("several"), F.lit(0.25)))
    return e.select("event_id", choice.alias("choice"), p.alias("probabilities"))


@query("WITH e AS (SELECT event_id, user_id % 3 AS c, (event_id % 4) / 4 AS v, event_id % 7 = 0 AS no_p, event_id % 7 <> 0 AND event_id % 5 = 0 AS one FROM events), s AS (SELECT *, CASE WHEN no_p THEN NULL WHEN one THEN 0.5::DOUBLE ELSE 0.2::DOUBLE + v + 0.25::DOUBLE END AS t FROM e) SELECT event_id, round(CASE WHEN no_p OR one THEN (c = 0)::INT ELSE 0.2 / t END, 6) AS p0, round(CASE WHEN no_p OR one THEN (c = 1)::INT ELSE v / t END, 6) AS p1, round(CASE WHEN no_p OR one THEN (c = 2)::INT ELSE 0.25 / t END, 6) AS p2, round(t, 6) AS raw_sum, CASE WHEN one THEN 2 ELSE 0 END AS n_missing FROM s")
def external_map_answer(spark, d):
    a = _answers(spark, d)
    out = a.withColumns(G.mapped_answer(F.col("choice"), F.col("probabilities"), X0.OPTIONS))
    return six(out.select("event_id", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(3)], "raw_sum", F.size("missing_keys").alias("n_missing")), "p0", "p1", "p2", "raw_sum")


@query("SELECT event_id % 7 = 0 AS no_probabilities, count(*) AS n, count(*) AS valid FROM events GROUP BY ALL")
def external_validity(spark, d):
    a = _answers(spark, d).withColumn("ok", G.valid_answer(F.lit("choice"), F.col("choice"), F.col("probabilities"), X0.OPTIONS))
    return a.groupBy(F.col("probabilities").isNull().alias("no_probabilities")).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 > 0) AS retries, count(DISTINCT user_id) AS ids, round(sum(value), 2) AS value FROM events GROUP BY event_type")
def usage_rollup(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 3).alias("attempt"), F.col("user_id").alias("id"), "value")
    return G.usage_rollup(e, ["event_type"], ["value"]).withColumn("value", F.round("value", 2))


@query("SELECT event_type, CASE status WHEN 200 THEN 'ok' WHEN 429 THEN 'retry' WHEN 503 THEN 'retry' WHEN 404 THEN 'fail' WHEN 401 THEN 'abort' ELSE 'fail' END AS class, count(*) AS n FROM (SELECT event_type, [200, 429, 503, 404, 401, 418][event_id % 6 + 1] AS status FROM events) GROUP BY ALL")
def status_classes(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 429, 503, 404, 401, 418)]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").groupBy("event_type", G.status_class(status).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {TERMS_SQL} SELECT a.split, round(max(greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2))), 6) AS max_gap, round(avg((abs(a.p0 - b.p0) + abs(a.p1 - b.p1) + abs(a.p2 - b.p2)) / 3), 6) AS mean_gap, count(*) FILTER (WHERE a.pred = b.pred) AS agree, count(*) AS n FROM terms a JOIN terms b USING (id) WHERE a.gauge = 'A' AND b.gauge = 'B' GROUP BY a.split")
def vector_gap(spark, d):
    t = terms(spark, d)
    both = t.where("gauge = 'A'").select("id", "split", F.col("p").alias("a")).join(t.where("gauge = 'B'").select("id", F.col("p").alias("b")), "id")
    return six(G.vector_gap(both, ["split"], "a", "b"), "max_gap", "mean_gap")


@query("SELECT sum(value) / count(DISTINCT user_id) > 0 AS timed, round(sum(value) / count(DISTINCT user_id), 4) AS s_per_item, round(avg(value), 4) AS s_per_pass, round(sum(value) FILTER (WHERE event_id % 3 = 0) / count(DISTINCT user_id), 4) AS s_per_first FROM events")
def timing_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("item"), (F.col("event_id") % 3).alias("rotation"), F.col("value").alias("seconds"))
    out = G.timing_decision(e, F.lit(1000), 3600.0)
    return out.select((F.col("s_per_item") > 0).alias("timed"), *[F.round(c, 4).alias(c) for c in ("s_per_item", "s_per_pass", "s_per_first")])


# Datasets


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def ground_truth_left_join(spark, d):
    truth = D.first_per_key(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])
    return table(spark, d, "documents").select("doc_id", "lang").join(truth, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedupe_first(spark, d):
    return D.first_per_key(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_per_id(spark, d):
    return D.last_per_key(table(spark, d, "events").select("user_id", F.col("event_id"), "event_type"), ["user_id"], "event_id")


def _drops(spark, d):
    """Orders as items (id: the customer), lineitem counts as truth."""
    o = table(spark, d, "orders")
    label = F.element_at(F.array(*[F.lit(x) for x in V.LABELS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), label.alias("label"), F.when(F.col("o_orderkey") % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("request"), F.col("o_orderstatus").alias("file"))
    truth = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), (F.col("c_nationkey") % 3).alias("calls"))
    return D.with_drop_reason(rows, truth)


_DROPS_SQL = """dropped AS (SELECT o_custkey AS id, o_orderkey AS ord, o_orderstatus AS file, ['no-call', 'one-call', 'multi-call'][o_orderkey % 3 + 1] AS label,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN 'duplicate_id' WHEN label <> 'no-call' AND c_custkey IS NULL THEN 'no_ground_truth'
  WHEN (label = 'one-call' AND c_nationkey % 3 <> 1) OR (label = 'multi-call' AND c_nationkey % 3 < 2) THEN 'contradicts_category' WHEN o_orderkey % 17 = 0 THEN 'empty_request' END AS drop_reason
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey)"""


@query(f"WITH {_DROPS_SQL} SELECT id, ord, label, drop_reason FROM dropped")
def drop_reason_cascade(spark, d):
    return _drops(spark, d).select("id", "ord", "label", "drop_reason")


@query(f"WITH {_DROPS_SQL} SELECT drop_reason, file, count(*) AS n, grouping(drop_reason, file)::BIGINT AS level FROM (SELECT coalesce(drop_reason, 'kept') AS drop_reason, file FROM dropped) GROUP BY ROLLUP (drop_reason, file)")
def drop_rollup(spark, d):
    return D.rollup_counts(_drops(spark, d).withColumn("drop_reason", F.coalesce("drop_reason", F.lit("kept"))), "drop_reason", "file")


@query("WITH c AS (SELECT lang, source, count(*) AS valid FROM documents GROUP BY ALL), s AS (SELECT *, 100.0::DOUBLE * valid / sum(valid) OVER (PARTITION BY lang) AS raw FROM c) SELECT lang, source, (floor(raw) + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY raw - floor(raw) DESC, source) <= 100 - sum(floor(raw)) OVER (PARTITION BY lang) THEN 1 ELSE 0 END)::BIGINT AS n FROM s")
def largest_remainder(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("valid"))
    c = c.withColumn("raw", 100.0 * F.col("valid") / F.sum("valid").over(Window.partitionBy("lang"))).withColumn("total", F.lit(100))
    return D.largest_remainder(c, ["lang"], "raw", "total", "source").select("lang", "source", "n")


@query()
def allocate_sizes(spark, d):
    """Sample sizes by source with a floor, for a fifth of all documents."""
    counts = {r.source: r["count"] for r in table(spark, d, "documents").groupBy("source").count().orderBy("source").collect()}
    return spark.createDataFrame(sorted(D.allocate(counts, sum(counts.values()) // 5, 10).items()), "source string, n long")


_KEY = "md5('7:' || doc_id)"


@query(f"WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM s WHERE k <= n // 3")
def hash_stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.floor(F.count("*") / 3).alias("k"))
    return D.sample_per_group(docs, ["lang"], "doc_id", sizes, 7).select("doc_id", "lang")


@query(f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) <= 30 THEN 'fit' ELSE 'exam' END AS split FROM documents")
def hash_split(spark, d):
    return D.split_per_group(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 30, 7)


@query(f"SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) - 1) % 5)::INT AS fold FROM documents")
def stratified_folds(spark, d):
    return D.folds(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 5, 7)


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS request FROM conversations GROUP BY conv_id")
def request_text(spark, d):
    c = table(spark, d, "conversations")
    one = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    body = F.to_json(F.array(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))))
    return one.select("conv_id", D.request_text(F.parse_json(body)).alias("request"))


@query("SELECT event_id, 'f' || event_type AS name, 1 AS n_functions, 2 AS n_params, 1 AS calls FROM events")
def function_list(spark, d):
    body = F.concat(F.lit('[{"name": "f'), F.col("event_type"), F.lit('", "description": "x", "parameters": {"properties": {"k": 1, "v": '), F.col("props"), F.lit("}}}, 3]"))
    out = table(spark, d, "events").select("event_id", F.parse_json(body).alias("j"), F.parse_json("props").alias("truth"))
    f = D.function_list(F.col("j"))
    return out.select("event_id", F.get(f, F.lit(0))["name"].alias("name"), F.size(f).alias("n_functions"), F.size(F.get(f, F.lit(0))["params"]).alias("n_params"), D.call_count(F.col("truth")).alias("calls"))


@query("SELECT p_partkey, p_name || ': ' || p_type || ' (' || p_brand || ', ' || p_size || ')' AS line FROM part")
def tools_lines(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.tools_block(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand", F.col("p_size").cast("string")).alias("params")))).alias("line"))


# Text


@query(f"WITH w AS (SELECT d.doc_id, b.item_id, {WORDS_SQL.format('d.text')} AS x, {WORDS_SQL.format('b.text')} AS y FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)) SELECT doc_id, item_id, len(x) // 2 AS half, coalesce(list_position([x[i] = y[i] FOR i IN range(1, least(len(x), len(y)) + 1)], false) - 1, least(len(x), len(y)))::INT AS shared FROM w")
def canary_prefix(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = bench.count()
    joined = docs.select("doc_id", F.col("text").alias("x"), (F.col("doc_id") % n).alias("item_id")).join(bench.select("item_id", F.col("text").alias("y")), "item_id")
    first, _ = X.halves(F.col("x"))
    return joined.select("doc_id", "item_id", F.size(X.words(first)).cast("long").alias("half"), X.shared_prefix(X.words(F.col("x")), X.words(F.col("y"))).alias("shared"))


_PREFIX = "w[1:len(w) // 2]"
_NAMES = "[" + ", ".join(f"'{x}'" for x in X.PLACEHOLDERS) + "]"


@query(
    f"WITH d AS (SELECT doc_id, {_PREFIX} AS w FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)), c AS (SELECT *, list_filter(range(2, len(w) + 1), lambda i: regexp_matches(w[i], '^\\p{{Lu}}')) AS places FROM d), "
    f"t AS (SELECT doc_id, w, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(places, i) THEN {_NAMES}[(list_position(places, i) - 1) % {len(X.PLACEHOLDERS)} + 1] || regexp_extract(w[i], '[^\\p{{L}}\\p{{N}}]*$') ELSE translate(w[i], '0123456789', '1234567890') END) AS t FROM c) "
    "SELECT doc_id, array_to_string(t, ' ') AS twin, coalesce(list_filter(range(1, len(w) + 1), lambda i: w[i] <> t[i])[1] - 1, len(w))::INT AS shared FROM t"
)
def perturbed_twins(spark, d):
    """Prefixes with digits and names changed, and how much of them stays."""
    first, _ = X.halves(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", first.alias("prefix")).withColumn("twin", X.twin(F.col("prefix")))
    return docs.select("doc_id", "twin", X.shared_prefix(X.words(F.col("prefix")), X.words(F.col("twin"))).alias("shared"))


_SECRET = r"(^|[^A-Za-z0-9])((sk|pk|key|api|ghp|token)[-_][A-Za-z0-9_-]{8,})"


@query(rf"SELECT doc_id, regexp_replace(text, '{_SECRET}', '\1[redacted]', 'g') AS text FROM documents")
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("text"))


_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?%?"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_NUMBER}')) AS n, list_aggregate(regexp_extract_all(text, '{_NUMBER}'), 'string_agg', ' ') AS tokens FROM documents")
def number_tokens(spark, d):
    t = X.number_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.when(F.size(t) > 0, F.array_join(t, " ")).alias("tokens"))


@query("WITH n AS (SELECT DISTINCT regexp_replace(regexp_replace(CAST(TRY_CAST(regexp_replace(t, '[,%]', '', 'g') AS DECIMAL(38, 18)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS number, k FROM (SELECT unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?')) AS t, 1 AS k FROM documents UNION ALL SELECT unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?')), 2 FROM benchmark)) SELECT number FROM n WHERE k = 1 AND number IS NOT NULL EXCEPT SELECT number FROM n WHERE k = 2")
def report_number_diff(spark, d):
    # without exponents: in these texts they are parts of hexadecimal strings
    tokens = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0))).alias("t")).select(X.canonical_number(F.col("t")).alias("number")).where("number IS NOT NULL").distinct()
    return tokens("documents").join(tokens("benchmark"), "number", "left_anti")


@query("SELECT event_id, unnest(regexp_extract_all(props, '[0-9]+')) AS token FROM events")
def json_numbers(spark, d):
    return I.json_numbers(table(spark, d, "events"), "event_id", "props")


# Checks


@query("SELECT 'extra' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'missing', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def missing_extra_ids(spark, d):
    return I.missing_and_extra(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(f"WITH {ITEMS_SQL} SELECT 'disjoint' AS \"check\", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n FROM (SELECT id FROM items WHERE split = 'fit' INTERSECT SELECT id FROM items WHERE split = 'exam')")
def split_disjoint(spark, d):
    x = items(spark, d)
    return I.set_status(I.overlap(x.where("split = 'fit'"), x.where("split = 'exam'"), "id"), "disjoint")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return I.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT e.user_id, e.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'signup' AND v.user_id = e.user_id AND v.ts < e.ts) AS in_force FROM events e WHERE e.event_type = 'purchase'")
def asof_in_force(spark, d):
    e = table(spark, d, "events")
    versions = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("version"))
    return I.in_force(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), versions, ["user_id"], "ts", "ts", "version").select("user_id", "event_id", "in_force")


@query("WITH m AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS run FROM events) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM m WHERE bad GROUP BY user_id, run")
def failure_streak(spark, d):
    return I.failure_streaks(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error")


@query("SELECT conv_id, turn FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND NOT starts_with(text, before)")
def append_only(spark, d):
    return I.not_append_only(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn")


@query(rf"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_SECRET}')")
def secrets_scan(spark, d):
    return I.secrets_in(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT r_name AS name, sha256(r_name) AS sha256 FROM region")
def text_sha256(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("name"), F.sha2("r_name", 256).alias("sha256"))


@query("SELECT n_regionkey, sha256('[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']') AS sha256, count(*) AS n FROM nation GROUP BY n_regionkey")
def fingerprint(spark, d):
    return I.fingerprint(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"])


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN count(*) > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM events GROUP BY user_id, ts) GROUP BY status")
def status_rollup(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.count("*").alias("c"))
    return I.status_rollup(e.select(F.when(F.col("c") > 1, "FAIL").otherwise("PASS").alias("status")))


@query("SELECT doc_id, line, n, CASE WHEN n = 0 THEN 'FAIL' WHEN n > 1 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT doc_id, x[1] AS line, len(x)::INT AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: starts_with(v, 'license:')) AS x FROM documents))")
def license_lines(spark, d):
    return I.license_lines(table(spark, d, "documents"), "doc_id")


def queries() -> dict[str, Callable]:
    from calibrium.plans import more, records, verification

    return QUERIES | more.QUERIES | records.QUERIES | verification.QUERIES


def oracle_sql() -> dict[str, str]:
    from calibrium.plans import more, records, verification

    return SQL | more.SQL | records.SQL | verification.SQL
