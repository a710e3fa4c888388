"""Gauges made of the test tables, the same in Spark and in SQL.

Scores of gauges A and B come from slots of the embeddings, three readings in rotated order each, with a bump for the
true class; gauge L comes from lineitem. They are fixtures with known structure, not models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators import metrics as M

K, TAU = 3, 0.7
GAUGES = {"A": (0, 1.5), "B": (9, 2.0)}
#: Slots of the three readings, as they were read: letter order of rotation 0, 1, 2.
READ = [(1, 2, 3), (6, 4, 5), (8, 9, 7)]
OPTIONS = ["none", "one", "several"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(id_name: str):
    return F.when(F.col(id_name) % 10 < 3, "fit").otherwise("exam")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gauge, split, id, y, readings, logits."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % K).cast("int").alias("y"), "embedding", split_of("vec_id").alias("split"))
    out = None
    for gauge, (shift, bump) in GAUGES.items():
        aligned = []
        for rotation, slots in enumerate(READ):
            raw = F.array(*[F.get("embedding", F.lit(s + shift - 1)).cast("double") * 10 for s in slots])
            straight = V.rotate_back(raw, F.lit(rotation), K)
            aligned.append(F.array(*[F.get(straight, F.lit(c)) + F.when(F.col("y") == c, bump).otherwise(0.0) for c in range(K)]))
        one = rows.select(F.lit(gauge).alias("gauge"), "split", "id", "y", F.array(*aligned).alias("readings"))
        one = one.withColumn("logits", V.mean_of_vectors(F.col("readings"), K))
        out = one if out is None else out.union(one)
    return out


def large_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge L: an item for each lineitem; the class is the return flag."""
    rows = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    base = F.array(F.col("l_quantity") / 25, F.col("l_discount") * 20, F.col("l_tax") * 25)
    bumped = F.array(*[F.get(base, F.lit(c)) + F.when(y == c, 1.0).otherwise(0.0) for c in range(K)])
    return rows.select(F.lit("L").alias("gauge"), F.when(F.col("l_orderkey") % 10 < 3, "fit").otherwise("exam").alias("split"), y.alias("y"), bumped.alias("logits"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.term_table(items(spark, sf_dir), K, 1.0, [TAU] * K)


def placed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with ord, the place in id order within gauge and split."""
    place = F.row_number().over(Window.partitionBy("gauge", "split").orderBy("id")) - 1
    return terms(spark, sf_dir).withColumn("ord", place.cast("long"))


def emission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free text for each event, some of them damaged in known ways."""
    n, conf = F.col("event_id"), F.round(F.pmod(F.col("event_id") * 37, F.lit(101)) / 100, 2)
    word = F.element_at(F.array(*[F.lit(o) for o in OPTIONS]), (F.col("user_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"decision": "'), word, F.lit('", "confidence": '), conf.cast("string"), F.lit("}"))
    raw = (
        F.when(n % 11 == 0, F.concat(F.lit("no object "), word)).when(n % 13 == 0, F.concat(F.lit('{"decision": "two", "confidence": '), conf.cast("string"), F.lit("}")))
        .when(n % 17 == 0, F.concat(F.lit('{"decision": "'), word, F.lit('", "confidence": true}'))).when(n % 19 == 0, F.concat(F.lit('{"decision": "'), word, F.lit('", "confidence": "0.5"}')))
        .when(n % 23 == 0, F.concat(F.lit('{"decision": "'), word, F.lit('", "confidence": 1.2}'))).when(n % 29 == 0, F.concat(F.lit('{"decision": "'), word, F.lit('", "confi')))
        .otherwise(F.concat(F.lit("Sure: "), body, F.lit(" ok")))
    )
    y = F.when(n % 5 == 0, (F.col("user_id") + 1) % 3).otherwise(F.col("user_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", split_of("event_id").alias("split"), y.cast("int").alias("y"), raw.alias("raw"))


def _items_sql() -> str:
    parts = []
    for gauge, (shift, bump) in GAUGES.items():
        cells = []
        for c in range(K):
            reads = []
            for rotation, slots in enumerate(READ):
                slot = slots[(c - rotation) % K] + shift
                reads.append(f"(embedding[{slot}]::DOUBLE * 10 + CASE WHEN label % 3 = {c} THEN {bump}::DOUBLE ELSE 0 END)")
            cells.append(f"({' + '.join(reads)}) / 3 AS l{c}, {reads[0]} AS r{c}")
        parts.append(f"SELECT '{gauge}' AS gauge, CASE WHEN vec_id % 10 < 3 THEN 'fit' ELSE 'exam' END AS split, vec_id AS id, (label % 3)::INT AS y, {', '.join(cells)} FROM embeddings")
    return " UNION ALL ".join(parts)


def terms_sql(source: str, name: str = "terms", temperature: str = "1.0", tau: float = TAU) -> str:
    """CTEs that add p0..p2, pred, conf, correct, nll, bin and answered to a CTE with y, l0..l2."""
    return f"""
{name}_e AS (SELECT *, greatest(l0 / {temperature}, l1 / {temperature}, l2 / {temperature}) AS mx, exp(l0 / {temperature} - mx) AS e0, exp(l1 / {temperature} - mx) AS e1, exp(l2 / {temperature} - mx) AS e2 FROM {source}),
{name}_p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM {name}_e),
{name}_c AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS py FROM {name}_p),
{name} AS (SELECT *, (pred = y)::INT AS correct, -ln(greatest(least(py, 1.0), 1e-12)) AS nll, least(floor(conf * 15), 14)::INT AS bin, (conf >= {tau}::DOUBLE)::INT AS answered, 1 AS w FROM {name}_c)"""


ITEMS_SQL = f"items AS ({_items_sql()})"
TERMS_SQL = f"{ITEMS_SQL}, {terms_sql('items')}"
LARGE_SQL = """large AS (SELECT 'L' AS gauge, CASE WHEN l_orderkey % 10 < 3 THEN 'fit' ELSE 'exam' END AS split, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  l_quantity / 25 + (CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS l0, l_discount * 20 + (CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0 END) AS l1, l_tax * 25 + (CASE WHEN y = 2 THEN 1.0::DOUBLE ELSE 0 END) AS l2 FROM lineitem)"""
EMISSIONS_SQL = """emitted AS (SELECT event_id, CASE WHEN event_id % 10 < 3 THEN 'fit' ELSE 'exam' END AS split, (CASE WHEN event_id % 5 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END)::INT AS y,
  (event_id * 37) % 101 AS hundredths,
  CASE WHEN event_id % 11 = 0 THEN 'no object' WHEN event_id % 13 = 0 THEN 'no decision' WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN 'no confidence' WHEN event_id % 29 = 0 THEN 'not JSON' END AS parse_error,
  CASE WHEN parse_error IS NULL THEN (user_id % 3)::INT ELSE -1 END AS decision, CASE WHEN parse_error IS NULL THEN hundredths / 100.0::DOUBLE ELSE 0 END AS confidence FROM events)"""


def metrics_sql(source: str, by: str) -> str:
    """The six metrics of a CTE of terms with weights w, by the grouping columns."""
    f1 = " + ".join(f"coalesce(2.0::DOUBLE * sum(w * (y = {c} AND pred = {c})::INT) / nullif(sum(w * (y = {c})::INT) + sum(w * (pred = {c})::INT), 0), 0)" for c in range(K))
    ece = " + ".join(f"abs(sum(CASE WHEN bin = {b} THEN w * (correct - conf) ELSE 0 END))" for b in range(M.BINS))
    return f"""SELECT {by}, sum(w)::BIGINT AS n, sum(w * correct)::DOUBLE / sum(w) AS accuracy, ({f1}) / 3 AS macro_f1, sum(w * nll) / sum(w) AS nll, ({ece}) / sum(w) AS ece,
  1 - sum(w * answered)::DOUBLE / sum(w) AS ask_rate, sum(w * answered * correct)::DOUBLE / nullif(sum(w * answered), 0) AS selective_accuracy FROM {source} GROUP BY {by}"""


def draws_sql(n_boot: int) -> str:
    """CTEs: places (gauge, split, ord, terms) and resampled (with b and w), by md5 draws for each group."""
    return f"""
places AS (SELECT *, row_number() OVER (PARTITION BY gauge, split ORDER BY id) - 1 AS ord FROM terms),
sizes AS (SELECT split, count(*) AS n FROM terms WHERE gauge = 'A' GROUP BY split),
drawn AS (SELECT split, b, ('0x' || substr(md5(b || ':' || j), 1, 8))::BIGINT % n AS ord, count(*)::BIGINT AS times FROM sizes, generate_series(0, {n_boot} - 1) AS bs(b), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS j) AS js GROUP BY ALL),
resampled AS (SELECT places.* EXCLUDE (w), b, times AS w FROM places JOIN drawn USING (split, ord))"""
