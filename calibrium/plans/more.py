"""Queries that read and write files, stream, or train; with SQL where it can repeat them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.operators import checks as I
from calibrium.operators import guards as K
from calibrium.operators import metrics as M
from calibrium.operators import probe as L
from calibrium.operators import report as R
from calibrium.plans import fixtures as X0
from calibrium.plans.fixtures import TERMS_SQL, metrics_sql, table
from calibrium.sources import files as S
from calibrium.streaming import gate as G

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    path = S.scratch(spark, "jsonl")
    S.write_jsonl(table(spark, d, "conversations"), path, ["conv_id", "turn"])
    body = S.read_jsonl(spark, path)
    get = lambda name, kind: F.try_variant_get("body", f"$.{name}", kind).alias(name)
    return body.select(get("conv_id", "long"), get("turn", "long"), get("role", "string"), get("text", "string"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 5 = 0) AS bad FROM events")
def tolerant_scan(spark, d):
    path = S.scratch(spark, "lines")
    e = table(spark, d, "events")
    e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"id": '), F.col("props"))).otherwise(F.to_json(F.struct("event_id"))).alias("value")).write.text(path)
    return S.read_jsonl(spark, path, tolerant=True).agg(F.count("*").alias("n"), F.count_if(F.col("body").isNull()).alias("bad"))


def _result_files(spark, d):
    """JSON files of gauge results, calibrations and other things, one per region and nation."""
    path = S.scratch(spark, "results")
    n = table(spark, d, "nation")
    item = F.when(F.col("n_nationkey") % 2 == 0, '[{"split": "fit", "logits_mean": [0, 1, 2]}, {"split": "exam", "logits_mean": [0, 1, 2]}]').otherwise('[{"split": "fit", "logits_mean": [0, 1, 2]}]')
    body = F.when(F.col("n_nationkey") % 5 == 0, "not json").when(F.col("n_nationkey") % 5 == 1, '{"gauge": 3}').otherwise(F.concat(F.lit('{"gauge": "'), F.col("n_name"), F.lit('", "items": '), item, F.lit("}")))
    n.select(F.col("n_nationkey").cast("string").alias("part"), body.alias("value")).repartition(4, "part").write.partitionBy("part").text(path)
    return path


@query("SELECT n_name AS gauge, n_nationkey % 2 = 0 AS has_exam, false AS calibrated FROM nation WHERE n_nationkey % 5 > 1")
def discover_results(spark, d):
    docs = S.read_documents(spark, f"{_result_files(spark, d)}/*", "*.txt")
    return S.gauge_results(docs).select("gauge", "has_exam", "calibrated")


@query("SELECT (SELECT count(*) FROM events) AS items, 1::BIGINT AS headers, 1::BIGINT AS footers")
def run_file(spark, d):
    path = S.scratch(spark, "run")
    e = table(spark, d, "events").select(F.lit(1).alias("k"), F.col("event_id").alias("o"), F.to_json(F.struct(F.lit("item").alias("kind"), F.col("event_id").alias("id"))).alias("value"))
    ends = spark.createDataFrame([(0, 0, '{"kind": "header"}'), (2, 0, '{"kind": "footer"}')], "k int, o long, value string")
    e.union(ends).repartitionByRange("k", "o").sortWithinPartitions("k", "o").select("value").write.text(path)
    header, items, footer = S.read_run(S.parsed_lines(S.ordered_lines(spark, path, as_one=True)))
    return items.agg(F.count("*").alias("items")).crossJoin(header.agg(F.count("*").alias("headers"))).crossJoin(footer.agg(F.count("*").alias("footers")))


@query("SELECT event_type, count(*) - count(*) FILTER (WHERE event_id % 4 = 0) AS open FROM events GROUP BY event_type")
def resume_anti_join(spark, d):
    e = table(spark, d, "events")
    path = S.scratch(spark, "done")
    e.where("event_id % 4 = 0").select("event_id").write.parquet(path)
    return S.to_do(e, spark.read.parquet(path), "event_id").groupBy("event_type").agg(F.count("*").alias("open"))


@query("SELECT r_name AS name, sha256(r_name) AS sha256, strlen(r_name) AS length FROM region")
def file_digests(spark, d):
    path = S.scratch(spark, "bytes")
    rows = table(spark, d, "region")
    rows.select(F.col("r_name").alias("name"), F.col("r_name").alias("value")).write.option("lineSep", "\n").partitionBy("name").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_extract("path", "name=([^/]*)/", 1)
    text = F.regexp_replace(F.col("content").cast("string"), "\n$", "")
    return files.select(name.alias("name"), F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("length"))


@query(f"WITH {TERMS_SQL} SELECT id, pred, round(conf, 6) AS conf, answered = 1 AS answered FROM terms WHERE gauge = 'A'")
def stream_gate(spark, d):
    """Gauge A as a stream of files through a fixed gate."""
    source, out = S.scratch(spark, "stream"), S.scratch(spark, "gated")
    X0.items(spark, d).where("gauge = 'A'").select("id", "y", "logits").repartition(4).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = G.write_gated(stream, out, f"{out}-checkpoint", "id", 1.0, [X0.TAU] * 3)
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("conf", F.round("conf", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1")
def stream_counts(spark, d):
    """Hourly counts of the events as a stream, all windows (complete mode)."""
    source = S.scratch(spark, "events")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(4).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = S.scratch(spark, "counts")
    counts = G.running_counts(stream, "ts", "1 hour", "1 day", F.col("event_type") == "error")
    G.write_complete(counts, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _features(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("int").alias("y"), F.col("embedding").alias("features"), X0.split_of("vec_id").alias("split"))


@query()
def lr_probe_oof(spark, d):
    """Metrics of the probe: out-of-fold on the fit split, refitted on the exam split."""
    rows = _features(spark, d)
    out = L.probe_gauge(rows.where("split = 'fit'"), rows.where("split = 'exam'"), 3, [0.01, 0.1])
    return M.metrics(M.term_table(out), ["split", "oof"]).select("split", "oof", "n", F.round("accuracy", 4).alias("accuracy"), F.round("nll", 3).alias("nll"))


@query()
def labels_needed_sweep(spark, d):
    """Exam accuracy of probes on few labels: two draws of two sizes."""
    rows = _features(spark, d).cache()
    out = None
    for n in (24, 48):
        for draw in range(2):
            model = L.fit(L.subsample(rows.where("split = 'fit'"), n, draw, 3), 0.01, n)
            one = M.metrics(M.term_table(L.logits(model, rows.where("split = 'exam'"))), []).select(F.lit(n).alias("n"), F.lit(draw).alias("k"), F.round("accuracy", 4).alias("value"))
            out = one if out is None else out.union(one)
    out = S.held(out)
    rows.unpersist()
    return out


@query(f"WITH {TERMS_SQL}, m AS ({metrics_sql('terms', 'gauge, split')}) SELECT gauge, split, printf('%.3f', nll) || ' → ' || printf('%.3f', ece) AS shown FROM m")
def report_arrows(spark, d):
    m = M.metrics(X0.terms(spark, d), ["gauge", "split"])
    return m.select("gauge", "split", R.arrow(F.col("nll"), F.col("ece")).alias("shown"))


@query("SELECT doc_id FROM labels EXCEPT SELECT item_id FROM benchmark")
def unfulfilled_promises(spark, d):
    return R.unfulfilled(table(spark, d, "labels").select("doc_id").distinct(), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query()
def trimmed_tool_blocks(spark, d):
    """Tool blocks within a cap of words, by the iterative cut. One function more than a block can hold tells that there are
    more, so each task keeps that many of a brand."""
    cap = F.lit(40)
    tool = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.col("p_size").cast("string")).alias("params"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("tool"))
    first = table(spark, d, "part").select("p_brand", tool.alias("tool")).withColumn("place", place).where(F.col("place") <= 40 // X.LEAST_WORDS + 1)
    p = first.groupBy("p_brand").agg(F.sort_array(F.collect_list("tool")).alias("functions"))
    return p.select("p_brand", X.trimmed_tools("functions", cap).alias("block"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def chronology(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("a"), F.lit("1996-01-01T00:00:00Z").alias("b"))
    return I.chronology(o, "a", "b", "o_orderkey")


@query("SELECT event_id, event_id % 3 <> 1 AS blank FROM events")
def think_blocks(spark, d):
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.lit("a<think> \n </think>b")).when(n == 1, F.concat(F.lit("<think>"), F.col("event_type"), F.lit("</think>"))).otherwise("none")
    return table(spark, d, "events").select("event_id", K.blank_think_blocks(text).alias("blank"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 10 >= 6) AS verbatim, count(*) FILTER (WHERE user_id % 10 >= 6) AS twins, count(*) AS n, count(*) FILTER (WHERE event_id % 10 >= 6) >= 4 AND count(*) FILTER (WHERE user_id % 10 >= 6) <= 1 AS flagged FROM events GROUP BY event_type")
def canary_flags(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 10).alias("shared"), (F.col("user_id") % 10).alias("twin_shared"))
    return K.canary_flags(e, ["event_type"])


@query("SELECT 'c_mktsegment' AS parameter, count(DISTINCT c_mktsegment) AS n FROM customer HAVING count(DISTINCT c_mktsegment) > 1")
def shared_parameters(spark, d):
    c = table(spark, d, "customer").withColumn("same", F.lit(1))
    return K.disagreeing_parameters(c, ["c_mktsegment", "same"]).select("parameter", F.size("seen").cast("long").alias("n"))


@query("SELECT o_custkey AS run, count(*) AS found, max(c_nationkey)::BIGINT AS n_items FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING count(*) <> max(c_nationkey) UNION ALL SELECT c_custkey, NULL, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def incomplete_runs(spark, d):
    footers = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").cast("long").alias("n_items"))
    return K.incomplete_runs(table(spark, d, "orders").select(F.col("o_custkey").alias("run")), footers)
