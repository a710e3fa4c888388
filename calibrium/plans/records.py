"""Queries over files, records and order: what is read, written, refused and listed around the metrics, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.functions import vectors as V
from calibrium.operators import calibration as C
from calibrium.operators import checks as I
from calibrium.operators import dataset as D
from calibrium.operators import gauges as G
from calibrium.operators import guards as K
from calibrium.operators import metrics as M
from calibrium.operators import order as O
from calibrium.operators import report as R
from calibrium.operators.ranks import ranked
from calibrium.plans import fixtures as X0
from calibrium.plans.fixtures import EMISSIONS_SQL, ITEMS_SQL, TERMS_SQL, metrics_sql, table
from calibrium.plans.more import QUERIES, SQL, query
from calibrium.sources import files as S

__all__ = ["QUERIES", "SQL"]
BY = ["gauge", "split"]


# Sources and sinks


@query("SELECT n_nationkey, 'set_v3_' || lower(n_name) || '.json' AS expected, CASE WHEN n_nationkey % 3 = 0 THEN 'set_v3_' || lower(n_name) || '.json' WHEN n_nationkey % 3 = 1 THEN 'set_v1_' || lower(n_name) || '.json' END AS found FROM nation")
def resolved_files(spark, d):
    """Expected files, of which a third is present, a third present under other versions, a third missing."""
    name = lambda v: F.concat(F.lit(f"set_v{v}_"), F.lower("n_name"), F.lit(".json"))
    n = table(spark, d, "nation")
    present = n.where("n_nationkey % 3 = 0").select(name(3).alias("name")).union(n.where("n_nationkey % 3 < 2").select(name(1)))
    present = present.union(n.where("n_nationkey % 3 = 1").select(name(2)))
    found = D.resolve_files(n.select(name(3).alias("name")), present).select("expected", "found")
    return n.select("n_nationkey", name(3).alias("expected")).join(found, "expected").select("n_nationkey", "expected", "found")


@query("SELECT n_nationkey, starts_with(n_name, 'A') OR (n_name LIKE '_R%' AND length(n_name) = 6) AS excluded FROM nation")
def glob_excluded(spark, d):
    return table(spark, d, "nation").select("n_nationkey", O.excluded_by_glob(F.col("n_name"), ["A*", "?R????"]).alias("excluded"))


@query("SELECT n_nationkey::VARCHAR AS id, 'choice' AS type, ['none', 'one', 'several'][n_nationkey % 3 + 1] AS choice, 0.25::DOUBLE AS p_none, (n_nationkey * 10)::BIGINT AS input_tokens, (n_nationkey + 1)::BIGINT AS output_tokens FROM nation WHERE n_nationkey % 5 > 0")
def raw_response_scan(spark, d):
    """A file per answer, named by its id; error files beside them are passed over."""
    path = S.scratch(spark, "raw")
    n = table(spark, d, "nation")
    choice = F.element_at(F.array(*[F.lit(o) for o in X0.OPTIONS]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    body = F.format_string('{"answers": {"q": {"type": "choice", "choice": "%s", "probabilities": {"none": 0.25}}}, "usage": {"input_tokens": %d, "output_tokens": %d}}', choice, F.col("n_nationkey") * 10, F.col("n_nationkey") + 1)
    folder = F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 5 == 0, ".err").otherwise(""), F.lit(".json"))
    n.select(folder.alias("name"), body.alias("value")).repartition("name").write.partitionBy("name").text(path)
    read = spark.read.text(f"{path}/*", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/", 1).alias("file"), F.try_parse_json("value").alias("body"))
    return S.raw_responses(read, "q").select("id", "type", "choice", F.col("probabilities")["none"].alias("p_none"), "input_tokens", "output_tokens")


@query("SELECT event_id AS n, user_id::VARCHAR AS id, CASE event_id % 3 WHEN 0 THEN 'bad [redacted] of ' || event_type WHEN 1 THEN 'key [redacted]' END AS error FROM events")
def ledger_scan(spark, d):
    """Calls appended to a ledger in two goes, secrets blotted out, and read back."""
    path = S.scratch(spark, "ledger")
    n = F.col("event_id")
    error = F.when(n % 3 == 0, F.concat(F.lit("bad hush-hush of "), F.col("event_type"))).when(n % 3 == 1, F.concat(F.lit("key sk-"), F.sha2(n.cast("string"), 256)))
    calls = table(spark, d, "events").select(n.alias("n"), F.col("user_id").cast("string").alias("id"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), error.alias("error"))
    for half in (0, 1):
        S.append_ledger(calls.where(F.col("n") % 2 == half), path, ["hush-hush"])
    return S.read_ledger(spark, path).select("n", "id", "error")


@query("SELECT r_regionkey AS part, substr(md5('one') || md5('two'), 1, 40) AS revision FROM region WHERE r_regionkey = 0 UNION ALL SELECT r_regionkey, NULL FROM region WHERE r_regionkey = 1")
def dataset_revision(spark, d):
    """Metadata files that share their first line, and a folder where one differs."""
    line = F.substring(F.concat(F.md5(F.lit("one")), F.md5(F.lit("two"))), 1, 40)
    out = None
    for part in (0, 1):
        path = S.scratch(spark, "revision")
        first = F.when((F.col("r_regionkey") == 3) & (F.lit(part) == 1), F.lit("other")).otherwise(line)
        table(spark, d, "region").select("r_name", F.concat(first, F.lit("\nmore")).alias("value")).repartition("r_name").write.partitionBy("r_name").text(path)
        one = S.revision(spark, f"{path}/*").select(F.lit(part).cast("long").alias("part"), "revision")
        out = one if out is None else out.union(one)
    return out.withColumn("part", F.col("part").cast(table(spark, d, "region").schema["r_regionkey"].dataType))


@query("SELECT 2::BIGINT AS versions, (SELECT count(*) FROM nation) AS rows, true AS refused")
def versions_and_refusal(spark, d):
    """A block written twice is two versions; a result written twice without leave is refused."""
    blocks, lines = S.scratch(spark, "blocks"), S.scratch(spark, "once")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    S.append_version(n, blocks)
    S.append_version(n, blocks)
    S.write_jsonl(n, lines, ["n_nationkey"])
    refused = False
    try:
        S.write_jsonl(n, lines, ["n_nationkey"])
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    counted = spark.read.option("recursiveFileLookup", False).parquet(blocks).agg(F.count_distinct("version").alias("versions"))
    return counted.withColumns({"rows": F.lit(spark.read.text(lines).count()).cast("long"), "refused": F.lit(refused)})


@query("SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN '../' || n_name WHEN 2 THEN '.' || n_name WHEN 3 THEN n_name || chr(92) || 'x' ELSE '' END AS asked, n_nationkey % 5 = 0 AS accepted FROM nation")
def result_names(spark, d):
    """Names asked for, of which only bare ones may be a result's."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey") % 5
    asked = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("../"), "n_name")).when(k == 2, F.concat(F.lit("."), "n_name")).when(k == 3, F.concat("n_name", F.lit("\\x"))).otherwise("")
    return n.select(F.col("n_name").alias("name"), asked.alias("asked"), S.is_bare_name(asked).alias("accepted"))


@query("SELECT vec_id AS id, len(embedding) AS width, embedding[1]::DOUBLE AS first FROM embeddings")
def feature_round_trip(spark, d):
    """Features written as Parquet by id, and read back."""
    path = S.scratch(spark, "features")
    e = table(spark, d, "embeddings")
    e.select(F.col("vec_id").alias("id"), "embedding").write.parquet(path)
    return spark.read.parquet(path).select("id", F.size("embedding").cast("long").alias("width"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("SELECT r_name AS name, r_regionkey % 2 = 1 AS missing FROM region WHERE r_regionkey > 1")
def broken_seals(spark, d):
    """Files against a manifest that lacks some and has another digest for others."""
    r = table(spark, d, "region")
    files = r.select(F.col("r_name").alias("name"), F.col("r_name").cast("binary").alias("content"))
    manifest = r.where("r_regionkey < 2 OR r_regionkey % 2 = 0").select(F.col("r_name").alias("name"), F.sha2(F.when(F.col("r_regionkey") < 2, F.col("r_name")).otherwise("other"), 256).alias("sha256"))
    return I.sealed(files, manifest).select("name", F.col("want").isNull().alias("missing"))


# Values and guards


@query("SELECT o_orderkey, (list_position(['no-call', 'one-call', 'multi-call'], ['no-call', 'one-call', 'multi-call'][o_orderkey % 3 + 1]) - 1)::INT AS y FROM orders")
def label_indices(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in V.LABELS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", V.label_index(label).alias("y"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 1 THEN NULL ELSE round(value, 4) END AS x FROM events")
def rounded_or_null(spark, d):
    n = F.col("event_id") % 4
    x = F.when(n == 0, float("nan")).when(n == 1, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", V.rounded(x).alias("x"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'blank event_type' END, CASE WHEN event_id % 7 = 0 THEN 'label' END], lambda x: x IS NOT NULL), ', ') AS faults FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def item_schema_faults(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 14 == 0, "two").when(F.col("event_id") % 7 != 0, "one-call").alias("label"))
    return K.item_faults(e, "event_id", ["event_type"], "label", V.LABELS)


@query("SELECT vec_id::VARCHAR AS key, CASE WHEN vec_id % 5 = 0 THEN 'class' WHEN vec_id % 7 = 0 THEN 'shape' ELSE 'number' END AS fault FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0 OR vec_id % 11 = 0")
def metric_input_faults(spark, d):
    n = F.col("vec_id")
    v = F.when(n % 7 == 0, F.array(F.lit(1.0))).when(n % 11 == 0, F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return M.input_faults(table(spark, d, "embeddings").select("vec_id", F.when(n % 5 == 0, 3).otherwise(0).alias("y"), v.alias("v")), "vec_id", "y", "v")


@query("SELECT n_name AS gauge, CASE n_nationkey % 5 WHEN 0 THEN 'no record' WHEN 1 THEN 'other target' WHEN 2 THEN 'temperature' ELSE 'thresholds' END AS fault FROM nation WHERE n_nationkey % 5 < 4")
def calibration_fault_list(spark, d):
    n = F.col("n_nationkey") % 5
    gauges = table(spark, d, "nation").select(F.col("n_name").alias("gauge"), "n_nationkey")
    taus = F.when(n == 3, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)))
    records = gauges.where(n > 0).select("gauge", F.when(n == 1, 0.9).otherwise(0.95).alias("sa_target"), F.when(n == 2, -1.0).otherwise(1.5).alias("T"), taus.alias("taus"))
    return K.calibration_faults(records, gauges, 0.95)


@query("SELECT n_name AS gauge, array_to_string(list_filter([CASE WHEN n_nationkey % 3 = 0 THEN 'T' END, CASE WHEN n_nationkey % 4 = 0 THEN 'taus' END], lambda x: x IS NOT NULL), ', ') AS changed FROM nation")
def record_verification(spark, d):
    """Stored records against new derivations: other temperatures and thresholds are told, added keys aren't."""
    n = F.col("n_nationkey")
    made = lambda t, taus, *more: F.create_map(F.lit("T"), t, F.lit("method"), F.lit("fixed"), F.lit("taus"), taus, *more)
    derived = made(F.lit("1.0"), F.lit(None).cast("string"))
    stored = made(F.when(n % 3 == 0, "1.5").otherwise("1.0"), F.when(n % 4 == 0, "0.5,0.5,0.5"), F.lit("note"), F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_name").alias("gauge"), F.array_join(K.changed_entries(stored, derived), ", ").alias("changed"))


@query("SELECT conv_id, turn, 'role: ' || role || chr(10) || 'text: ' || text AS prompt FROM conversations")
def rendered_prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", K.rendered("role: {role}\ntext: {text}", role=F.col("role"), text=F.col("text")).alias("prompt"))


@query("SELECT n_name AS name, sha256('{\"key\":\"' || n_nationkey || '\",\"name\":\"' || n_name || '\"}') AS sha256, true AS same FROM nation")
def prompt_spec_hash(spark, d):
    """Digests of specifications; the order of keys makes no difference."""
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    one, two = K.spec_sha256(F.create_map(F.lit("key"), key, F.lit("name"), name)), K.spec_sha256(F.create_map(F.lit("name"), name, F.lit("key"), key))
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), one.alias("sha256"), (one == two).alias("same"))


@query(f"WITH {EMISSIONS_SQL} SELECT split, sha256('[' || string_agg('{{\"event_id\":' || event_id || ',\"decision\":' || decision || ',\"parse_ok\":' || (parse_error IS NULL) || '}}', ',' ORDER BY event_id) || ']') AS sha256, count(*) AS n FROM emitted GROUP BY split")
def emission_fingerprint(spark, d):
    e = X0.emission_rows(spark, d).select("event_id", "split", X.parsed_emission(F.col("raw")).alias("x"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in V.LABELS]), F.col("x.decision")), F.lit(0)), F.lit(0)) - 1
    return I.fingerprint(e.select("event_id", "split", place.alias("decision"), F.col("x.parse_ok").alias("parse_ok")), ["split"], "event_id", ["decision", "parse_ok"])


@query("SELECT conv_id, turn, '<s> ' || array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ' ') AS tokens FROM conversations WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
def start_marks(spark, d):
    """Token arrays, every other one with a start mark already, to exactly one mark."""
    w = X.words(F.col("text"))
    marked = F.when(F.col("turn") % 2 == 0, F.array_prepend(w, F.lit("<s>"))).otherwise(w)
    c = table(spark, d, "conversations").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return c.select("conv_id", "turn", F.array_join(K.with_one_start(marked, "<s>"), " ").alias("tokens"))


# Aggregates and order


@query(f"WITH {TERMS_SQL}, m AS ({metrics_sql('terms', 'gauge, split')}) SELECT gauge, split, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(nll, 6) AS nll, round(ece, 6) AS ece, NULL::DOUBLE AS ask_rate, NULL::DOUBLE AS selective_accuracy, 'no thresholds' AS na FROM m WHERE gauge = 'A' UNION ALL SELECT gauge, split, n, round(accuracy, 6), round(macro_f1, 6), NULL, NULL, NULL, NULL, 'no thresholds, no confidence' FROM m WHERE gauge = 'B'")
def no_threshold_metrics(spark, d):
    t = X0.terms(spark, d)
    both = M.without_thresholds(t.where("gauge = 'A'"), BY).union(M.without_thresholds(t.where("gauge = 'B'"), BY, has_confidence=False))
    return both.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "nll", "ece")})


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS ties, count(*) FILTER (WHERE (user_id % 2) <> CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) AS off_argmax FROM events GROUP BY event_type")
def choice_ties(spark, d):
    n = F.col("event_id") % 3
    v = F.when(n == 0, F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).when(n == 1, F.array(F.lit(0.6), F.lit(0.2), F.lit(0.2))).otherwise(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2)))
    return G.tie_counts(table(spark, d, "events").select("event_type", v.alias("v"), (F.col("user_id") % 2).cast("int").alias("c")), ["event_type"], "v", "c")


@query("SELECT role, round(avg(k), 6) AS mean_tokens, max(k) AS max_tokens, count(*) FILTER (WHERE k > 12) AS truncated FROM (SELECT role, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::INT AS k FROM conversations) GROUP BY role")
def prompt_token_rollup(spark, d):
    c = table(spark, d, "conversations").select("role", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("k"))
    return K.token_rollup(c, ["role"], "k", 12).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 40")
def first_items(spark, d):
    """The first forty items: the limit is the feature."""
    return O.first_rows(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 40)


@query(f"WITH {ITEMS_SQL} SELECT a.id, -a.id AS ord, CASE WHEN b.id % 9 <> 0 THEN b.y END AS y FROM items a LEFT JOIN items b ON b.id = a.id AND b.gauge = 'B' WHERE a.gauge = 'A'")
def rows_in_run_order(spark, d):
    """Rows of gauge B in the order of gauge A's run, which went backwards; those that B lacks stay as gaps."""
    x = X0.items(spark, d)
    order = x.where("gauge = 'A'").select("id", (-F.col("id")).alias("ord"))
    return O.in_order_of(x.where("gauge = 'B' AND id % 9 <> 0").select("id", "y"), order, "id").orderBy("ord").select("id", "ord", "y")


@query("SELECT n_name, row_number() OVER (ORDER BY CASE n_name WHEN 'PERU' THEN 1 WHEN 'CHINA' THEN 2 ELSE 3 END, n_name)::INT AS place FROM nation")
def preferred_order(spark, d):
    """Report rows: named ones first, the others by name. One row for each gauge of a report, so one window."""
    n = table(spark, d, "nation").withColumn("k", O.preferred_place(F.col("n_name"), ["PERU", "CHINA"]))
    return n.select("n_name", F.row_number().over(Window.orderBy("k")).alias("place"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, list_position(l, lang) AS i, len(l) AS m FROM documents, (SELECT list(DISTINCT lang ORDER BY lang) AS l FROM documents)) WHERE k <= 50 // m + CASE WHEN i <= 50 % m THEN 1 ELSE 0 END")
def capped_subset(spark, d):
    """Fifty documents, evenly over the languages: the cap is the feature."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return O.capped(docs, "lang", sorted(r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()), "doc_id", 50)


@query("SELECT event_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT 'user ' || lpad(user_id::VARCHAR, 8, '0')))[1:5], '; ') AS shown FROM events GROUP BY event_type")
def first_faults(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("user "), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("fault"))
    return O.listed_faults(e, ["event_type"], "fault")


@query("SELECT DISTINCT trim(k::VARCHAR) AS number, dense_rank() OVER (ORDER BY k)::INT AS place FROM (SELECT p_size AS k FROM part)")
def numbers_in_order(spark, d):
    """Distinct numbers of a report in the order of their values, not of their text."""
    tokens = table(spark, d, "part").select(X.canonical_number(F.col("p_size").cast("string")).alias("number")).distinct()
    return ranked(tokens, [], [F.col("number").cast("decimal(38,18)")]).select("number", F.col("place").cast("int").alias("place"))


@query("SELECT event_id, printf('%.6f', (event_id % 1000) / 1000000.0::DOUBLE) AS shown FROM events")
def positional_numbers(spark, d):
    """Small numbers in positional form; their text would be scientific."""
    x = (F.col("event_id") % 1000) / 1_000_000.0
    return table(spark, d, "events").select("event_id", F.format_string("%.6f", x).alias("shown"))


@query(f"WITH {TERMS_SQL}, m AS ({metrics_sql('terms', 'gauge, split')}) SELECT gauge, 'accuracy' AS metric, printf('%.1f', accuracy * 100) || CASE gauge WHEN 'A' THEN '†' ELSE '' END AS shown FROM m WHERE split = 'exam'")
def results_with_daggers(spark, d):
    m = M.metrics(X0.terms(spark, d), BY).where("split = 'exam'")
    none = F.lit(None).cast("double")
    cells = m.select("gauge", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), none.alias("lo"), none.alias("hi"))
    return R.results_table(cells, spark.createDataFrame([("A", "B")], "left_key string, right_key string"))


@query("SELECT event_id FROM events WHERE event_id % 50 = 0")
def planted_secrets(spark, d):
    n = F.col("event_id")
    text = F.when(n % 50 == 0, F.concat(F.lit("see token-"), F.md5(n.cast("string")))).otherwise(F.concat(F.lit("tokens: "), n.cast("string")))
    return I.secrets_in(table(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text")
