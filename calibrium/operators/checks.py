"""Integrity checks: each gives rows that break a rule, or one row with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.functions import vectors as V
from calibrium.operators.ranks import carried
from calibrium.sources.files import held


def missing_and_extra(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: side, key."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("extra").alias("side"), key).union(b.join(a, key, "left_anti").select(F.lit("missing").alias("side"), key))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def disagreeing(have: DataFrame, want: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on both sides whose values differ."""
    return have.select(key, F.col(value).alias("have")).join(want.select(key, F.col(value).alias("want")), key).where(~F.col("have").eqNullSafe(F.col("want")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def contract_report(rows: DataFrame, by: list[str], vector: str, k: int = 3) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~V.meets_contract(F.col(vector), k)).alias("broken"))


def set_status(breaks: DataFrame, name: str) -> DataFrame:
    """One row: PASS if no row breaks the rule."""
    return breaks.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), "n")


def status_rollup(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def in_force(events: DataFrame, versions: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """As-of join: for each event the value of the latest version strictly before it, null if there is none.

    Both sides are put on one time line per group and the last value is carried on, within ranges of the line and then
    across them, so there is no range join and no task holds a group; at equal times events come first, which makes the
    bound strict.
    """
    sides = [c for c in events.columns if c not in by]
    a = events.select(*by, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*sides).alias("__row"), F.lit(None).cast(versions.schema[value].dataType).alias("__value"))
    b = versions.select(*by, F.col(since).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    return carried(a.union(b), by, ["__t", "__side"], "__value", "in_force").where("__side = 0").select(*by, *[F.col("__row")[c].alias(c) for c in sides], "in_force")


def not_append_only(texts: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Versions whose text doesn't begin with the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    return texts.withColumn("before", F.lag(text).over(w)).where("before IS NOT NULL AND NOT startswith({0}, before)".format(text)).drop("before")


def failure_streaks(rows: DataFrame, by: list[str], order: str, failed: Column) -> DataFrame:
    """Runs of failures: first, last and length of each."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__bad", failed).withColumn("__run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "__bad").orderBy(order)))
    return marked.where("__bad").groupBy(*by, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__run")


def unknown_numbers(report: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """Canonical numbers of a report that no source text holds."""
    numbers = lambda df: df.select(F.explode(X.number_tokens(F.col(text))).alias("t")).select(X.canonical_number(F.col("t")).alias("number")).where("number IS NOT NULL").distinct()
    return numbers(report).join(numbers(sources), "number", "left_anti")


def secrets_in(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.where(F.col(text).rlike(X.SECRET)).select(key)


def json_numbers(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Every number of a JSON text, within strings too, without those of keys."""
    bare = F.regexp_replace(F.col(body), r'"(?:[^"\\]|\\.)*"\s*:', "")
    return documents.select(key, F.explode(F.regexp_extract_all(bare, F.lit(r"-?" + X.NUMBER), F.lit(0))).alias("token"))


def tree_numbers(documents: DataFrame, key: str, body: str) -> DataFrame:
    """key, number: every number of a JSON tree (variant) and in its texts, in canonical form, without those of keys.

    The tree is walked level by level, all documents at once; a level without objects and arrays is the last.
    """
    spark, level, out = documents.sparkSession, documents.select(key, F.col(body).alias("v")), None
    while True:
        level = held(level.withColumn("kind", F.schema_of_variant("v")))
        inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        text = F.col("v").cast("string")
        number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        tokens = F.when(number, F.array(text)).when(F.col("kind") == "STRING", X.number_tokens(text))
        found = level.where(~inner).select(key, F.explode(tokens).alias("t")).select(key, X.canonical_number(F.col("t")).alias("number")).where("number IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        nested = level.where(inner)
        if nested.isEmpty():
            return out
        level = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("inside"))).select(key, F.col("inside").alias("v"))


def fingerprint(rows: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """sha256 of each group's rows in key order, as compact JSON, for groups that fit a task; `digests` is for any size."""
    return rows.groupBy(*by).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(key, *columns)))), 256).alias("sha256"), F.count("*").alias("n"))


def python_fingerprint(pairs: list[tuple[str, list[float]]]) -> str:
    """sha256 of compact JSON [[id, scores], ...] by id, with Python's shortest floats."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([[i, list(x)] for i, x in sorted(pairs)], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def chronology(rows: DataFrame, earlier: str, later: str, key: str) -> DataFrame:
    """Rows whose two times are not in strict order; times without a zone are UTC."""
    return rows.where(~(F.to_timestamp(earlier) < F.to_timestamp(later)) | F.col(earlier).isNull() | F.col(later).isNull()).select(key)


def sealed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, content) whose sha256 isn't the manifest's (name, sha256), or that it lacks."""
    have = files.select("name", F.sha2("content", 256).alias("have"))
    return have.join(manifest.select("name", F.col("sha256").alias("want")), "name", "left").where(~F.col("have").eqNullSafe(F.col("want")))


def license_lines(cards: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """First line of each card that begins with license:, and how many there are: none FAILs, more than one WARNs."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("license:"))
    n = F.size(lines)
    return cards.select(name, F.get(lines, F.lit(0)).alias("line"), n.alias("n"), F.when(n == 0, "FAIL").when(n > 1, "WARN").otherwise("PASS").alias("status"))
