"""Report tables as text: every number is copied from a metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators.compare import within_noise


def results_table(cells: DataFrame, noise: DataFrame, key: str = "gauge") -> DataFrame:
    """key, metric, shown: percent with interval, marked by a dagger where another row is within noise. cells: key, metric, value, lo, hi."""
    marked = noise.select(F.col("left_key").alias(key), F.lit("†").alias("mark")).distinct()
    joined = cells.join(marked, key, "left")
    return joined.select(key, "metric", F.concat(V.percent_with_interval(F.col("value"), F.col("lo"), F.col("hi")), F.coalesce("mark", F.lit(""))).alias("shown"))


def marked_table(cells: DataFrame, metrics: list[str], key: str = "gauge", by: list[str] | None = None) -> DataFrame:
    """A row per key with one column of text per metric: percent with its interval, and a dagger where the interval of
    another row meets it. cells: by, key, metric, value, lo, hi; a value without interval is within no noise."""
    by = by or []
    noise = within_noise(cells.where("lo IS NOT NULL"), key, [*by, "metric"]).select(*by, F.col("left_key").alias(key), "metric", F.lit("†").alias("mark")).distinct()
    shown = F.concat(V.percent_with_interval(F.col("value"), F.col("lo"), F.col("hi")), F.coalesce("mark", F.lit("")))
    joined = cells.join(noise, [*by, key, "metric"], "left").withColumn("shown", shown)
    return joined.groupBy(*by, key).agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("shown"))), F.lit("—")).alias(m) for m in metrics])


def set_summary(items: DataFrame, labels: list[str], label: str = "label", split: str = "split") -> DataFrame:
    """Items in all and by label: of the whole set, of the fit and of the exam split, absent ones as 0."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col(label) == x).alias(x) for x in labels]]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    names = items.sparkSession.createDataFrame([("set",), ("fit",), ("exam",)], "part string")
    parts = items.agg(*counts).withColumn("part", F.lit("set")).unionByName(items.groupBy(F.col(split).alias("part")).agg(*counts))
    return names.join(parts, "part", "left").select("part", zero("total"), *map(zero, labels))


def drop_lines(dropped: DataFrame, reasons: dict[str, str], file: str = "file", reason: str = "drop_reason") -> DataFrame:
    """One line per reason: how many items it cost, and of which files. A reason that cost none is told as well."""
    by_file = dropped.groupBy(reason, file).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(file).alias("f"), F.col("n").alias("n")))), lambda x: F.concat(x["f"], F.lit(": "), x["n"].cast("string"))), ", ")
    each = by_file.groupBy(reason).agg(F.sum("n").alias("n"), listed.alias("files"))
    names = dropped.sparkSession.createDataFrame(list(reasons.items()), f"{reason} string, what string")
    n = F.coalesce("n", F.lit(0))
    items = F.concat(n.cast("string"), F.when(n == 1, " item").otherwise(" items"))
    return names.join(each, reason, "left").select(reason, F.concat(F.lit("Dropped for "), "what", F.lit(": "), items, F.when(n > 0, F.concat(F.lit(" ("), "files", F.lit(")"))).otherwise(""), F.lit(".")).alias("line"))


def stale(sections: DataFrame, made: DataFrame, key: str = "section", text: str = "text") -> DataFrame:
    """Sections of a report that aren't, letter by letter, what the tables give now: key, fault (changed, missing, extra)."""
    a, b = sections.select(key, F.col(text).alias("__have")), made.select(key, F.col(text).alias("__want"))
    fault = F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "extra").when(F.col("__have") != F.col("__want"), "changed")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault IS NOT NULL")


def arrow(raw, calibrated):
    """"0.106 → 0.041"."""
    number = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("—"))
    return F.concat(number(raw), F.lit(" → "), number(calibrated))


def markdown(table: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small table as Markdown, in order."""
    rows = table.select(*columns).orderBy(*order).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("—" if x is None else str(x) for x in r) + " |" for r in rows]) + "\n"


def unfulfilled(promised: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return promised.join(found, key, "left_anti")
