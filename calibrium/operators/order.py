"""Order of rows and subsets of it: first rows, another run's order, preferred names, capped groups, bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.operators.ranks import ranked


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n first rows; every task keeps its own n, so nothing else is moved."""
    return rows.orderBy(*order).limit(n)


def in_order_of(rows: DataFrame, order: DataFrame, key: str, place: str = "ord") -> DataFrame:
    """rows that `order` (key, place) names, with its place; a name without a row is kept with nulls, so that a gap shows."""
    return order.select(key, place).join(rows, key, "left")


def preferred_place(name: Column, preferred: list[str]) -> Column:
    """Sort key: preferred names in their order, all others after them by name."""
    return F.struct(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in preferred]), name), F.lit(0)), F.lit(len(preferred) + 1)).alias("place"), name.alias("name"))


def capped(rows: DataFrame, label: str, labels: list, key: str, cap: int) -> DataFrame:
    """At most `cap` rows: an equal share of each label and one more of the first labels for the remainder, least keys first."""
    share, more = divmod(cap, len(labels))
    sizes = rows.sparkSession.createDataFrame([(x, share + (i < more)) for i, x in enumerate(labels)], f"{label} {rows.schema[label].dataType.simpleString()}, k int")
    return ranked(rows, [label], [F.col(key)], "__place").join(F.broadcast(sizes), label).where(F.col("__place") <= F.col("k")).drop("__place", "k")


def listed_faults(faults: DataFrame, by: list[str], fault: str, n: int = 5) -> DataFrame:
    """How many rows have a fault, and the n least different ones as text. Tasks keep n of a group each, so no task sees a whole one."""
    distinct = faults.groupBy(*by, fault).agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(fault))
    least = distinct.withColumn("__place", place).where(F.col("__place") <= n).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(fault)), "; ").alias("shown"))
    return distinct.groupBy(*by).agg(F.sum("__n").alias("n")).join(least, by)


def excluded_by_glob(name: Column, globs: list[str]) -> Column:
    """Whether a whole name fits one of the globs: * is any run of characters, ? any one."""
    out = F.lit(False)
    for g in globs:
        out = out | name.like(g.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_"))
    return F.coalesce(out, F.lit(False))
