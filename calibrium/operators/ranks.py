"""Running sums, ranks and carried values over groups of any size.

A window over a group is one task, however large the group. Here rows are put into ranges of (group, order) instead, so
a hot group has as many ranges as it needs; each range is summed up for itself, and what the ranges before it amount to
is added. A group that lies in one range needs no addition, and only a range's first group can have begun in an earlier
one, so the additions are at most as many as ranges: a broadcast bounded by the number of partitions.

Ranges are held in the shared folder, so that all passes see the same ones, also after executors are lost. Rows that are
equal in group and order are told apart by where they were read, so they don't gather in one range either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.sources.files import held

#: Groups, each counted once for every range that it reaches into, up to which their starts are broadcast.
STARTS = 200_000


def in_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with `__range`, ascending with (by, order), and `__tie`; held."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    return held(tied.repartitionByRange(*by, *order, "__tie").withColumn("__range", F.spark_partition_id()))


def _added(at: DataFrame, before: DataFrame, by: list[str], columns: list[Column], few: bool = True) -> DataFrame:
    """at with columns of `before`, which has a row for each range's first group at most, or else is not `few`."""
    small = before.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], "__before")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    return at.join(F.broadcast(small) if few else small, same, "left").select(*columns)


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the group's rows up to this one in `order`."""
    kept = [F.col(c) for c in rows.columns if c != name]
    at = in_ranges(rows.withColumn("__value", value), by, order)
    up_to = Window.partitionBy("__range", *by).orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = at.groupBy("__range", *by).agg(F.sum("__value").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.withColumn("__before", F.sum("__n").over(earlier)).where("__before IS NOT NULL")
    local = at.withColumn("__local", F.sum("__value").over(up_to))
    return _added(local, before, by, [*kept, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(name)])


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in the group, from 1; of rows equal in `order` any comes first.

    Ranges are sorted as they are written, with each row's number in its range. Where a group starts in a range, and its rows
    in earlier ranges, then give the place: rows move once, and what orders them isn't carried along.
    """
    kept = [F.col(c) for c in rows.columns if c != name]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    put = tied.repartitionByRange(*by, *order, "__tie").sortWithinPartitions(*by, *order, "__tie").drop("__tie")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = held(put.withColumns({"__range": F.spark_partition_id(), "__number": number}))
    each = at.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__number").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1
    starts = held(each.select("__range", *by, before.alias("__before")))
    return _added(at, starts, by, [*kept, (F.col("__number") + F.col("__before")).alias(name)], starts.limit(STARTS + 1).count() <= STARTS)


def carried(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value that isn't null among the group's rows up to this one in ascending `order`."""
    kept = [F.col(c) for c in rows.columns if c != name]
    at = in_ranges(rows, by, [F.col(c) for c in order])
    up_to = Window.partitionBy("__range", *by).orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order, "__tie")))
    each = at.groupBy("__range", *by).agg(latest.alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)).where("__before IS NOT NULL")
    local = at.withColumn("__local", F.last(value, ignorenulls=True).over(up_to))
    return _added(local, before, by, [*kept, F.coalesce("__local", F.col("__before")[value]).alias(name)])
