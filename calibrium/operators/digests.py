"""Digests of tables of any size, as trees over ranges of rows in key order.

A digest of one group as one value would put the group into one task. Here rows get their place in key order
(`ranks.ranked`), every `per` places are a range with a digest of their rows in order, and every `per` ranges are hashed
into one of the next level, until a group has one. Ranges follow from places alone, so the value is the same for any
partitioning, and two trees tell in which ranges their tables differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.operators.ranks import ranked
from calibrium.sources.files import held

PER = 4096


def row_text(columns: list[str]) -> Column:
    """The columns as text, each with its length, so that no two rows read alike; null is ~."""
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    return F.concat(*[cell(c) for c in columns])


def _folded(rows: DataFrame, by: list[str], place: Column, text: str, *more: Column) -> DataFrame:
    """One row per place with the sha256 of its texts in order; at most `per` of them meet. rows: by, __at, text."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", text))), lambda x: x[text]), "\n")
    return rows.groupBy(*by, place.cast("long").alias("place")).agg(F.sha2(whole, 256).alias("sha256"), *more)


def digest_tree(rows: DataFrame, by: list[str], key: list[str], columns: list[str], per: int = PER, top: int | None = None) -> DataFrame:
    """by, level, place, n, first, last, sha256: ranges of rows at level 0, of ranges above; the highest of a group is its digest.

    With `top` levels at most beyond the first, a large group keeps several highest ranges, each with a digest of its own.
    key orders the rows; rows equal in key go by their text. first and last are the text of the keys that bound a range.
    """
    cells = {c: f"__c{i}" for i, c in enumerate([*key, *columns])}
    read = lambda names: row_text([cells[c] for c in names])
    bare = rows.select(*by, *[F.col(c).alias(name) for c, name in cells.items()])
    placed = ranked(bare, by, [*[F.col(cells[k]) for k in key], read([*key, *columns])], "__at").withColumns({"__key": read(key), "__text": read([*key, *columns])})
    edges = [F.count("*").alias("n"), F.min_by("__key", "__at").alias("first"), F.max_by("__key", "__at").alias("last")]
    level = held(_folded(placed, by, F.floor((F.col("__at") - 1) / per), "__text", *edges).withColumn("level", F.lit(0)))
    levels = [level]
    while top is None or len(levels) <= top:
        wide = level.groupBy(*by).agg(F.max("place").alias("__most")).where("__most > 0")
        if wide.isEmpty():
            break
        there = level
        if by:
            names = wide.select(*[F.col(c).alias(f"__w_{c}") for c in by])
            same = F.lit(True)
            for c in by:
                same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
            there = level.join(names, same, "left_semi")
        there = there.withColumnsRenamed({"place": "__at", "sha256": "__text", "n": "__n", "first": "__f", "last": "__l"})
        edges = [F.sum("__n").alias("n"), F.min_by("__f", "__at").alias("first"), F.max_by("__l", "__at").alias("last")]
        level = held(_folded(there, by, F.floor(F.col("__at") / per), "__text", *edges).withColumn("level", F.lit(len(levels))))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select(*by, "level", "place", "n", "first", "last", "sha256")


def digests(tree: DataFrame, by: list[str]) -> DataFrame:
    """by, n, sha256: the digest of each group."""
    return tree.groupBy(*by).agg(F.max_by("n", "level").alias("n"), F.max_by("sha256", "level").alias("sha256"))


def range_digests(tree: DataFrame, by: list[str]) -> DataFrame:
    """by, place, n, sha256: the digests of each group's highest ranges, of which a tree that ends at a level may have several."""
    high = tree.groupBy(*by).agg(F.max("level").alias("__high")).select(*[F.col(c).alias(f"__g_{c}") for c in by], "__high")
    same = F.col("level") == F.col("__high")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return tree.join(high, same).select(*by, "place", "n", "sha256")


def tampered(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by, place, first, last of the ranges of rows whose digests differ, or that one side lacks."""
    keys = [*by, "place"]
    a = before.where("level = 0").select(*keys, F.col("first").alias("__f"), F.col("last").alias("__l"), F.col("sha256").alias("__a"))
    b = after.where("level = 0").select(*[F.col(k).alias(f"__key_{k}") for k in keys], "first", "last", F.col("sha256").alias("__b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = a.join(b, same, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    pick = [F.when(F.col("__a").isNull(), F.col(f"__key_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.select(*pick, F.coalesce("__f", "first").alias("first"), F.coalesce("__l", "last").alias("last"))


def bound_to(calibrations: DataFrame, tree: DataFrame, by: list[str]) -> DataFrame:
    """by, status of calibrations (by, sha256): PASS if the digest is that of the run's rows, FAIL if another, none, or without rows."""
    have = digests(tree, by).select(*[F.col(c).alias(f"__key_{c}") for c in by], F.col("sha256").alias("__have"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return calibrations.join(have, same, "left").select(*by, F.when(F.col("sha256") == F.col("__have"), "PASS").otherwise("FAIL").alias("status"))
