"""What must hold before a sealed split is scored: labels, ids, order, files and registration, each as rows of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.operators.ranks import ranked

SHOWN = 5


def truth_faults(rows: DataFrame, labels: list[str], key: str = "id", label: str = "label") -> DataFrame:
    """key, fault of a split file's rows: a null key, a key that occurs again, a label out of the domain; `empty` without rows.

    A row may have several faults; a repeated key is told once.
    """
    each = rows.groupBy(key).agg(F.count("*").alias("__n"), F.count_if(F.coalesce(~F.col(label).isin(labels), F.lit(True))).alias("__odd"))
    found = F.array_compact(F.array(F.when(F.col(key).isNull(), "no key"), F.when(F.col(key).isNotNull() & (F.col("__n") > 1), "repeated"), F.when(F.col("__odd") > 0, "label")))
    listed = each.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("fault"))
    return listed.union(rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string"), F.lit("empty")))


def load_truth(rows: DataFrame, labels: list[str], key: str = "id", label: str = "label") -> DataFrame:
    """key and label only; refused if there is any fault."""
    refuse(truth_faults(rows, labels, key, label), "split file")
    return rows.select(key, label)


def split_faults(rows: DataFrame, truth: DataFrame, key: str = "id", label: str = "label", subset: bool = False) -> DataFrame:
    """key, fault of a gauge's rows against the split file: extra and missing keys, other labels, repeated keys.

    A subset may lack keys. One full join on the key, after equal keys were counted.
    """
    have = rows.groupBy(key).agg(F.count("*").alias("__n"), F.min(label).alias("__least"), F.max(label).alias("__most"), F.count_if(F.col(label).isNull()).alias("__none"))
    both = have.join(truth.select(key, F.col(label).alias("__want"), F.lit(True).alias("__known")), key, "full")
    wrong = (F.col("__none") > 0) | ~F.col("__least").eqNullSafe(F.col("__want")) | ~F.col("__most").eqNullSafe(F.col("__want"))
    here, known = F.col("__n").isNotNull(), F.col("__known").isNotNull()
    missing = F.lit(None).cast("string") if subset else F.when(~here, "missing")
    found = F.array_compact(F.array(missing, F.when(~known, "extra"), F.when(here & known & wrong, "label"), F.when(F.col("__n") > 1, "repeated")))
    return both.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("fault"))


def order_faults(a: DataFrame, b: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """place, left_key, right_key wherever two runs don't have the same item; a longer run's surplus is met by nulls.

    Places are ranks by ranges, so runs of any size are compared place by place in one join.
    """
    side = lambda df, name: ranked(df.select(F.col(key).alias(name), F.col(order).alias("__o")), [], [F.col("__o"), F.col(name)]).select("place", name)
    return side(a, "left_key").join(side(b, "right_key"), "place", "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def file_faults(files: DataFrame) -> DataFrame:
    """file, fault of result files: `partial` (a checkpoint left behind), `empty`, `count` (items and failures aren't what
    the file declares), `vectors` (some break the contract). files: file, partial, n_items, n_failed, n_fit, n_exam, n_broken.

    A partial file is told as such only: it is no gauge.
    """
    total = F.col("n_items") + F.coalesce("n_failed", F.lit(0))
    fault = (
        F.when(F.coalesce("partial", F.lit(False)) | F.col("file").endswith(".partial.json"), "partial").when(F.coalesce("n_items", F.lit(0)) == 0, "empty")
        .when(total != F.col("n_fit") + F.col("n_exam"), "count").when(F.col("n_broken") > 0, "vectors")
    )
    return files.select("file", fault.alias("fault")).where("fault IS NOT NULL")


def registration_faults(sections: DataFrame, text: Column, heading: Column, digest: Column, at: Column, since: Column) -> DataFrame:
    """name, fault of runs that aren't registered: the text lacks the heading as a line of its own, what follows it lacks the
    prompt's digest, or it was registered no earlier than the run began."""
    lines, line = F.concat(F.lit("\n"), text, F.lit("\n")), F.concat(F.lit("\n"), heading, F.lit("\n"))
    place = F.call_function("position", line, lines)
    there, after = place > 0, F.substr(lines, place + F.length(line))
    fault = F.when(~F.coalesce(there, F.lit(False)), "no section").when(~F.coalesce(F.contains(after, digest), F.lit(False)), "other prompt").when(~F.coalesce(since < at, F.lit(False)), "registered late")
    return sections.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def refuse(faults: DataFrame, what: str) -> None:
    """Raises if there is a fault, telling how many of each kind and the least few of them."""
    counts = {r.fault: r["count"] for r in faults.groupBy("fault").count().collect()}  # as many rows as there are kinds
    if counts:
        some = [tuple(r) for r in faults.orderBy(*faults.columns).limit(SHOWN).collect()]
        raise ValueError(f"{what} refused: {dict(sorted(counts.items()))}, such as {some}")


def guard_scoring(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """step, fault, n over all steps in order: what has to be empty before the sealed split is opened. One row per kind of fault."""
    out = None
    for i, (name, faults) in enumerate(steps):
        one = faults.groupBy("fault").agg(F.count("*").alias("n")).select(F.lit(i).alias("place"), F.lit(name).alias("step"), "fault", "n")
        out = one if out is None else out.union(one)
    return out
