"""Building a labelled item set: nested JSON, joins with drop accounting, allocation, sampling, splits, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrium.operators.ranks import ranked

DROP_REASONS = ["duplicate_id", "no_ground_truth", "contradicts_category", "empty_request"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; of equal ones any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`: an aggregation with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def content_text(content: Column) -> Column:
    """Text of a message content: a string, an object with text or content, or a list of these."""
    part = lambda v: F.coalesce(
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        F.try_variant_get(v, "$.text", "string"),
        F.try_variant_get(v, "$.content", "string"),
    )
    parts = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, part), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.coalesce(F.when(parts.isNotNull(), joined), part(content))


def request_text(question: Column) -> Column:
    """Contents of the user messages of the first turn, joined by line feeds. A turn is a list of messages or one message."""
    turn = F.try_variant_get(question, "$[0]", "variant")
    many, one = F.try_variant_get(turn, "$", "array<variant>"), F.when(F.schema_of_variant(turn).startswith("OBJECT"), F.array(turn))
    users = F.filter(F.coalesce(many, one), lambda m: F.try_variant_get(m, "$.role", "string") == "user")
    texts = F.transform(users, lambda m: content_text(F.try_variant_get(m, "$.content", "variant")))
    return F.coalesce(F.array_join(F.filter(texts, lambda x: F.trim(x) != ""), "\n"), F.lit(""))


def function_list(function: Column) -> Column:
    """array<struct<name, description, params>> of a function list or a single function; params are property names."""
    many, one = F.try_variant_get(function, "$", "array<variant>"), F.when(F.schema_of_variant(function).startswith("OBJECT"), F.array(function))
    objects = F.filter(F.coalesce(many, one), lambda f: F.schema_of_variant(f).startswith("OBJECT"))
    names = lambda f: F.coalesce(F.json_object_keys(F.to_json(F.try_variant_get(f, "$.parameters.properties", "variant"))), F.array().cast("array<string>"))
    return F.transform(objects, lambda f: F.struct(F.try_variant_get(f, "$.name", "string").alias("name"), F.try_variant_get(f, "$.description", "string").alias("description"), names(f).alias("params")))


def call_count(truth: Column) -> Column:
    """Calls in a ground truth: the length of a list, 1 for an object, else null."""
    kind = F.schema_of_variant(truth)
    return F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(truth, "$", "array<variant>"))).when(kind.startswith("OBJECT"), 1)


def fits_category(label: Column, calls: Column) -> Column:
    return F.when(label == "one-call", calls == 1).when(label == "multi-call", calls >= 2).otherwise(True)


def with_drop_reason(items: DataFrame, truth: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Left join with the first truth of each key, and the first reason to drop a row, if any.

    items: key, ord, label, request; truth: key, ord, calls. Labels other than no-call need a truth.
    """
    one = first_per_key(truth, [key], [order]).select(key, "calls", F.lit(True).alias("__found"))
    joined = items.join(one, key, "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    needs = F.col("label") != "no-call"
    reason = (
        F.when(nth > 1, "duplicate_id").when(needs & F.col("__found").isNull(), "no_ground_truth")
        .when(needs & ~F.coalesce(fits_category(F.col("label"), F.col("calls")), F.lit(False)), "contradicts_category")
        .when(F.trim(F.coalesce("request", F.lit(""))) == "", "empty_request")
    )
    return joined.withColumn("drop_reason", reason).drop("__found")


def rollup_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), by outer, and over all; totals have nulls and a level."""
    return rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def majority(items: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """The most frequent label; any tie gives the first label of the domain."""
    counted = items.groupBy(label).agg(F.count("*").alias("n"))
    top = counted.agg(F.max("n").alias("most"))
    leaders = counted.join(F.broadcast(top), F.col("n") == F.col("most"))
    return leaders.agg(F.when(F.count("*") > 1, labels[0]).otherwise(F.first(label)).alias("majority"), F.max("most").alias("n"))


def largest_remainder(shares: DataFrame, by: list[str], raw: str, total: str, order: str) -> DataFrame:
    """Whole numbers that add up to `total` in each group: floors, then one more for the largest fractions, in `order` for ties."""
    base = F.floor(raw)
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy((F.col(raw) - base).desc(), order))
    return shares.withColumn("n", (base + F.when(place <= F.col(total) - F.sum(base).over(w), 1).otherwise(0)).cast("long"))


def _whole(shares: dict[str, float], total: int) -> dict[str, int]:
    out = {f: int(x) for f, x in shares.items()}
    for f in sorted(shares, key=lambda f: out[f] - shares[f])[: total - sum(out.values())]:
        out[f] += 1
    return out


def allocate(valid: dict[str, int], target: int, floor: int) -> dict[str, int]:
    """Sample sizes in proportion to the valid items of each file, each between min(floor, valid) and valid.

    One file is pinned to a bound at a time, then the others' shares are taken anew. If the floors alone exceed the target
    they are scaled. Works on the few counts per file that an aggregation gives.
    """
    sizes = {f: n for f, n in valid.items() if n > 0}
    if sum(sizes.values()) < target:
        raise ValueError(f"{target} items asked for, {sum(sizes.values())} are valid")
    least = {f: min(floor, n) for f, n in sizes.items()}
    if sum(least.values()) > target:
        return _whole({f: target * x / sum(least.values()) for f, x in least.items()}, target)
    pinned: dict[str, int] = {}
    while open_files := [f for f in sizes if f not in pinned]:
        left, total = target - sum(pinned.values()), sum(sizes[f] for f in open_files)
        shares = {f: left * sizes[f] / total for f in open_files}
        bound = next(((f, least[f] if shares[f] < least[f] else sizes[f]) for f in open_files if not least[f] <= shares[f] <= sizes[f]), None)
        if bound is None:
            pinned |= _whole(shares, left)
            break
        pinned[bound[0]] = bound[1]
    return {f: pinned[f] for f in sizes}


def hash_key(seed: int, *columns: str) -> Column:
    """Order for sampling: md5 of the seed and the key, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def sample_per_group(items: DataFrame, by: list[str], key: str, sizes: DataFrame, seed: int) -> DataFrame:
    """`k` rows of each group without replacement, by hash order. sizes: by, k; a row for each group, of which there must be few."""
    placed = ranked(items, by, [hash_key(seed, key), F.col(key)], "__place")
    return placed.join(F.broadcast(sizes), by).where(F.col("__place") <= F.col("k")).drop("__place", "k")


def split_per_group(items: DataFrame, by: list[str], key: str, n_fit: int, seed: int) -> DataFrame:
    """`split`: the first n_fit of each group in hash order are fit, the rest exam."""
    placed = ranked(items, by, [hash_key(seed, key), F.col(key)], "__place")
    return placed.withColumn("split", F.when(F.col("__place") <= n_fit, "fit").otherwise("exam")).drop("__place")


def parity_sample(ids: list, k: int, seed: int) -> list:
    """Sampling by Python's generator, for parity with a fixed published order; ids come from a bounded label."""
    import random

    return random.Random(seed).sample(ids, k)


def folds(items: DataFrame, by: list[str], key: str, k: int, seed: int) -> DataFrame:
    """Stratified fold of each row, 0 to k - 1."""
    placed = ranked(items, by, [hash_key(seed, key), F.col(key)], "__place")
    return placed.withColumn("fold", F.pmod(F.col("__place") - 1, F.lit(k)).cast("int")).drop("__place")


def resolve_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """The file for each expected name: itself, else the first of the same category under any version.

    Names are <prefix>[_vN]_<category>.json.
    """
    category = lambda c: F.regexp_extract(c, r"^[A-Za-z]+(?:_v\d+)?_(.+)\.json$", 1)
    want = expected.select(F.col("name").alias("expected"), category(F.col("name")).alias("category"))
    have = present.select(F.col("name").alias("found"), category(F.col("name")).alias("category"))
    joined = want.join(have, "category", "left").groupBy("expected", "category")
    return joined.agg(F.coalesce(F.max(F.when(F.col("found") == F.col("expected"), F.col("found"))), F.min(F.when(F.col("category") != "", F.col("found")))).alias("found")).withColumn("substituted", F.col("found") != F.col("expected"))
