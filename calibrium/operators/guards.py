"""Guards before scores are used: calibration records, shared parameters, rendered prompts, run files, contamination."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a hit, hits that tell of contamination, hits of twins that still do.
MIN_PREFIX, MIN_VERBATIM, MAX_TWINS = 6, 4, 1


def calibration_faults(records: DataFrame, gauges: DataFrame, target: float, k: int = 3) -> DataFrame:
    """Gauges whose record is missing or unfit: another target, no positive temperature, thresholds that aren't k finite numbers.

    records: gauge, sa_target, T, taus; gauges: gauge.
    """
    finite = F.forall("taus", lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    fault = (
        F.when(F.col("T").isNull(), "no record").when(F.abs(F.col("sa_target") - target) > 1e-12, "other target")
        .when(~(F.col("T") > 0) | F.isnan("T") | (F.col("T") == float("inf")), "temperature").when((F.size("taus") != k) | ~finite, "thresholds")
    )
    return gauges.select("gauge").join(records, "gauge", "left").withColumn("fault", fault).where("fault IS NOT NULL").select("gauge", "fault")


def disagreeing_parameters(blocks: DataFrame, names: list[str]) -> DataFrame:
    """Parameters on which blocks (one row per gauge) don't agree, with the values seen."""
    cells = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).cast("string").alias("value")) for n in names])
    seen = blocks.select(F.explode(cells).alias("c")).groupBy("c.parameter").agg(F.sort_array(F.collect_set("c.value")).alias("seen"))
    return seen.where(F.size("seen") > 1)


def blank_think_blocks(text: Column, opening: str = "<think>", closing: str = "</think>") -> Column:
    """Whether opening and closing marks are balanced and nothing but blanks stands between them."""
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    bodies = F.regexp_extract_all(text, F.lit(f"(?s){opening}(.*?){closing}"), F.lit(1))
    return F.coalesce((count(opening) == count(closing)) & (F.size(bodies) == count(opening)) & F.forall(bodies, lambda b: F.trim(F.regexp_replace(b, r"\s", " ")) == ""), F.lit(False))


def item_faults(items: DataFrame, key: str, filled: list[str], label: str, labels: list[str]) -> DataFrame:
    """Items that break their schema: a null key, a blank text, a label out of its domain; key, faults (all, in that order)."""
    blank = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"blank {c}")) for c in filled]
    found = [F.when(F.col(key).isNull(), F.lit("no key")), *blank, F.when(F.coalesce(~F.col(label).isin(labels), F.lit(True)), F.lit("label"))]
    return items.select(key, F.array_join(F.array_compact(F.array(*found)), ", ").alias("faults")).where("faults <> ''")


def token_rollup(prompts: DataFrame, by: list[str], tokens: str, limit: int) -> DataFrame:
    """Mean and largest number of tokens, and how many prompts are cut at the limit."""
    return prompts.groupBy(*by).agg(F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("max_tokens"), F.count_if(F.col(tokens) > limit).alias("truncated"))


def with_one_start(tokens: Column, start: str) -> Column:
    """Token array with exactly one start mark, in front; marks elsewhere stay."""
    bare = F.when(F.get(tokens, F.lit(0)) == start, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    twice = F.get(bare, F.lit(0)) == start
    return F.when(twice, F.raise_error(F.lit("more than one start mark"))).otherwise(F.array_prepend(bare, F.lit(start)))


def incomplete_runs(items: DataFrame, footers: DataFrame) -> DataFrame:
    """Runs whose footer is missing or tells another number of items. items: run; footers: run, n_items."""
    counted = items.groupBy("run").agg(F.count("*").alias("found"))
    return counted.join(footers, "run", "full").where(~F.col("found").eqNullSafe(F.col("n_items"))).select("run", "found", "n_items")


def canary_flags(rows: DataFrame, by: list[str], least: int = MIN_PREFIX) -> DataFrame:
    """Hits (a shared prefix of `least` tokens) of texts and of their twins, and whether that tells of contamination.

    rows: shared, twin_shared.
    """
    hits = rows.groupBy(*by).agg(F.count_if(F.col("shared") >= least).alias("verbatim"), F.count_if(F.col("twin_shared") >= least).alias("twins"), F.count("*").alias("n"))
    return hits.withColumn("flagged", (F.col("verbatim") >= MIN_VERBATIM) & (F.col("twins") <= MAX_TWINS))


def rendered(template: str, **parts: Column) -> Column:
    """A text template with {name} places filled by columns. The template is cut at its places first, so a value that
    holds such a place is left as it is; names without a column stay."""
    cut = re.split("(" + "|".join(re.escape("{%s}" % name) for name in parts) + ")", template) if parts else [template]
    return F.concat(*[F.coalesce(parts[x[1:-1]], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(cut)])


def spec_sha256(spec: Column) -> Column:
    """sha256 of a map of texts as compact JSON with sorted keys, whatever order the map has."""
    quoted = lambda x: F.to_json(F.array(x))
    bare = lambda x: F.substring(quoted(x), F.lit(2), F.length(quoted(x)) - 2)
    pairs = F.transform(F.sort_array(F.map_keys(spec)), lambda k: F.concat(bare(k), F.lit(":"), bare(F.element_at(spec, k))))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), 256)


def changed_entries(stored: Column, derived: Column) -> Column:
    """Keys of a stored record that a new derivation gives another value, sorted; keys that it lacks may have been added."""
    differ = F.filter(F.map_keys(stored), lambda k: F.map_contains_key(derived, k) & ~F.element_at(stored, k).eqNullSafe(F.element_at(derived, k)))
    return F.sort_array(differ)


def canonical_sha256(spec: dict) -> str:
    """sha256 of a specification as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
