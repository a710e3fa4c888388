"""Operator 5, licence scans by ordered signature rules.

Only texts that hold a keyword go beyond counting words. There the text becomes its words between single blanks; rules
whose keyword it holds are matched, and give intervals. A detection within another's interval is suppressed unless its
priority is better; of equal intervals the better priority, then the earlier rule stays. All of it is one projection of
DataFrame functions over the scan, without a shuffle; the rules are a literal array of a fixed size.

The base phrases are found by the places of their words and always keep their labels. The score is the largest
certainty of a surviving detection (by priority) or base phrase.

Defined results: null and empty texts have no words, empty labels and score 0; null ids are kept; repeated rows are
scanned each for itself; an empty table gives no rows; other columns stay, and the added ones replace columns of the
same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import read
from calibrium.llm.license_rules import rules

BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
CERTAINTY = {1: 0.95, 2: 0.8, 3: 0.4}
BLOCK = 256
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gate_word(keyword: str, expression: str) -> str:
    """A word, or part of one, in every text that a rule matches: "licen" where the expression can't do without it."""
    rest, before = expression, ""
    while rest != before:
        rest, before = re.sub(r"\([^()]*\)\?|\([^()]*\|[^()]*\)|\([^()]*\)[*{]", "", rest), rest
    return "licen" if "licen" in rest else max(keyword.split(), key=len)


def bounds(word: str, expression: str) -> tuple[bool, bool]:
    """Whether `word` always begins, and always ends, a word where the expression matches; false where that isn't plain to see."""
    places = [m.start() for m in re.finditer(re.escape(word), expression)]
    before, after = [expression[:i] for i in places], [expression[i + len(word) :] for i in places]
    begins = all(not x or x.endswith((" ", "(", "|", " )?", " )+")) for x in before)
    return begins, all(not x or x.startswith((" ", ")", "|", "( ")) and not x.startswith((" ?", ")?")) for x in after)


def _gates() -> dict[str, tuple[bool, bool]]:
    out = {"cc": (True, True), "licen": (False, False), "reserved": (False, False)}
    for *_, keyword, expression in rules():
        word = gate_word(keyword, expression)
        begins, ends = bounds(word, expression)
        out[word] = (out.get(word, (True, True))[0] and begins, out.get(word, (True, True))[1] and ends)
    return out


#: A text without any of these matches no rule and holds no base phrase. What stands between words may be any marks, so only single words count here.
GATES = _gates()
GATE = sorted(GATES)


def _gate(low: Column) -> Column:
    """Whether the lower-cased text may hold a phrase. Parts of longer gate words are enough for them, if they count anywhere."""
    least = [k for k in GATE if not any(o != k and o in k and len(o) > 4 for o in GATE)]
    out = F.lit(False)
    for k in least:
        # short words stand in many others; they must begin or end a word where all their rules have them so
        begins, ends = GATES[k]
        alone = (r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" if begins else "") + k + (r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])" if ends else "")
        out = out | (F.contains(low, F.lit(k)) if len(k) > 4 or not (begins or ends) else F.contains(low, F.lit(k)) & low.rlike(alone))
    return out


def _base_places(words: Column) -> Column:
    """(place, label) of every base phrase."""

    def at(w: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE:
            first, *rest = phrase.split()
            fits = w == first
            for k, x in enumerate(rest, 1):
                fits = fits & (F.get(words, i + k) == x)
            label = F.when(fits, F.lit(name)).otherwise(label)
        return F.struct(i.alias("i"), label.alias("label"))

    return F.filter(F.transform(words, at), lambda x: x["label"].isNotNull())


def _detections(plain: Column, found: Column) -> Column:
    """Intervals of all matches, as (start, -end, priority, rule, label). found: rules with their matches and the text between."""

    def places(r: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.get(r["parts"], k))
            end = start + F.length(F.get(r["hits"], k))
            hit = F.struct(start.alias("start"), (-end).alias("end"), r["rule"]["priority"].alias("priority"), r["rule"]["id"].alias("id"), r["rule"]["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        # an array grows by copying: hits go into blocks, blocks into the row, so that a text of n hits costs n * BLOCK steps
        one = "array<struct<start:int,end:int,priority:int,id:int,label:string>>"

        def add_block(acc: Column, begin: Column) -> Column:
            block = F.sequence(begin, F.least(begin + BLOCK, F.size(r["hits"])) - 1)
            whole = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
            return F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(one).alias("out")), add, whole)

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(r["hits"]) - 1, F.lit(BLOCK)), start, add_block, lambda acc: F.flatten(acc["out"]))

    return F.sort_array(F.flatten(F.transform(found, places)))


def _survivors(detections: Column) -> Column:
    """(labels, best priority) of what interval containment leaves, in one pass over the sorted intervals.

    Sorted by start, then longest first: an interval lies in an earlier one if that ends no sooner. `e1` to `e3` are the
    largest ends so far of detections of priority 1 to 3 or better.
    """
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["end"], d["priority"]
        reach = F.when(p == 1, acc["e1"]).when(p == 2, acc["e2"]).otherwise(acc["e3"])
        stays = reach < end
        grown = lambda name, level: F.when(stays & (p <= level), F.greatest(acc[name], end)).otherwise(acc[name]).alias(name)
        labels = F.when(stays & ~F.array_contains(acc["labels"], d["label"]), F.concat(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"])
        return F.struct(grown("e1", 1), grown("e2", 2), grown("e3", 3), labels.alias("labels"), F.when(stays, F.least(acc["best"], p)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(detections, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections (the intervals found)."""
    key = lambda word, x: f" {word}" if bounds(word, x)[0] else word
    table = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(key(word, x)).alias("keyword"), F.lit(f"(?<= )(?:{x})(?= )").alias("regex")) for k, label, p, word, x in rules()])
    keywords = F.array(*[F.lit(k) for k in sorted({key(*r[3:]) for r in rules()})])
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__t", text).withColumn("__low", F.lower("__t"))
    out = out.withColumn("__words", F.when(_gate(F.col("__low")), F.regexp_extract_all(F.translate("__t", UPPER, LOWER), F.lit(WORD), F.lit(0)))).drop("__low")
    out = out.withColumn("n_words", F.when(F.col("__words").isNotNull(), F.size("__words")).otherwise(F.regexp_count("__t", F.lit(WORD))).cast("long")).drop("__t")
    out = out.withColumn("__plain", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))).withColumn("__base", _base_places(F.col("__words")))
    out = out.withColumn("__keys", F.filter(keywords, lambda k: F.contains(F.col("__plain"), k))).drop("__words")
    matched = F.transform(F.filter(table, lambda r: F.array_contains(F.col("__keys"), r["keyword"])), lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(F.col("__plain"), r["regex"], F.lit(0)).alias("hits")))
    out = out.withColumn("__found", F.filter(F.when(F.size("__keys") > 0, matched), lambda m: F.size(m["hits"]) > 0))
    cut = F.transform("__found", lambda m: F.struct(m["rule"].alias("rule"), m["hits"].alias("hits"), F.split(F.col("__plain"), m["rule"]["regex"], F.lit(-1)).alias("parts")))
    out = out.withColumn("__cut", cut).withColumn("detections", _detections(F.col("__plain"), F.col("__cut"))).drop("__plain", "__keys", "__found", "__cut")
    out = out.withColumn("__left", _survivors(F.col("detections")))
    base, left = F.col("__base"), F.col("__left")
    base_labels = F.coalesce(F.sort_array(F.array_distinct(F.transform(base, lambda x: x["label"]))), F.array().cast("array<string>"))
    out = out.withColumn("__names", base_labels)
    certainty = F.when(F.size("__names") > 0, F.lit(CERTAINTY[1])).otherwise(0.0)
    for p, x in CERTAINTY.items():
        certainty = F.greatest(certainty, F.when(left["best"] == p, F.lit(x)).otherwise(0.0))
    added = {
        "n_base": F.coalesce(F.when(base.isNotNull(), F.size(base)), F.lit(0)).cast("long"),
        "first_word": F.get(base, F.lit(0))["i"].cast("long"),
        "last_word": F.get(base, F.size(base) - 1)["i"].cast("long"),
        "base_labels": F.array_join("__names", ","),
        "labels": F.array_join(F.sort_array(F.array_union("__names", F.coalesce(left["labels"], F.array().cast("array<string>")))), ","),
        "score": certainty,
    }
    return out.withColumns(added).drop("__base", "__left", "__names")


def op5_license_signatures(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
