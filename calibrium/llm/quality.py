"""Operator 6, quality rules: a decision list learnt by sequential covering, applied as one Spark expression.

Statistics of a text are DataFrame expressions. From labelled rows rules are grown one at a time: a rule adds threshold
conditions by information gain until it covers no good text of the growing part (two thirds of the sample, by hash), is
pruned backwards on the rest, and is kept if it is right there often enough; what it covers leaves the sample. The rules
become an ordered CASE expression; a text that no rule rejects is kept.
Bounds of the search, all parameters of the learner and none of the data: a condition's threshold is one of `CUTS` evenly
spaced edges between values of different rows, a rule has at most `MAX_CONDITIONS` conditions, a list `MAX_RULES` rules.

The fit sees a bounded sample: of at most `SAMPLE` labelled rows, those with the smallest hashes of doc_id, the ones that
the base rule lets through, so that conditions are spent where it doesn't decide; their
statistics (a few numbers a row) go to the driver. Everything else covers all rows, without a shuffle: the sample's ids
are broadcast (at most SAMPLE), and statistics and verdict are one projection over the scan.

Repeated 3-word windows are found by sorting their 64-bit hashes within the row, so a row of n words costs n log n.

Defined results: null, empty and blank texts have no words and fail the base rule; null ids are kept; repeated rows are
judged each for itself; labels that are null, or that no document has, are ignored; without labels of both kinds the
list is empty and only the base rule rejects; an empty table gives no rows; all columns of the input are at hand, and
the added ones replace columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import read

SAMPLE, MAX_RULES, MAX_CONDITIONS, CUTS = 20_000, 12, 4, 48
MIN_PRECISION, MIN_COVER = 0.95, 5
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics of the texts; each array is computed once, in a projection of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__t", text).withColumn("__trimmed", F.btrim(F.col("__t"), F.lit(" \t\n\x0b\f\r")))
    out = out.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", r"[\x20\x09-\x0D]+")))
    out = out.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words = F.col("__words")
    windows = F.when(F.size(words) > 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    out = out.withColumn("__windows", F.sort_array(windows))
    held = F.col("__windows")
    same = lambda x, k: F.coalesce(F.get(held, k)["h"] == x["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter(held, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"]))
    out = out.withColumn("__again", again)
    # each window adds the words that the one before it doesn't hold
    covered = F.aggregate("__again", F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 2).alias("last"), (a["n"] + F.least(F.lit(3), p + 2 - a["last"])).alias("n")), lambda a: a["n"])
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.regexp_count("__t", F.lit(r"[A-Z]")),
        "n_digits": F.regexp_count("__t", F.lit(r"[0-9]")),
        "n_marks": F.regexp_count("__t", F.lit(r"[!?]")),
    }
    out = out.select(*docs.drop(*counts).columns, F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]).alias("__counts"))
    # a generator: the optimizer pushes no filter on the statistics below it, where each use would spell them out anew
    return out.select(*docs.drop(*counts).columns, F.inline(F.array("__counts")))


Condition = tuple[str, str, float]


def _covers(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, sign, cut in rule:
        column = x[:, names.index(name)]
        hit &= column <= cut if sign == "<=" else column >= cut
    return hit


def learn(x: np.ndarray, bad: np.ndarray, part: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """Ordered rules for bad rows. part: 0 and 1 grow rules, 2 prunes them."""
    grow, prune = part < 2, part == 2
    alive, rules = np.ones(len(x), bool), []
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        g = alive & grow
        while len(rule) < MAX_CONDITIONS:
            inside = g & _covers(x, names, rule)
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p or not n:
                break
            best, now = (0.0, None), math.log2(p / (p + n))
            for j, name in enumerate(names):
                values, kind = x[inside, j], bad[inside]
                order = np.argsort(values, kind="stable")
                values, kind = values[order], kind[order]
                ps = np.cumsum(kind)
                edges = np.flatnonzero(np.diff(values) > 0)
                if len(edges) > CUTS:
                    edges = edges[np.unique(np.linspace(0, len(edges) - 1, CUTS).astype(int))]
                for e in edges.tolist():
                    below_p, below = int(ps[e]), e + 1
                    for sign, pp, total, cut in (("<=", below_p, below, values[e]), (">=", p - below_p, len(values) - below, values[e + 1])):
                        if pp:
                            gain = pp * (math.log2(pp / total) - now)
                            if gain > best[0] + 1e-9:
                                best = (gain, (name, sign, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        q = alive & prune

        def worth(r: list[Condition]) -> float:
            hit = q & _covers(x, names, r)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = alive & _covers(x, names, rule)
        checked = hit & prune
        p, n = int((checked & bad).sum()), int((checked & ~bad).sum())
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION or (hit & bad).sum() < MIN_PRECISION * hit.sum():
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules that reject, learnt from at most `sample` labelled rows."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    columns = [F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]
    rows = with_statistics(texts).where(f"NOT ({BASE_FAILED})").select("__label", F.pmod(F.xxhash64("__id"), F.lit(3)), *columns).collect()  # at most `sample` rows, but for repeated ids
    if not rows:
        return []
    table = np.array([tuple(r) for r in rows], float)
    table = table[np.lexsort(table.T[::-1])]
    return learn(table[:, 2:], table[:, 0] == 0, table[:, 1].astype(int), list(FEATURES))


def rejected_by(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that rejects, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, sign, cut in rule:
            value = F.expr(FEATURES[name]).cast("double")
            test = test & (value <= F.lit(cut) if sign == "<=" else value >= F.lit(cut))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs with statistics, base_failed, rule (the one that rejects) and kept."""
    rules = fit_rules(docs, labels, id_col, text_col, sample=sample)
    out = with_statistics(docs, text_col).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", rejected_by(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_quality_decision_list(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", *STATISTICS, "base_failed", "kept")


#: Columns that `judge` adds.
ADDED = [*STATISTICS, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "base_failed", "rule", "kept"]


def good_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep. Columns of the names that `judge` adds come along as they are."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ADDED}
    kept = judge(docs.withColumnsRenamed(own), read(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
