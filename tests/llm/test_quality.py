"""Operator 6 against plain counting, and the learner on rules that are known."""

import re
from collections import Counter

import numpy as np

from calibrium.llm.quality import FEATURES, fit_rules, good_documents, judge, learn, op6_quality_decision_list, with_statistics


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_quality_decision_list(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(tuple(r)[1:7] == brute(texts[r.doc_id]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = fit_rules(docs, labels)
    assert rules and all(name in FEATURES for rule in rules for name, _, _ in rule)
    got = judge(docs, labels).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    wrong = sum(r["count"] for r in got if r.quality == 1 and not r.kept and not r.base_failed)
    good = sum(r["count"] for r in got if r.quality == 1)
    missed = sum(r["count"] for r in got if r.quality == 0 and r.kept)
    bad = sum(r["count"] for r in got if r.quality == 0)
    assert wrong <= 0.02 * good and missed <= 0.3 * bad


def test_learner_finds_planted_conjunctions():
    r = np.random.default_rng(1)
    x = r.random((6000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.3) | (x[:, 2] > 0.9)
    rules = learn(x, bad, np.arange(6000) % 3, ["a", "b", "c"])
    hit = np.zeros(6000, bool)
    for rule in rules:
        covered = np.ones(6000, bool)
        for name, sign, cut in rule:
            column = x[:, "abc".index(name)]
            covered &= column <= cut if sign == "<=" else column >= cut
        hit |= covered
    assert (hit == bad).mean() > 0.97
    assert learn(x, np.zeros(6000, bool), np.arange(6000) % 3, ["a", "b", "c"]) == []


def test_odd_rows(spark):
    texts = [None, "", " \t\n\x0b\f\r", "a b c d", "a b c a b c", "x\x1cy\xa0z \x85", "a b c\na b c\n\n \n", "a a a a a", "퟿ é"] + ["w " * 30_000]
    docs = spark.createDataFrame([(None if k == 3 else k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(0, None), (None, 1), (4, 1), (99, 0)], "doc_id long, quality int")
    got = {r.text: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in with_statistics(docs).collect()}
    assert got == {t: brute(t)[:5] for t in texts}
    assert all(r.kept == (not brute(r.text)[5]) for r in judge(docs, labels).collect())
    assert judge(docs.limit(0), labels).collect() == [] and judge(docs, labels.limit(0)).count() == len(texts)


def test_stage_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = good_documents(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in op6_quality_decision_list(spark, sf).where("kept").collect()}
