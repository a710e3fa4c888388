import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from calibrium.llm import resample as R

DOCS = "doc_id long, text string, rank string, score string"


def brute(rows, target, percent=R.DRAW_PERCENT, buckets=R.BUCKETS, least=R.MIN_WORDS):
    """Rows (doc_id, n_features, weight, score, rank), sorted."""

    def found(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s = Counter(b for _, t in rows for b in found(t)[1])
    t = Counter(b for x in target for b in found(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for doc, text in rows:
        words, have = found(text)
        weight = sum(gain[b] for b in have) // len(have) if have else 0
        h = int(sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(have), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], i) for i, r in enumerate(order[: percent * len(order) // 100], 1)]
    rest = [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(drawn + rest, key=str)


def same(spark, rows, target, **more):
    docs = spark.createDataFrame([(d, t, "x", None) for d, t in rows], DOCS).repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(docs, items, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target)


def corpus(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "Übung", "x1", "the", "of", "city-hall", "日本"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = corpus(300)
    same(spark, list(enumerate(texts)), texts[:20])


def test_stretches_of_a_few_rows(spark):
    texts = corpus(200, 5)
    same(spark, list(enumerate(texts)), texts[50:60], merge_rows=7)


def test_odd_rows(spark):
    long = "Long words, " * 120_000  # more than one block
    rows = [(None, "w " * 30), (None, None), (1, ""), (1, None), (2, " \n\t"), (3, long), (4, "one"), (2**63 - 1, "v " * 40), (5, "a b " * 20)] + [(9, "again and " * 15)] * 40
    same(spark, rows, ["again and again", None, ""])
    same(spark, rows, [], merge_rows=3)
    same(spark, [], ["x"])
    same(spark, [(1, "too short")], ["x"])


def test_equal_scores_go_by_id(spark):
    rows = [(i, 500, 10, 77) for i in range(100)] + [(None, 5, 1, 77), (3, 4, 9, 78), (3, 4, 9, 78)]
    out = R.ranked(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(6), 50, merge_rows=8)
    got = {(r.doc_id, r.rank) for r in out.collect()}
    assert got == {(3, 1), (3, 2)} | {(i, i + 3 if i + 3 <= 50 else None) for i in range(100)} | {(None, None)}


def test_tournament_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(R.merge_runs([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_features_across_blocks(monkeypatch):
    text = "Ab cd, éf  gh-ij 12kl " * 50
    whole = sorted(np.concatenate(list(R.features(text.encode()))).tolist())
    monkeypatch.setattr(R, "BLOCK_BYTES", 7)
    parts = list(R.features(text.encode()))
    assert len(parts) > 20 and sorted(np.concatenate(parts).tolist()) == whole


def test_draw_favours_the_target(spark):
    rows = [(i, ("apple pear plum " if i % 2 else "stone sand clay ") * 10) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.resample(docs, docs.where(F.col("doc_id") == 1)).where("rank IS NOT NULL").select(F.avg(F.col("doc_id") % 2), F.count("*")).first()
    assert got[1] == 100 and got[0] > 0.9
