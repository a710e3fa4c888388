"""Operator 10 against scoring every passage with every item."""

import math
import random
from collections import Counter

from calibrium.llm.decontam import B, K1, STRIDE, THRESHOLD, WINDOW, Index, benchmark_leaks, op10_benchmark_decontamination, without_leaks, words_of


def brute(rows, items):
    """(doc, item) -> best score of any passage, straight from the BM25 formula."""
    pieces = [(i, w[a : a + STRIDE]) for i, t in items for w in [words_of((t or "").encode())] for a in range(0, len(w), STRIDE)]
    n, df = len(pieces), Counter(x for _, w in pieces for x in set(w))
    mean = sum(len(w) for _, w in pieces) / max(1, n)
    idf = {x: math.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    weights = []
    for item, w in pieces:
        norm = K1 * (1 - B + B * len(w) / mean)
        x = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(w).items()}
        weights.append((item, x, sum(x.values())))
    found = {}
    for doc, text in rows:
        words = words_of((text or "").encode())
        for a in range(0, max(1, len(words)), STRIDE):
            passage = set(words[a : a + WINDOW])
            for item, x, own in weights:
                score = sum(v for t, v in x.items() if t in passage) / own
                if score >= THRESHOLD:
                    found[doc, item] = max(found.get((doc, item), 0), score)
    return found


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(rows, items)
    got = op10_benchmark_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.score - want[r.doc_id, r.item_id]) < 1e-3 for r in got if r.leaked)
    texts, inside = dict(rows), {k for k in want if f" {' '.join(w.decode() for w in words_of(dict(items)[k[1]].encode()))} " in f" {' '.join(w.decode() for w in words_of(dict(rows)[k[0]].encode()))} "}
    assert inside and inside <= {(r.doc_id, r.item_id) for r in got if r.leaked} and texts


def test_partial_and_edited_leaks(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice([2, 3, 5])))
    items = [(k, " ".join(word() for _ in range(r.choice([6, 30, 150])))) for k in range(60)]
    rows = []
    for k in range(80):
        words = [word() for _ in range(r.choice([0, 10, 200, 700]))]
        leak = r.choice(items)[1].split()
        leak = leak[: r.choice([len(leak), len(leak) // 2])]
        for _ in range(r.choice([0, 2, 10])):
            leak[r.randrange(len(leak))] = word()
        at = r.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + leak + words[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = {(x.doc_id, x.item_id) for x in benchmark_leaks(docs, bench).collect()}
    near = {k for k, v in want.items() if abs(v - THRESHOLD) < 1e-5}
    assert got ^ set(want) <= near and len(got) > 40


def test_shards_find_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).where("leaked").collect()}
    monkeypatch.setattr("calibrium.llm.decontam.SHARD", 16)
    assert {(r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).where("leaked").collect()} == whole


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (None, item, 0), (1, item, 0)], "item_id long, text string, score int")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, f"x, {item.upper()}!", "a"), (None, item, "a"), (3, item, None), (4, "clean text", "a")], "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.leaked) for r in benchmark_leaks(docs, bench).collect()))
    assert got == [(0, 0, True), (0, 1, True), (3, 0, True), (3, 0, True), (3, 1, True), (3, 1, True)]
    assert benchmark_leaks(docs.limit(0), bench).collect() == [] and benchmark_leaks(docs, bench.limit(0)).collect() == []
    assert Index([]).search([[b"x"]], 0.5) == []


def test_stage_drops_leaks_only(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item, "s"), (1, "clean too", "s"), (2, "clean", "s"), (None, "null id", "s"), (None, f"so {item}", "s"), (7, item, None), (7, None, "s"), (8, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = without_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    assert without_leaks(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_long_items_have_no_short_pieces(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (65, 66, 70, 130)]
    tails = [(n, "clean words " + " ".join(text.split()[64 * (n // 64) :]) + " and more") for n, text in items]
    whole = [(1000 + n, f"some text {text} some text") for n, text in items] + [(2000 + n, f"x {' '.join(text.split()[-64:])} y") for n, text in items]
    docs, bench = spark.createDataFrame(tails + whole, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(docs, bench).where("leaked").collect()}
    assert got == {(k + n, n) for n, _ in items for k in (1000, 2000)}


def test_shards_have_the_counts_of_all_items(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, benchmark_leaks(docs, bench).collect()))
    monkeypatch.setattr("calibrium.llm.decontam.SHARD", 64)
    assert sorted(map(tuple, benchmark_leaks(docs, bench).collect())) == whole
