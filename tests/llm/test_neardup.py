"""Operator 7 against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from calibrium.llm import neardup
from calibrium.llm.neardup import BANDS, ROWS, keep_one_of_each, least_matches, near_duplicates, op7_minhash_near_dedup


def shingle_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(sets):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(s), low[top(i)], d == low[top(i)]) for i, (d, s) in enumerate(sets))


def test_whole_table_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_minhash_near_dedup(spark, sf).collect())) == brute(rows)


@pytest.mark.parametrize("small", [3])
def test_chains_and_large_groups(spark, monkeypatch, small):
    """Chains of edits, so that members of a bucket are similar to some and not to others; small=3 takes the way of large buckets."""
    monkeypatch.setattr("calibrium.llm.neardup.SMALL_BUCKET", small)
    monkeypatch.setattr("calibrium.llm.neardup.DEPTH", 2)
    r = random.Random(3)
    rows, doc = [], 0
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([6, 40, 120]))]
        for _ in range(r.randrange(1, 14)):
            rows.append((doc, " ".join(words)))
            doc += 1
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pair_rows=0).drop("th", "first")
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("small", [1])
def test_many_copies_of_one_text(spark, monkeypatch, small):
    """Copies around the threshold, cut-off copies and copies of copies: links that don't lead over the leader."""
    monkeypatch.setattr("calibrium.llm.neardup.SMALL_BUCKET", small)
    monkeypatch.setattr("calibrium.llm.neardup.DEPTH", 2)
    r = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for d in range(1, 140):
        words = list(base if r.random() < 0.6 else rows[r.randrange(len(rows))][1].split())
        kind = r.randrange(4)
        if kind == 0:
            words = words[: r.randrange(60, len(words) + 1)]
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        if kind == 1:
            words += [f"y{r.randrange(10**6)}" for _ in range(r.randrange(30))]
        rows.append((d, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pair_rows=0).drop("th", "first")
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and 1 < len({w[2] for w in want}) < 139


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (None, "one two", "x"), (6, "É é", "x"), (6, "É é", "y"), (7, "two one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True)}
    assert near_duplicates(docs.limit(0)).collect() == []
    kept = keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_null_and_repeated_ids_lose_no_text(spark):
    """Each row has the component of its own text; rows that share an id don't link their texts."""
    r = random.Random(5)
    p, q, s = ([f"{k}{r.randrange(10**6)}" for _ in range(60)] for k in "pqs")
    near = lambda x: " ".join([*x[:-1], "changed"])
    p, q, s = (" ".join(x) for x in (p, q, s))
    rows = [(3, p), (5, p), (5, q), (9, near(q.split())), (None, near(p.split())), (None, near(q.split())), (None, s), (None, near(s.split())), (None, s)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect())
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (0, 3, False), (0, 5, False), (0, 0, True), (0, 0, True), (0, 0, True)])
    kept = [(r.doc_id, r.text[:1]) for r in keep_one_of_each(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [(3, "p"), (5, "q"), (None, "s")]


@pytest.mark.parametrize("small", [2])
def test_cut_off_copies(spark, monkeypatch, small):
    """Prefixes of one text: what two of them share is all in the longest one, so only their sizes tell."""
    monkeypatch.setattr("calibrium.llm.neardup.SMALL_BUCKET", small)
    monkeypatch.setattr("calibrium.llm.neardup.DEPTH", 2)
    monkeypatch.setattr("calibrium.llm.common.HOT_ROWS", 3)
    base = [f"b{i}" for i in range(400)]
    rows = [(d, " ".join(base[: 400 - 7 * d])) for d in range(50)] + [(100 + d, " ".join(base[:150] + [f"c{d % 4}_{i}" for i in range(80 + d)])) for d in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pair_rows=0).drop("th", "first")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def distant_copies(n=300):
    """Copies of one text that share less than the threshold with one another, but for a few planted links."""
    r = random.Random(2)
    base, rows = [f"b{i}" for i in range(60)], []
    for d in range(n):
        words = list(base)
        for at in r.sample(range(60), 2):
            words[at] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    return rows + [(n + d, f"{rows[d][1]} more") for d in range(0, n, 30)]


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr("calibrium.llm.neardup.SMALL_BUCKET", 8)
    monkeypatch.setattr("calibrium.llm.neardup.BLOCK", 20)
    seen, verified = [], neardup._verified

    def counted(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr("calibrium.llm.neardup._verified", counted)
    rows = distant_copies()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pair_rows=0).drop("th", "first")
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert sum(seen) < 30 * len(rows)


@pytest.mark.parametrize("blocks", [0, 2])
def test_groups_of_too_many_blocks_are_split(spark, monkeypatch, blocks):
    for name, value in (("SMALL_BUCKET", 2), ("BLOCK", 10), ("BLOCKS", blocks), ("DEPTH", 3)):
        monkeypatch.setattr(f"calibrium.llm.neardup.{name}", value)
    base = [f"b{i}" for i in range(300)]
    rows = distant_copies(90) + [(1000 + d, " ".join(base[: 300 - 7 * d])) for d in range(35)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pair_rows=0).drop("th", "first")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_grow_with_the_sample():
    tests = least_matches(BANDS * ROWS)
    assert [n for n, _ in tests] == [40, 80, 120, 160, 200] and all(0.3 * n < m < 0.7 * n for n, m in tests)
