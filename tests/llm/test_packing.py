"""Operator 1: pieces against plain encoding, sequences against their definition and the lower bound."""

import math
import random
import zlib
from array import array

from calibrium.llm import packing
from calibrium.llm.packing import op1_best_fit_packing, pack_documents, sum_of_squares
from calibrium.llm.tokens import WordEncoder, tokenizer_path


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length >= 1
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark, sf):
    words = WordEncoder(tokenizer_path())
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = list(memoryview(words.library(r.text or "")).cast("I")) + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, piece, at, len(part), zlib.crc32(array("I", part).tobytes())))
    rows = op1_best_fit_packing(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    least = math.ceil(sum(w[3] for w in want) / 4096)
    assert check_sequences(rows, 4096) <= least + 3


def test_groups_stay_close_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 300)
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join("word" for _ in range(int(r.paretovariate(0.7) * 5) % 900))) for i in range(2000)], "doc_id long, text string")
    rows = packing.pack_pieces(packing.token_pieces(docs, tokenizer_path(), capacity=512), 2000, 512, 300).collect()
    assert check_sequences(rows, 512) <= 1.02 * sum(x.length for x in rows) / 512 + 7


def test_one_placement_is_the_best():
    """Every step of the algorithm against trying all bins."""
    r = random.Random(4)
    sizes = [r.randrange(1, 21) for _ in range(200)]
    bins, offsets = sum_of_squares(sizes, 20)
    gaps: dict[int, int] = {}
    for s, b, offset in zip(sizes, bins, offsets):
        def cost(after):
            n = {}
            for g in after.values():
                if g:
                    n[g] = n.get(g, 0) + 1
            return sum(x * x for x in n.values())

        choices = [cost(gaps | {c: g - s}) for c, g in gaps.items() if g >= s] + [cost(gaps | {-1: 20 - s})]
        assert offset == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - s
        assert cost(gaps) == min(choices)


def test_odd_rows(spark):
    long = "word " * 9000
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "one two", 0), (2, long, 0), (2, long, 0)], "doc_id long, text string, length int")
    rows = pack_documents(docs, with_ids=True).collect()
    assert check_sequences(rows, 4096) >= 4
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == sorted([(1, 0, 1), (1, 0, 1), (0, 0, 3)] + 2 * [(2, 0, 4096), (2, 1, 4096), (2, 2, 809)])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert pack_documents(docs.limit(0)).collect() == []
