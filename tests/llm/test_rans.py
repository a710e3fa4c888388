"""Operator 3: exact round trips, checkpoints and checksums."""

import zlib

import numpy as np
import pytest

from calibrium.llm import rans
from calibrium.llm.rans import decode_block, encode_block, op3_rans_token_files, read_tokens, scaled, tables, write_tokens
from calibrium.llm.tokens import WordEncoder, tokenizer_path


@pytest.mark.parametrize("n", [1, 2, 7, 1023, 1024, 1025, 300_001])
@pytest.mark.parametrize("kinds", [1, 3, 40_000])
def test_block_round_trip(n, kinds):
    r = np.random.default_rng(n + kinds)
    ids = np.minimum(r.zipf(1.3, n) - 1, kinds - 1).astype(np.uint16)
    f, starts, slots = tables(scaled(np.bincount(ids, minlength=kinds + 1)))
    payload = encode_block(ids, f, starts)
    assert (decode_block(payload, f, starts, slots) == ids).all()
    steps = -(-n // min(1024, n))
    parts = [decode_block(payload, f, starts, slots, checkpoint=c) for c in range(-(-steps // 256))]
    assert (np.concatenate(parts) == ids).all()
    if n > 300_000 and kinds > 1:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(payload) < 1.02 * entropy + 20_000
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            decode_block(bytes(broken), f, starts, slots)


def test_scaled_frequencies_add_up():
    r = np.random.default_rng(0)
    for counts in (r.integers(0, 5, 40_000), np.array([1, 10**12]), np.array([0, 0, 7]), np.ones(1 << 15, np.int64)):
        freq = scaled(counts)
        assert freq.sum() == 1 << 20 and ((freq > 0) == (counts > 0)).all()


def want(rows):
    words, at, out = WordEncoder(tokenizer_path()), 0, []
    for doc, text in rows:
        ids = words.library(text or "") + (2).to_bytes(4, "little")
        out.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


@pytest.mark.parametrize("block", [1 << 19, 2000])
def test_whole_table(spark, sf, monkeypatch, block):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", block)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op3_rans_token_files(spark, sf).collect())) == want(rows)


def test_files_are_in_order_and_hold_the_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_tokens(docs, str(tmp_path), partitions=5)
    blocks = spark.read.parquet(f"{tmp_path}/blocks").selectExpr("_metadata.file_name AS f", "number", "docs").collect()
    order = [d for b in sorted(blocks, key=lambda b: (b.f, b.number)) for d in b.docs]
    assert order == sorted(order) and len(order) == docs.count() and len({b.f for b in blocks}) > 1
    words = WordEncoder(tokenizer_path())
    got = {r.doc_id: bytes(r.ids) for r in read_tokens(spark, str(tmp_path), with_ids=True).collect()}
    assert all(got[r.doc_id] == words.library(r.text) + b"\x02\0\0\0" for r in docs.limit(40).collect())


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x", 0), (1, None, 0), (1, "", 0), (2, "a b", 0), (2, "a b", 0), (3, "z " * 30_000, 0)], "doc_id long, text string, number int")
    write_tokens(docs, f"{tmp_path}/a")
    got = sorted(map(tuple, read_tokens(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert got == want([(None, "x"), (1, None), (1, ""), (2, "a b"), (2, "a b"), (3, "z " * 30_000)])
    write_tokens(docs.limit(0), f"{tmp_path}/b")
    assert read_tokens(spark, f"{tmp_path}/b").collect() == []
