"""Operator 3, token ids in files coded by a static range asymmetric numeral system.

Files: Parquet parts in ascending order of doc_id, one row per block. A block holds whole documents of about
`BLOCK_TOKENS` tokens; its payload is

    magic "RNS1", lanes, steps, tokens, checkpoints, crc32 of the ids, words       (6 x uint32 after the magic)
    lane states at each checkpoint (uint64), words read before it (uint32), the coded words (uint32)

Symbol i of a block belongs to lane i % lanes, so one numpy step codes a symbol of every lane. All blocks share one
frequency table, scaled to 2**SCALE_BITS, that a first pass counts over all ids; it is stored beside the blocks. The
decoder may begin at any checkpoint of any block, and each block and each document carries a checksum.

Shuffles: texts are ranged by doc_id once; their ids are checkpointed (16 bits each, as the vocabulary allows), so that
counting and coding are narrow. To the driver go the table (at most one row per vocabulary entry) and one token count
per partition.

Defined results: null and empty texts hold only the end id; null ids come first, as nulls; rows that share an id are in
the order of their texts; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, read, shared_dir, shared_table
from calibrium.llm.tokens import encoder, tokenizer_path

END_ID, SCALE_BITS, LANES, CHECK_EVERY, BLOCK_TOKENS = 2, 20, 1024, 256, 1 << 19
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4s6I")


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts as frequencies that add up to 2**bits, at least 1 for each id that occurs."""
    total = int(counts.sum())
    if not total:
        return counts.astype(np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (1 << bits) // total), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    for i in np.argsort(-freq, kind="stable"):  # the largest ones take what rounding left
        take = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= take
        over -= take
        if not over:
            break
    return freq


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequency and start of each id, and the id of each slot."""
    starts = np.concatenate(([0], np.cumsum(freq)[:-1]))
    return freq.astype(np.uint64), starts.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, freq: np.ndarray, starts: np.ndarray, lanes: int = LANES, every: int = CHECK_EVERY) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, words, checks = np.uint64(SCALE_BITS), [], []
    limit = np.uint64((1 << 31) >> SCALE_BITS << 32)
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        x, f = state[: len(symbols)], freq[symbols]
        full = x >= f * limit
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(symbols)] = (q << bits) + (x - q * f) + starts[symbols]
        if step % every == 0:
            checks.append((state.copy(), len(words)))
    words.reverse()
    before = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype("<u4")
    checks.reverse()
    places = np.array([before[steps - k] for _, k in checks], "<u4")
    coded = np.concatenate(words) if words else np.empty(0, "<u4")
    head = HEAD.pack(b"RNS1", lanes, steps, n, len(checks), zlib.crc32(ids.astype("<u4").tobytes()), len(coded))
    return head + b"".join(s.astype("<u8").tobytes() for s, _ in checks) + places.tobytes() + coded.tobytes()


def decode_block(payload: bytes, freq: np.ndarray, starts: np.ndarray, slots: np.ndarray, every: int = CHECK_EVERY, checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block, or of the part from one checkpoint up to the next. A whole block is held to its checksum."""
    magic, lanes, steps, n, checks, crc, size = HEAD.unpack_from(payload)
    if magic != b"RNS1":
        raise ValueError("not a block of coded token ids")
    at = HEAD.size
    states = np.frombuffer(payload, "<u8", checks * lanes, at).reshape(checks, lanes)
    places = np.frombuffer(payload, "<u4", checks, at := at + 8 * checks * lanes)
    words = np.frombuffer(payload, "<u4", size, at + 4 * checks)
    first = checkpoint or 0
    last = steps if checkpoint is None else min(steps, (first + 1) * every)
    out = np.empty(max(0, min(n, last * lanes) - first * every * lanes), np.uint32)
    if len(out):
        state, place = states[first].astype(np.uint64), int(places[first])
        mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for step in range(first * every, last):
            k = min(lanes, n - step * lanes)
            x = state[:k]
            slot = x & mask
            symbols = slots[slot]
            out[(step - first * every) * lanes :][:k] = symbols
            x = freq[symbols] * (x >> bits) + slot - starts[symbols]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << np.uint64(32)) | words[place : place + len(low)]
            place += len(low)
            state[:k] = x
        if last == steps and (state != LOW).any():  # where the encoder began
            raise ValueError("a block of token ids is damaged")
    if checkpoint is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return out


def _blocks(path: str, end_id: int, narrow: bool):
    """Documents of a partition, in its order, as blocks of raw ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, number = encoder(path), TaskContext.get().partitionId(), 0
        docs, lengths, runs, total = [], [], [], 0

        def block():
            raw = b"".join(runs)
            raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes() if narrow else raw
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "docs": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "raw": pa.array([raw], pa.binary())})

        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) + end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                runs.append(ids)
                total += len(ids) // 4
                if total >= BLOCK_TOKENS:
                    yield block()
                    number, docs, lengths, runs, total = number + 1, [], [], [], 0
        if docs:
            yield block()

    return gather


def write_tokens(docs: DataFrame, target: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encodes every text and writes `target`/blocks and `target`/table."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or tokenizer_path()
    vocabulary = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    order = [F.col("doc_id"), F.col("text")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = (texts.repartitionByRange(partitions, "doc_id") if partitions else texts.repartitionByRange("doc_id")).sortWithinPartitions(*order)
    shared_dir(spark)
    blocks = ranged.mapInArrow(_blocks(path, end_id, kind == "<u2"), "part int, number long, n_tokens long, docs array<long>, lengths array<long>, raw binary").checkpoint()  # keeps the order of partitions, so that files are in order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=vocabulary)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(n[ids], pa.int64())})

    counted = blocks.select("raw").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(vocabulary, np.int64)
    for row in counted:
        counts[row.id] = row.n
    freq = scaled(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id int, freq int").coalesce(1).write.parquet(f"{target}/table")
    shared = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, starts, _ = tables(shared.value)
        for batch in batches:
            coded = [encode_block(np.frombuffer(raw.as_buffer(), kind), f, starts) for raw in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(coded, pa.binary())], names=["part", "number", "n_tokens", "docs", "lengths", "payload"])

    blocks.mapInArrow(code, "part int, number long, n_tokens long, docs array<long>, lengths array<long>, payload binary").write.parquet(f"{target}/blocks")


def read_tokens(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """A row per document of the files, decoded and checked; `with_ids` adds its ids (little-endian 32-bit bytes)."""
    rows = spark.read.parquet(f"{target}/table").collect()  # at most the vocabulary
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{target}/blocks")
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a partition
    offsets, at = [], 0
    for part, n in sums:
        offsets.append((part, at))
        at += n
    parts = spark.createDataFrame(offsets, "part int, base long")
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "number", "n_tokens").withColumn("inner", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(F.broadcast(parts), "part").select("part", "number", (F.col("base") + F.col("inner")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, starts, slots = tables(shared.value)
        for batch in batches:
            for first, docs, lengths, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = memoryview(decode_block(payload.as_buffer(), f, starts, slots).astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                runs = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(begins + first), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(r) for r in runs], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(r) for r in runs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    placed = blocks.drop("n_tokens").join(F.broadcast(places) if _few(places) else places, ["part", "number"])
    return placed.select("first", "docs", "lengths", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _few(places: DataFrame, limit: int = 100_000) -> bool:
    """Whether the blocks' places (24 bytes each) may be broadcast; else they are joined by shuffling."""
    return places.count() <= limit


def op3_rans_token_files(spark, sf_dir: str) -> DataFrame:
    target = shared_table(spark, "rans")
    write_tokens(read(spark, sf_dir, "documents"), target)
    return read_tokens(spark, target)
