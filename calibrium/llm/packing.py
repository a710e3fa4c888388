"""Operator 1, best-fit packing by sums of squares.

Each document becomes a run of token ids; runs longer than a sequence are cut. A piece is placed in the open bin (or a
new one) for which the squared counts of open bins per residual gap add up to least afterwards.

Distribution: pieces are dealt to groups of about `group_rows` pieces by a hash of their identity, so groups stay even
whatever ids or lengths are hot, and each group is packed by one task in a few MB. Only ids, lengths and checksums are
shuffled. A group leaves a handful of bins open, of hundreds, so the total stays within a fraction of a per cent of
ceil(tokens / capacity); `tests/llm/test_packing.py` holds it to that.

Defined results: a null or empty text is one piece that holds only the end id; null ids are kept as nulls; repeated rows
are packed each for itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, leaves_nothing, read
from calibrium.llm.tokens import encoder, tokenizer_path

CAPACITY, END_ID, GROUP_ROWS = 4096, 1, 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, placed in the order given.

    A move from gap g to g - s changes the sum of squared counts by 2 * (n[g - s] - n[g]) + 2, a new bin by
    2 * n[capacity - s] + 1; full bins count nothing. Ties go to the smallest gap left, then to the bin opened last.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    level: list[int] = []
    bins, offsets = [], []
    worst = np.iinfo(np.int64).max
    for s in sizes:
        gaps = n[s:]  # before; index is the gap left
        after = n[: capacity + 1 - s]
        change = 2 * (after - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        fresh = 2 * after[-1] + 1 if s < capacity else 0
        change[gaps == 0] = worst
        left = int(change.argmin())
        if change[left] <= fresh:
            b = open_bins[left + s].pop()
            n[left + s] -= 1
        else:
            b, left = len(level), capacity - s
            level.append(0)
        bins.append(b)
        offsets.append(level[b])
        level[b] += s
        if left:
            open_bins[left].append(b)
            n[left] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most `capacity` tokens; `with_ids` adds the ids themselves (little-endian 32-bit bytes)."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for values, x in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        values.append(x)
            columns = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(leaves_nothing(cut), PIECES + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, rows: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """sequence_id and offset for each piece; `rows`: about how many pieces there are, for the number of groups."""
    groups = max(1, round(rows / group_rows))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(part["length"].to_pylist(), capacity)
        group = part["g"][0].as_py() << 32
        return part.drop_columns("g").append_column("sequence_id", pa.array(np.array(bins, np.int64) + group)).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document in as few sequences of at most `capacity` tokens as sums of squares find."""
    bounded_batches(docs.sparkSession)
    pieces = token_pieces(docs, path or tokenizer_path(), id_col, text_col, capacity, end_id, with_ids)
    return pack_pieces(pieces, docs.count(), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
