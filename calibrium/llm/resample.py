"""Operator 11, importance resampling towards a target distribution, by hashed n-gram features.

Features of a text are its words and pairs of neighbouring words, hashed to `buckets`. A bucket's gain is the logarithm
of how much likelier it is in the target texts than in the documents, both smoothed by one; a document's weight is the
mean gain of its features. With Gumbel noise from the id's digest added, the highest scores are a draw without
replacement in proportion to the weights, the same in every run.

Distribution. The counts of the buckets are added up per task, so at most `buckets` rows a task are shuffled and
`buckets` rows reach the driver; gains are an array of that size, sent to the tasks, which score by indexing it. Scores
are whole numbers between the least gain plus noise and the largest, some ten thousand values whatever the rows, so
counts per score are gathered on the driver and give the draw's last score. Rows below it, and texts that are too
short, never move. Each task sorts the other rows of its partition (Spark's sorter, which spills) and cuts the run into
blocks at splitters shared by all, chosen so that between two there are about `MERGE_ROWS` rows; a tournament tree of
losers merges the blocks of all runs between two splitters, starting from the number of rows before and stopping at the
exact draw. Scores with more rows than that are split by quantiles of the id.

Defined results: a null text has no words; a null id is hashed as an empty one and is the last among ties; repeated
rows are drawn each for itself, with ranks in a row; equal scores go by the smaller id, then by the fewer features;
without target texts all gains are near zero and the draw is nearly uniform; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, read

BUCKETS, MIN_WORDS, DRAW_PERCENT, SEED = 10_000, 20, 25, 7
#: Rows that one merge holds, about; words of a text that are worked on at once, in bytes.
MERGE_ROWS, BLOCK_BYTES = 1 << 16, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"
ROW = "doc_id long, n_features long, weight long, score long, copies long"


def features(text: bytes | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the features of a UTF-8 text, block by block. The first block's last part holds pairs, so n words give 2n - 1."""
    text, at, before = (text or b"").translate(_LOWER), 0, None
    while at < len(text):
        upto = text.find(b" ", min(at + BLOCK_BYTES, len(text)))
        upto = len(text) if upto < 0 else upto
        words = text[at:upto].split()
        at = upto
        if not words:
            continue
        single = list(map(crc32, words))
        follow = list(map(crc32, repeat(b" "), single))  # as if a blank came after each
        pairs = map(crc32, words if before is not None else words[1:], follow[:-1] if before is None else [before, *follow[:-1]])
        before = follow[-1]
        yield np.fromiter(single, np.int64, len(single)) % buckets
        yield np.fromiter(pairs, np.int64) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for part in features(text, buckets):
                    found += np.bincount(part, minlength=buckets)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, eligible: narrow, the gains are an array of fixed size in every task."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist()):
                n = total = 0
                for part in features(text, buckets):
                    n += len(part)
                    total += int(gain[part].sum())
                weight = total // n if n else 0
                rows.append((n, weight, weight + noise(doc, seed), (n + 1) // 2 >= min_words))
            n, weight, value, eligible = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, weight, value)), pa.array(eligible, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "eligible"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, SCORED)


Key = tuple[int, bool, int]


def merge_runs(runs: list[Iterator]) -> Iterator:
    """Items of sorted iterators in order, by a tournament tree of losers: a replay of one path for each item.

    Leaves are the runs' heads; every inner place keeps the run that lost there, and place 0 the winner. Equal heads go to
    the earlier run.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    losers, winners = [0] * max(k, 1), [0] * k + list(range(k))
    for place in range(k - 1, 0, -1):
        a, b = winners[2 * place], winners[2 * place + 1]
        winners[place], losers[place] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top]
        heads[top] = next(runs[top], None)
        place = (top + k) >> 1
        while place:
            if beats(losers[place], top):
                losers[place], top = top, losers[place]
            place >>= 1


def _splitters(rows: DataFrame, merge_rows: int) -> list[Key]:
    """First keys of the stretches that are merged apart, in order; keys are (-score, id is null, id)."""
    by_score = sorted(((r[0], r[1]) for r in rows.groupBy("score").count().collect()), reverse=True)
    heavy = {score: -(-n // merge_rows) for score, n in by_score if n > merge_rows}
    inner: dict[int, list[int]] = {}
    if heavy:
        most = max(heavy.values())
        shares = [(i + 1) / most for i in range(most - 1)] or [0.5]
        cuts = rows.where(F.col("score").isin(list(heavy)) & F.col("doc_id").isNotNull()).groupBy("score").agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10 * most).alias("cuts"))
        inner = {score: sorted(set(found)) for score, found in cuts.collect()}
    out, held = [], merge_rows
    for score, n in by_score:
        if held + n > merge_rows:
            out.append((-score, False, -(1 << 63)))
            held = 0
        held += n
        if score in inner:
            out += [(-score, False, cut) for cut in inner[score]]
            held = merge_rows
    return out


def ranked(rows: DataFrame, draw: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """rows (doc_id, n_features, weight, score) with `rank` for the first `draw` by score, then id; else null."""
    spark = rows.sparkSession
    # repeated rows are one row with a count, so that however often an id is repeated no stretch grows by it
    rows = cut_lineage(rows.groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("copies")))
    splitters = spark.sparkContext.broadcast(_splitters(rows, merge_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, bisect_right

        from pyspark import TaskContext

        firsts, run, block = splitters.value, TaskContext.get().partitionId(), 0
        for batch in batches:  # sorted; a batch is one block or is cut at splitters
            ids, scores = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            keys = [(-s, i is None, i or 0) for s, i in zip(scores, ids)]
            if not keys:
                continue
            low, high = bisect_right(firsts, keys[0]) - 1, bisect_right(firsts, keys[-1])
            starts = [0, *(bisect_left(keys, f) for f in firsts[low + 1 : high]), len(keys)]
            parts = [(low + i, a, b) for i, (a, b) in enumerate(zip(starts, starts[1:])) if b > a]
            struct = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            lists = pa.ListArray.from_arrays(pa.array([*(a for _, a, _ in parts), len(keys)], pa.int32()), struct)
            n = [sum(batch.column(4).slice(a, b - a).to_pylist()) for _, a, b in parts]
            columns = [pa.array([c for c, _, _ in parts], pa.int32()), pa.array([run] * len(parts), pa.int32()), pa.array(range(block, block + len(parts)), pa.int32()), pa.array(n, pa.int64()), lists]
            block += len(parts)
            yield pa.RecordBatch.from_arrays(columns, names=["stretch", "run", "block", "n", "rows"])

    in_order = rows.select("doc_id", "n_features", "weight", "score", "copies").sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features")
    blocks = cut_lineage(in_order.mapInArrow(cut, f"stretch int, run int, block int, n long, rows array<struct<{ROW.replace(' long', ': long')}>>"))
    before, total = {}, 0
    for stretch, n in sorted(tuple(r) for r in blocks.groupBy("stretch").agg(F.sum("n")).collect()):
        before[stretch] = total
        total += n
    starts = spark.sparkContext.broadcast(before)

    def merge(stretch: pa.Table) -> pa.Table:
        place = starts.value[stretch["stretch"][0].as_py()]
        order = sorted(range(stretch.num_rows), key=lambda i: (stretch["run"][i].as_py(), stretch["block"][i].as_py()))
        by_run: dict[int, list] = {}
        for i in order:
            by_run.setdefault(stretch["run"][i].as_py(), []).extend(
                (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n_features"], r["weight"], r["copies"]) for r in stretch["rows"][i].as_py()
            )
        out = []
        for negative, no_id, doc, n_features, weight, copies in merge_runs([iter(x) for x in by_run.values()]):
            out.append((None if no_id else doc, n_features, weight, -negative, copies, place))
            place += copies
        columns = list(zip(*out))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_features", "weight", "score", "copies", "place"])

    merged = blocks.groupBy("stretch").applyInArrow(merge, f"{ROW}, place long")
    copies = merged.select("doc_id", "n_features", "weight", "score", F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("copies"))).alias("place"))
    return copies.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= draw, F.col("place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = DRAW_PERCENT, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    bounded_batches(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    rows = cut_lineage(scored(docs, gains, id_col, text_col, min_words, seed))
    counts = sorted((tuple(r) for r in rows.where("eligible").groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    reached, last = 0, None
    for score, n in counts:
        if reached >= draw:
            break
        reached, last = reached + n, score
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*columns, none)
    below = rows.where(~(F.col("eligible") & (F.col("score") >= last))).select(*columns, none)
    return below.unionByName(ranked(rows.where(F.col("eligible") & (F.col("score") >= last)).select(*columns), draw, merge_rows))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: crc32 of `f` in the rows of a table, with the byte table in `crc_table`.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda a, k:
    CASE WHEN k = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t)"""
CRC = """xor(list_reduce(list_transform(range(1, len(f_hex) + 1, 2), lambda i:
    (instr('0123456789ABCDEF', f_hex[i]) * 16 + instr('0123456789ABCDEF', f_hex[i + 1]) - 17)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
ORACLE_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT r, {_FEATURES} AS f FROM d),
dn AS (SELECT r, f, count(*) AS n FROM df GROUP BY r, f),
tn AS (SELECT f, count(*) AS n FROM (SELECT {_FEATURES} AS f FROM (SELECT {_WORDS} AS w FROM benchmark)) GROUP BY f),
known AS (SELECT f, hex(encode(f)) AS f_hex FROM (SELECT f FROM dn UNION SELECT f FROM tn)),
hashed AS (SELECT f, {CRC} % {BUCKETS} AS bucket FROM known, crc_table),
source AS (SELECT bucket, sum(n) AS n FROM dn JOIN hashed USING (f) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS n FROM tn JOIN hashed USING (f) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM source)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(target.n, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((source.n::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket), whole),
sums AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dn JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
weighed AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
  coalesce(CASE WHEN total >= 0 THEN total // n_features ELSE -((n_features - 1 - total) // n_features) END, 0) AS weight,
  list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[i])::BIGINT - 1), lambda a, b: a * 16 + b) AS h
  FROM d LEFT JOIN sums USING (r)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= {MIN_WORDS} AS eligible FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {DRAW_PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
