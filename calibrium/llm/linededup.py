"""Operator 9, repeated runs of lines by a suffix array over line ids.

A document is its sequence of lines that hold a word. A run of lines with at least `MIN_WORDS` words that occurs before,
in an earlier document or higher up in the same one, is deleted. Each of its lines stays somewhere, but not always in one
piece: the rule looks at the input, so a run whose first copy overlaps a later copy of another run loses those lines
there (they stay where that other run comes first), and its own later copies go all the same. Order is (id, text hash, line). Words are what ASCII white space parts, everywhere in this module.

1. Lines get 128-bit ids. Only lines that occur twice or more go on: no repeated run holds another line.
2. Prefix doubling: rank 0 sorts the line ids; rank k + 1 sorts the pairs (rank k here, rank k 2**k lines on). Suffixes
   whose pair is unique leave. The distinct pairs, counted before they are shuffled, are sorted by range and numbered by
   partition offsets; ranks of hot lines come back by broadcast (`join_counted`), so that no task sees all copies of one. Depth 2**DEPTH suffices: a shortest run with
   MIN_WORDS words has at most MIN_WORDS lines.
3. A longest-common-prefix interval of depth d is the suffixes that share their first d lines: those with equal ranks at
   both ends, (rank k at i, rank k at i + d - 2**k) with 2**k <= d < 2**(k + 1). For each line the shortest run with
   MIN_WORDS words that begins there, and the one that ends there, are looked up so. A maximal repeated run is the union
   of such runs. In each interval all but the first position are later copies.
4. The deleted runs of a document are merged and cut out of its text.

Shuffles carry line ids, ranks and positions, never text; the documents are joined with their merged runs in the end, by
broadcast up to `BROADCAST_DOCS` changed documents.

Defined results: null text stays null, with no lines; empty texts stay; a document may be left empty; rows with equal id
and text are one document and share its result; a null id counts as larger than any other; an empty table gives no rows;
all columns of the input are kept, and the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, join_counted, leaves_nothing, let_go, read, release

MIN_WORDS = 50
BROADCAST_DOCS = 500_000
NO_ID = (1 << 63) - 1
POSITION = ["doc", "th", "no"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line with a word: position, id (h1, h2), and the shortest runs that begin and end here.

    A run is its length, and its first and last lines as places in the whole text. `ahead` is the run from here, `back`
    the run that ends here; null if the document hasn't the words.
    """
    run = pa.struct([("no", pa.int32()), ("length", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            parts = []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                counted = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                at = np.flatnonzero(counted)
                n = len(at)
                if not n:
                    continue
                total = np.concatenate(([0], np.cumsum(counted[at])))
                end = np.searchsorted(total, total[:-1] + min_words)  # first boundary with the words
                begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(lines[i]) for i in at.tolist()]), "<i8").reshape(-1, 2)
                parts.append((np.full(n, doc), np.full(n, th), np.arange(n), ids[:, 0], ids[:, 1], end, begin, at, np.full(n, n)))
            if not parts:
                continue
            doc, th, no, h1, h2, end, begin, at, n = (np.concatenate(x) for x in zip(*parts))
            base = np.arange(len(no)) - no
            i32 = lambda x: pa.array(x.astype(np.int32))
            stop = np.minimum(end, n)
            ahead = pa.StructArray.from_arrays([i32(no), i32(end - no), i32(at), i32(at[base + stop - 1])], fields=list(run), mask=pa.array(end > n))
            back = pa.StructArray.from_arrays([i32(begin), i32(no + 1 - begin), i32(at[base + np.maximum(begin, 0)]), i32(at)], fields=list(run), mask=pa.array(begin < 0))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), i32(no), pa.array(h1), pa.array(h2), ahead, back], names=["doc", "th", "no", "h1", "h2", "ahead", "back"])

    kind = "struct<no:int, length:int, first:int, last:int>"
    return docs.mapInArrow(leaves_nothing(split), f"doc long, th long, no int, h1 long, h2 long, ahead {kind}, back {kind}")


def _ranked(suffixes: DataFrame, first: str, second: str) -> DataFrame:
    """(doc, th, no, rank): dense ranks of (first, second) in sorted order, for the suffixes whose pair repeats."""
    spark = suffixes.sparkSession
    pairs = suffixes.groupBy(first, second).agg(F.count("*").alias("n")).where("n > 1")
    held = cut_lineage(pairs.repartitionByRange(first, second).sortWithinPartitions(first, second).select(first, second, "n", F.monotonically_increasing_id().alias("m")))
    held = held.select(first, second, "n", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"))
    base, rows = 0, []
    for part, n in sorted(tuple(r) for r in held.groupBy("part").count().collect()):  # one row a partition
        rows.append((part, base))
        base += n
    offsets = spark.createDataFrame(rows, "part int, base long")
    ranks = held.join(F.broadcast(offsets), "part").select(first, second, "n", (F.col("base") + F.col("at")).alias("new"))
    return cut_lineage(join_counted(suffixes, ranks, [first, second], "n").select(*POSITION, F.col("new").alias("rank")))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, runs): merged runs of lines, as places in the text, that are later copies. docs: doc, th, text."""
    lines = cut_lineage(_lines(docs, min_words))
    repeated = cut_lineage(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    suffixes = cut_lineage(join_counted(lines, repeated, ["h1", "h2"], "n").drop("n"))
    release(lines, repeated)
    # rows with equal id and text are one document: their positions count once, else each level would square their number
    if not suffixes.where("no = 0").groupBy("doc", "th").count().where("count > 1").isEmpty():
        suffixes = cut_lineage(suffixes.dropDuplicates(POSITION))
    levels = [_ranked(suffixes, "h1", "h2")]
    while (1 << len(levels)) <= min_words:
        step, now = 1 << (len(levels) - 1), levels[-1]
        on = now.select("doc", "th", (F.col("no") - step).alias("no"), F.col("rank").alias("then"))
        shifted = cut_lineage(now.join(on, POSITION))
        levels.append(_ranked(shifted, "rank", "then"))
        release(shifted)
        if levels[-1].isEmpty():
            break
    ranks = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranks = ranks.union(level.withColumn("k", F.lit(k)))

    runs = suffixes.select("doc", "th", F.col("ahead").alias("run")).union(suffixes.select("doc", "th", F.col("back").alias("run"))).where("run IS NOT NULL")
    runs = runs.select("doc", "th", "run.*").distinct()
    runs = runs.withColumn("k", (F.length(F.conv(F.col("length").cast("string"), 10, 2)) - 1))
    placed = runs.join(ranks, ["doc", "th", "no", "k"]).withColumn("end_no", F.expr("no + length - shiftleft(1, k)"))
    placed = placed.join(ranks.select("doc", "th", "k", F.col("no").alias("end_no"), F.col("rank").alias("end_rank")), ["doc", "th", "k", "end_no"])
    placed = cut_lineage(placed.select(*POSITION, "length", "first", "last", "rank", "end_rank"))
    interval = ["length", "rank", "end_rank"]
    release(suffixes, *levels)
    heads = cut_lineage(placed.groupBy(*interval).agg(F.min(F.struct(*POSITION, "last")).alias("head"), F.count("*").alias("n")).where("n > 1"))
    copies = join_counted(placed, heads, interval, "n").where(F.struct(*POSITION, "last") != F.col("head"))
    overlaps = (F.col("doc") == F.col("head.doc")) & (F.col("th") == F.col("head.th"))  # what the first copy covers stays
    copies = copies.select("doc", "th", F.when(overlaps, F.greatest(F.col("first"), F.col("head.last") + 1)).otherwise(F.col("first")).alias("first"), "last")

    before = Window.partitionBy("doc", "th").orderBy("first", "last")
    fresh = F.coalesce(F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    islands = copies.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(before))
    merged = islands.groupBy("doc", "th", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return cut_lineage(merged.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs cut out of the text, n_lines (before) and n_removed."""
    bounded_batches(docs.sparkSession)
    doc, th = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col))
    gone = later_copies(docs.select(doc.alias("doc"), th.alias("th"), F.col(text_col).alias("text")), min_words).select(F.struct("doc", "th").alias("__key"), F.col("runs").alias("__runs"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_DOCS else gone
    joined = docs.withColumn("__key", F.struct(doc.alias("doc"), th.alias("th"))).join(gone, "__key", "left").drop("__key")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: i.between(r["first"], r["last"]))), "\n")
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0))
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": removed.cast("long")}
    out = joined.withColumns(counts | {"__text": F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(left)})
    return out.withColumn(text_col, F.col("__text")).drop("__runs", "__text")


def op9_line_run_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def without_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without later copies; a document of which nothing is left is itself such a copy and goes."""
    out = drop_repeated_lines(docs)
    left = out.where((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    if "n_chars" not in docs.columns:
        return left.select(*docs.columns)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


#: Runs as strings: no suffixes, ranks or hashes.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM docs),
lines AS (
  SELECT doc_id, line, place, row_number() OVER d AS no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS c FROM lines),
runs AS (
  SELECT a.doc_id, a.no, a.place AS first, min(b.no) AS upto FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.no BETWEEN a.no AND a.no + 50 AND b.c - a.c + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.no), max(a.place), b.no FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.no BETWEEN b.no - 50 AND b.no AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.no),
texts AS (
  SELECT r.doc_id, r.no, r.upto, min(l.place) AS first, max(l.place) AS last, string_agg(l.line, chr(10) ORDER BY l.no) AS run
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.no BETWEEN r.no AND r.upto GROUP BY ALL),
later AS (
  SELECT *, row_number() OVER same AS copy, first_value(doc_id) OVER same AS head, first_value(last) OVER same AS upto_place
  FROM texts WINDOW same AS (PARTITION BY run ORDER BY doc_id, no)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(CASE WHEN doc_id = head THEN greatest(first, upto_place + 1) ELSE first END, last)) AS place
  FROM later WHERE copy > 1),
kept AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
         coalesce(string_agg(r.line, chr(10) ORDER BY r.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.place = r.place GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
