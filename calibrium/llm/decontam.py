"""Operator 10, benchmark decontamination by a BM25 index of the test items with block-max pruning.

The test items are the indexed documents; every passage of the corpus (`WINDOW` words, a new one each `STRIDE`) is a
query. A posting's impact is its BM25 weight divided by the item's score against its own text, so a passage that holds
an item scores 1 and one threshold serves all items. As in block-max WAND a passage is scored only where an upper bound
reaches the threshold: bounds are sums of each essential term's largest impact in a block of `BLOCK` items, plus what an item's
other terms (its most common ones, up to `REST` of its score) could add, computed for all passages of a batch at once; no
passage above the threshold is lost. Retrieved pairs are verified on words: the share of
the question's five-word shingles and the share of the answer's words found in the passage (an item's question is its
first two thirds).

Items longer than STRIDE words are indexed in pieces of that length, so that each piece lies whole within a passage; what
is left at the end, however short, finds pairs by its own score but is verified as the item's last STRIDE words. These are
indexed besides, for leaks that lie across the last cut, and give a pair only where it is a leak. Counts of pieces and terms and the mean length are those of all items, in one shard or many. The index travels by broadcast in shards of at most `SHARD` pieces; more items mean more passes over the corpus, never
a larger broadcast. Nothing is shuffled but the few pairs found.

Defined results: null and empty texts and items match nothing; items without words are ignored; items with the same id
are one item, of which any piece counts; repeated rows are found each for itself; null ids stay null; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, leaves_nothing, read

WINDOW, STRIDE, BLOCK, SHARD = 128, 64, 8, 4096
K1, B = 1.2, 0.75
THRESHOLD, REST, QUESTION, ANSWER, WIDTH = 0.5, 0.3, 0.5, 0.75, 5
BROADCAST_IDS = 1_000_000
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leaked boolean"
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def pieces_of(text: str | None) -> list[list[bytes]]:
    words = words_of((text or "").encode())
    return [words[at : at + STRIDE] for at in range(0, len(words), STRIDE)]


class Index:
    """Impacts of each term in each piece, and their maxima over blocks of pieces."""

    def __init__(self, items: list[tuple[int | None, str | None]], counts: tuple[int, int, dict] | None = None):
        """counts: pieces, their words, and pieces by term, where `items` aren't all there are."""
        self.pieces = [(item, piece) for item, text in items for piece in pieces_of(text)]
        n = self.bridges = len(self.pieces)
        held = [words for _, words in self.pieces]
        for item, text in items:
            last = pieces_of(text)[-2:]
            if len(last) == 2 and len(last[1]) < STRIDE:
                self.pieces.append((item, (last[0] + last[1])[-STRIDE:]))
        self.terms = {w: i for i, w in enumerate(sorted({w for _, words in self.pieces for w in words}))}
        total, length, df = counts or (n, sum(map(len, held)), Counter(w for words in held for w in set(words)))
        n = len(self.pieces)
        mean = length / max(1, total)
        blocks = -(-n // BLOCK)
        self.impact = np.zeros((len(self.terms), blocks * BLOCK), np.float32)
        for j, (_, words) in enumerate(self.pieces):
            norm = K1 * (1 - B + B * len(words) / mean)
            weights = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
            own = sum(weights.values())
            for w, x in weights.items():
                self.impact[self.terms[w], j] = x / own
        # an item's least terms, up to REST of its score, don't make a passage a candidate: they add REST to its bound at most
        order = np.argsort(self.impact, axis=0, kind="stable")
        spent = np.take_along_axis(self.impact, order, axis=0).cumsum(axis=0) if len(self.terms) else self.impact
        spared = np.zeros(self.impact.shape, bool)
        np.put_along_axis(spared, order, spent <= REST, axis=0) if len(self.terms) else None
        self.rest = np.where(spared, self.impact, 0).sum(axis=0).reshape(blocks, BLOCK).max(axis=1) if n else np.zeros(0, np.float32)
        heavy = np.where(spared, 0, self.impact)
        rows = np.flatnonzero(heavy.any(axis=1))
        names = list(self.terms)
        self.essential = {names[i]: k for k, i in enumerate(rows.tolist())}
        self.bound = heavy[rows].reshape(len(rows), blocks, BLOCK).max(axis=2)
        whole = [last for _, text in items for pieces in [pieces_of(text)] for last in [*pieces[:-1], sum(pieces[-2:], [])[-STRIDE:]][: len(pieces)]]
        self.parts = [self._parts(words) for words in whole + [words for _, words in self.pieces[self.bridges :]]]

    @staticmethod
    def _parts(words: list[bytes]) -> tuple[set, set]:
        cut = -(-2 * len(words) // 3)
        question, answer = words[:cut], words[cut:] or words
        return grams(question), set(answer)

    def verify(self, piece: int, words: list[bytes]) -> tuple[float, float]:
        question, answer = self.parts[piece]
        width = len(next(iter(question)))
        return len(question & grams(words, width)) / len(question), len(answer & set(words)) / len(answer)

    def search(self, docs: list[list[bytes]], threshold: float) -> list[tuple[int, int, float, int]]:
        """(document, piece, score, first word) of every passage and piece at or above the threshold."""
        get, size = self.essential.get, max(1, len(self.essential))
        ids = np.array([get(w, -1) for words in docs for w in words], np.int64)
        sizes = np.array([-(-len(words) // STRIDE) + 1 for words in docs])  # an empty chunk ends each document
        first = np.concatenate(([0], np.cumsum(sizes)))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        begins = np.concatenate(([0], np.cumsum([len(words) for words in docs])))
        owner = np.searchsorted(begins, known, "right") - 1
        pairs = np.unique((first[owner] + (known - begins[owner]) // STRIDE) * size + ids[known])
        chunk, ids = np.divmod(pairs, size)
        starts = np.searchsorted(chunk, np.arange(first[-1] + 1))
        bounds = np.zeros((first[-1], self.bound.shape[1]), np.float32)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        step = max(1, 4_000_000 // max(1, self.bound.shape[1]))  # bounded memory for the gathered rows
        group, edges = 0, starts[full]
        while group < len(full):
            upto = max(group + 1, int(np.searchsorted(edges, edges[group] + step)))
            lo, hi = edges[group], edges[upto] if upto < len(full) else len(ids)
            bounds[full[group:upto]] = np.add.reduceat(self.bound[ids[lo:hi]], edges[group:upto] - lo, axis=0)
            group = upto
        found = []
        owner = np.repeat(np.arange(len(docs)), sizes)
        windows, blocks = np.nonzero(bounds[:-1] + bounds[1:] + self.rest >= threshold - 1e-4)
        for c, block in zip(windows.tolist(), blocks.tolist()):
            doc = int(owner[c])
            begin = (c - int(first[doc])) * STRIDE
            if owner[c] != owner[c + 1]:
                continue  # the chunk after a document's end begins the next
            terms = sorted({self.terms[w] for w in docs[doc][begin : begin + WINDOW] if w in self.terms})
            scores = self.impact[terms, block * BLOCK : (block + 1) * BLOCK].sum(axis=0, dtype=np.float64)
            for j in np.flatnonzero(scores >= threshold).tolist():
                found.append((doc, block * BLOCK + j, float(scores[j]), begin))
        return found


def grams(words: list[bytes], width: int = WIDTH) -> set:
    k = max(1, min(width, len(words)))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _term_counts(items: DataFrame) -> DataFrame:
    """(term, n): the pieces that hold each term, n pieces under null and their words under an empty term. items: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for words in pieces_of(text):
                    found.update({None: 1, b"": len(words)})
                    found.update(set(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return items.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _search(docs: DataFrame, items: list, threshold: float, counts: tuple[int, int, dict] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, counts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for at in range(0, len(ids), 256):
                words = [words_of(t) for t in texts[at : at + 256]]
                best: dict[tuple, tuple] = {}
                for doc, piece, score, begin in index.search(words, threshold):
                    question, answer = index.verify(piece, words[doc][begin : begin + WINDOW])
                    leaked = question >= QUESTION and answer >= ANSWER
                    if piece >= index.bridges and not leaked:
                        continue
                    new = (leaked, round(score, 4), round(question, 4), round(answer, 4))
                    key = (doc, index.pieces[piece][0])
                    best[key] = max(best.get(key, new), new)
                rows = [(ids[at + d], item, s, q, a, leaked) for (d, item), (leaked, s, q, a) in best.items()]
                if rows:
                    columns = list(zip(*rows))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PAIRS.split(", ")])

    return docs.mapInArrow(leaves_nothing(search), PAIRS)


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, overlaps, leaked: every document and item with a passage at or above the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(F.ceil(words / STRIDE) + (words > STRIDE).cast("int"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD))
    terms = cut_lineage(_term_counts(items)) if shards > 1 else None
    found = None
    for shard in range(shards):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        counts = None
        if terms is not None:
            own = terms.join(_term_counts(some).select("term"), "term", "left_semi").union(terms.where("term IS NULL"))
            by_term = {None if r.term is None else bytes(r.term): r.n for r in own.collect()}
            counts = (by_term.pop(None, 0), by_term.pop(b"", 0), by_term)
        part = _search(texts, sorted((tuple(r) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), threshold, counts)
        found = part if found is None else found.union(part)
    if shards == 1:
        return found
    best = F.max(F.struct("leaked", "score", "question_overlap", "answer_overlap")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", "x.question_overlap", "x.answer_overlap", "x.leaked")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def without_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no test item.

    Whether a text leaks depends on the text alone, so rows are told apart by its hash: a clean row stays whatever ids it
    shares, and a leaked one goes though its id is null.
    """
    text = F.xxhash64("text")
    gone = benchmark_leaks(docs.select(text.alias("h"), "text"), read(spark, sf_dir, "benchmark"), id_col="h").where("leaked")
    gone = cut_lineage(gone.select(F.col("doc_id").alias("__h")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, text == F.col("__h"), "left_anti")
