"""Operator 4, toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their 4- and 5-byte prefixes. In every labelled text of the sample each
identity term is swapped for each other one of its group, the features of the swapped text are made anew, and besides the
usual loss and ridge the model pays for the squared change of the score before the logistic function, so that naming a
group doesn't by itself raise the score. Each term stands once more as a text of its own, for those that no labelled text has.

The fit sees a bounded sample: the `SAMPLE` labelled rows with the smallest hashes of the id, none of them held out. Two
narrow passes over these rows count features by class and list those of each row; to the driver go the `FEATURES` that
tell the classes apart best, the sample's rows as lists of them, and the swaps added up by what they change: for each pair
of terms at most one row for each set of their features that other words of a text have too. Scoring is one narrow pass over all rows with the
weights as broadcast (at most FEATURES and the identity terms' features); nothing is shuffled but feature counts.

Defined results: null, empty and wordless texts get the score of the intercept; null ids are scored, are held out by
no fold (held_out false) and never teach; repeated rows get equal scores; of an id with several texts the least teaches; labels that are null or have no document are
ignored; without labels of both kinds all scores are the share of toxic labels (0 without any); an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, cut_lineage, read
from calibrium.llm.decontam import words_of

SAMPLE, FEATURES, MIN_ROWS, FOLDS = 20_000, 4_000, 4, 5
RIDGE, SWAP, STEPS = 2.0, 50.0, 400
#: Terms within a group are swapped for each other.
IDENTITY_GROUPS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"],
    ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "transgender", "queer"],
    ["woman", "man", "girl", "boy"],
    ["women", "men", "girls", "boys"],
    ["female", "male", "nonbinary"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "mexican", "american", "indian", "chinese"],
    ["immigrant", "refugee", "citizen", "foreigner"],
    ["immigrants", "refugees", "citizens", "foreigners"],
    ["disabled", "blind", "deaf", "old", "young"],
    ["frau", "mann", "mädchen", "junge"],
    ["frauen", "männer", "jungen"],
    ["christ", "muslim", "jude", "hindu", "atheist"],
    ["christen", "muslime", "juden", "hindus", "atheisten"],
    ["schwarze", "weiße", "deutsche", "türken", "araber", "ausländer", "flüchtlinge"],
    ["schwul", "lesbisch", "behindert"],
    ["femme", "homme", "fille", "garçon"],
    ["femmes", "hommes", "filles", "garçons"],
    ["chrétien", "musulman", "juif", "hindou", "athée"],
    ["chrétiens", "musulmans", "juifs", "hindous", "athées"],
    ["noirs", "blancs", "arabes", "africains", "étrangers", "immigrés", "réfugiés"],
    ["lesbienne", "homosexuel", "handicapé"],
    ["mujer", "hombre", "niña", "niño"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["cristiano", "musulmán", "judío", "hindú", "ateo"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "ateos"],
    ["negros", "blancos", "árabes", "africanos", "extranjeros", "inmigrantes", "refugiados"],
    ["lesbiana", "homosexuales", "discapacitado"],
]


def features(word: bytes) -> tuple[bytes, ...]:
    """A word and its prefixes, each with its length class so that they don't mix."""
    return (b"w" + word,) + tuple(b"%d" % k + word[:k] for k in (4, 5) if len(word) >= k)


def features_of(text: bytes | None) -> set[bytes]:
    return {f for w in set(words_of(text)) for f in features(w)}


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Weights of features; `bias` is the intercept."""

    def __init__(self, bias: float, weights: dict[bytes, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: bytes | None) -> float:
        get = self.weights.get
        z = self.bias + math.fsum(get(f, 0.0) for f in features_of(text))
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def partners() -> dict[bytes, set[bytes]]:
    """Each identity term and those it is swapped for."""
    out: dict[bytes, set[bytes]] = {}
    for group in IDENTITY_GROUPS:
        for x in group:
            out.setdefault(x.encode(), set()).update(y.encode() for y in group if y != x)
    return out


def swaps_of(words: set[bytes], others: dict[bytes, set[bytes]]) -> Iterator[tuple[int, frozenset, frozenset]]:
    """(terms of x's kind besides x, features gained, features lost) of every swap of a term x of the text for another."""
    held = Counter(f for w in words for f in features(w))
    for x in words & others.keys():
        old = features(x)
        for y in others[x]:
            new = features(y)
            yield len(others[x]), frozenset(f for f in new if f not in held), frozenset(f for f in old if held[f] == 1 and f not in new)


def train(rows: list[list[int]], toxic: np.ndarray, used: np.ndarray, swaps: np.ndarray, weights: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Intercept and weights: logistic loss + RIDGE/2 |w|^2 + SWAP/2 sum(weights * (swaps . w[used])^2), by momentum steps."""
    index = np.fromiter((i for r in rows for i in r), np.int64, sum(map(len, rows)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    scale = np.sqrt(np.bincount(index, minlength=size) + RIDGE)  # a step for each feature, by how often it is met
    w, bias, velocity, v0 = np.zeros(size), math.log(toxic.mean() / (1 - toxic.mean())), np.zeros(size), 0.0
    gram = SWAP * (swaps * weights[:, None]).T @ swaps
    scale[used] = np.sqrt(scale[used] ** 2 + np.abs(gram).sum(axis=1))
    for _ in range(STEPS):
        z = bias + np.bincount(owner, weights=w[index], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        grad = np.bincount(index, weights=error[owner], minlength=size) + RIDGE * w
        grad[used] += gram @ w[used]
        velocity = 0.9 * velocity - 0.1 * grad / scale**2 * 2
        v0 = 0.9 * v0 - 0.1 * 2 * error.sum() / n
        w += velocity
        bias += v0
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    rows = cut_lineage(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen.distinct()), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text")))
    share = rows.agg(F.count("*"), F.avg(F.col("__label").cast("double"))).first()
    if not share[0] or share[1] in (0.0, 1.0):
        p = min(max(share[1] or 0.0, 1e-9), 1 - 1e-9)
        return Model(math.log(p / (1 - p)), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, bad = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = features_of(text)
                every.update(found)
                if label:
                    bad.update(found)
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(every), pa.binary()), "n": pa.array(list(every.values()), pa.int64()), "bad": pa.array([bad[f] for f in every], pa.int64())})

    total, toxic = share[0], share[0] * share[1]
    counted = rows.select("__label", "__text").mapInArrow(count, "f binary, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= MIN_ROWS)
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    tells = part(bad, n * toxic / total) + part(n - bad, n * (1 - toxic / total)) + part(toxic - bad, (total - n) * toxic / total) + part(total - n - toxic + bad, (total - n) * (1 - toxic / total))
    best = [bytes(r.f) for r in counted.orderBy(F.round(tells, 6).desc(), "f").limit(FEATURES).collect()]
    others = partners()
    names: dict[bytes, int] = {}
    for f in [*best, *(f for t in sorted(others) for f in features(t))]:
        names.setdefault(f, len(names))
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [sorted(known[f] for f in features_of(t) if f in known) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "found"])

    table = sorted((r.id, r.label, r.found) for r in rows.select("__id", "__label", "__text").mapInArrow(listed, "id string, label int, found array<int>").collect())  # the sample

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                met.update(swaps_of(set(words_of(text)), others))
        cells = [(k, sorted(shared.value[f] for f in gained), sorted(shared.value[f] for f in lost), n) for (k, gained, lost), n in met.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, c)) for c in cells], schema=kinds)

    kinds = pa.schema([("others", pa.int32()), ("gained", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32())), ("n", pa.int64())])
    changes = rows.select("__text").mapInArrow(swapped, "others int, gained array<int>, lost array<int>, n long").groupBy("others", "gained", "lost").agg(F.sum("n").alias("n"))
    met = Counter({(r.others, tuple(r.gained), tuple(r.lost)): r.n for r in changes.collect()})  # bounded by the pairs of terms
    for x in others:
        met.update((k, tuple(sorted(names[f] for f in gained)), tuple(sorted(names[f] for f in lost))) for k, gained, lost in swaps_of({x}, others))
    used = np.array(sorted({names[f] for t in others for f in features(t)}))
    place = {int(i): k for k, i in enumerate(used)}
    swaps, weights = np.zeros((len(met), len(used))), np.zeros(len(met))
    for row, ((k, gained, lost), n) in enumerate(sorted(met.items())):
        swaps[row, [place[i] for i in gained]] = 1
        swaps[row, [place[i] for i in lost]] = -1
        weights[row] = n / k
    bias, w = train([r[2] for r in table], np.array([float(r[1] != 0) for r in table]), used, swaps, weights, len(names))
    return Model(bias, {f: float(w[i]) for f, i in names.items() if w[i]})


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = [known.score(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
