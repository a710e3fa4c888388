"""A linear probe: multinomial logistic regression on feature vectors, its penalty chosen by pooled out-of-fold NLL."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrium.functions import vectors as V
from calibrium.operators import dataset as D


def penalties() -> list[float]:
    return [10 ** (-4 + i / 2) for i in range(13)]


def fit(rows: DataFrame, c: float, n: int | None = None):
    """rows: y, features (array). c weighs the loss as sum of losses * c + |w|^2 / 2 over standardised features.

    Spark divides the loss by n and scales by the sample deviation, so its penalty is (n - 1) / (n^2 * c).
    """
    n = n or rows.count()
    ready = rows.select(F.col("y").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", regParam=(n - 1) / (n * n * c), elasticNetParam=0.0, standardization=True, maxIter=500, tol=1e-9)
    return model.fit(ready)


def logits(model, rows: DataFrame) -> DataFrame:
    """rows with logits: the decision values."""
    ready = rows.withColumn("__x", F.col("features")).withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return model.transform(ready).withColumn("logits", vector_to_array("rawPrediction")).withColumn("features", F.col("__x")).drop("__x", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, c: float, k_folds: int) -> DataFrame:
    """Logits of each row by the model that didn't see its fold."""
    out = None
    for fold in range(k_folds):
        part = logits(fit(rows.where(F.col("fold") != fold), c), rows.where(F.col("fold") == fold))
        out = part if out is None else out.union(part)
    return out


def mean_nll(rows: DataFrame, k: int) -> float:
    p = V.softmax(F.col("logits"), k)
    return rows.select(F.avg(V.nll_term(V.pick(p, F.col("y")))).alias("nll")).first().nll


def select_penalty(rows: DataFrame, k: int, grid: list[float] | None = None, key: str = "id", seed: int = 7) -> tuple[float, DataFrame, dict[float, float]]:
    """The first c with the least pooled out-of-fold NLL, its out-of-fold rows, and NLL by c. Folds: 5, or 3 below 96 rows."""
    n = rows.count()
    folded = D.folds(rows, ["y"], key, 5 if n >= 96 else 3, seed).cache()
    found = {c: out_of_fold(folded, c, 5 if n >= 96 else 3) for c in grid or penalties()}
    nll = {c: mean_nll(df, k) for c, df in found.items()}
    best = min(nll, key=lambda c: (round(nll[c], 12), c))
    return best, found[best], nll


def probe_gauge(fit_rows: DataFrame, exam_rows: DataFrame, k: int, grid: list[float] | None = None) -> DataFrame:
    """Out-of-fold logits for the fit rows, logits of the refitted model for the exam rows; oof tells which."""
    c, oof, _ = select_penalty(fit_rows, k, grid)
    model = fit(fit_rows, c)
    cols = [x for x in fit_rows.columns if x != "features"]
    return oof.select(*cols, "logits", F.lit(True).alias("oof")).union(logits(model, exam_rows).select(*cols, "logits", F.lit(False).alias("oof")))


def subsample(rows: DataFrame, n: int, draw: int, k: int, key: str = "id") -> DataFrame:
    """About n rows, equally many of each class, by hash order of the draw."""
    sizes = rows.groupBy("y").count().select("y", F.lit(n // k).alias("k"))
    return D.sample_per_group(rows, ["y"], key, sizes, 1000 + draw)
