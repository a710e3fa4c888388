"""Column functions over score vectors (array<double>) of a fixed number of classes.

They unroll over the classes, so they stay within whole-stage code generation.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["no-call", "one-call", "multi-call"]
FLOOR = 1e-12
CONTRACT_TOLERANCE = 1e-6


def elements(vector: Column, k: int) -> list[Column]:
    return [F.get(vector, F.lit(i)) for i in range(k)]


def label_index(label: Column, labels: list[str] | None = None) -> Column:
    """Place of a label in its ordered domain; an unknown label is an error."""
    known = F.array(*[F.lit(x) for x in labels or LABELS])
    place = F.array_position(known, label) - 1
    return F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))).cast("int")


def softmax(logits: Column, k: int, temperature: Column | float = 1.0) -> Column:
    """Softmax of logits / temperature, shifted by the largest so that it can't overflow."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    t = F.when(t > 0, t).otherwise(F.raise_error(F.lit("temperature must be positive")).cast("double"))
    z = [x / t for x in elements(logits, k)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = functools.reduce(lambda a, b: a + b, e)
    return F.array(*[x / total for x in e])


def argmax(vector: Column) -> Column:
    """Place of the largest element; the first of equals, -1 for a null vector.

    Never null: joins on it then infer no null test, which the optimizer would push down and spell out in full.
    """
    return F.coalesce((F.array_position(vector, F.array_max(vector)) - 1).cast("int"), F.lit(-1))


def confidence(vector: Column) -> Column:
    return F.array_max(vector)


def pick(vector: Column, index: Column) -> Column:
    return F.get(vector, index)


def nll_term(p_label: Column) -> Column:
    return -F.ln(F.greatest(F.least(p_label, F.lit(1.0)), F.lit(FLOOR)))


def rotate_back(values: Column, rotation: Column, k: int) -> Column:
    """Values read in rotated letter order, put back into label order: aligned[i] = values[(i - rotation) mod k]."""
    return F.array(*[F.get(values, F.pmod(F.lit(i) - rotation, F.lit(k)).cast("int")) for i in range(k)])


def mean_of_vectors(vectors: Column, k: int) -> Column:
    """Element-wise mean of an array of vectors."""
    n = F.size(vectors)

    def total(i: int) -> Column:
        return F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)))

    return F.array(*[total(i) / n for i in range(k)])


def one_hot(index: Column, value: Column, k: int) -> Column:
    """`value` at `index`, 0 elsewhere; all 0 where the index is null or out of range."""
    return F.array(*[F.when(index == i, value).otherwise(0.0) for i in range(k)])


def log_floor(vector: Column, k: int) -> Column:
    return F.array(*[F.ln(F.greatest(x, F.lit(FLOOR))) for x in elements(vector, k)])


def meets_contract(vector: Column, k: int) -> Column:
    """k finite probabilities that add up to 1."""
    p = elements(vector, k)
    fine = functools.reduce(lambda a, b: a & b, [~F.isnan(x) & (x >= 0) & (x <= 1) for x in p])
    total = functools.reduce(lambda a, b: a + b, p)
    return F.coalesce((F.size(vector) == k) & fine & (F.abs(total - 1) <= CONTRACT_TOLERANCE), F.lit(False))


def valid_logits(vector: Column, k: int) -> Column:
    """k numbers, of which minus infinity is allowed."""
    fine = functools.reduce(lambda a, b: a & b, [~F.isnan(x) & (x < float("inf")) for x in elements(vector, k)])
    return F.coalesce((F.size(vector) == k) & fine, F.lit(False))


def answered(conf: Column, pred: Column, taus: list[float]) -> Column:
    """Whether the confidence reaches the threshold of the predicted class."""
    tau = functools.reduce(lambda acc, kv: F.when(pred == kv[0], F.lit(float(kv[1]))).otherwise(acc), enumerate(taus), F.lit(None).cast("double"))
    return F.coalesce(conf >= tau, F.lit(False))


def bin_of(conf: Column, bins: int) -> Column:
    """Equal-width bins [e_b, e_b+1) over [0, 1]; the last is closed."""
    return F.coalesce((F.least(F.width_bucket(conf, F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)) - 1).cast("int"), F.lit(-1))


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded; null for null, NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits))


def percent_with_interval(value: Column, lo: Column, hi: Column) -> Column:
    """"71.2 [68.0, 74.4]", an em dash where there is no value."""
    number = lambda c: F.format_string("%.1f", c * 100)
    return F.when(value.isNull(), "—").when(lo.isNull(), number(value)).otherwise(F.concat(number(value), F.lit(" ["), number(lo), F.lit(", "), number(hi), F.lit("]")))
