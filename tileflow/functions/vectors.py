"""Column expressions over numeric vectors (``array<double>``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside a lambda over a long array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def softmax(v: Column) -> Column:
    exps = _let(F.array_max(v), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    return normalise_sum(exps)


def normalise_sum(v: Column) -> Column:
    """Divide by the sum; a vector that sums to 0 gives nulls."""
    return _let(
        v,
        lambda w: _let(total(w), lambda s: F.transform(w, lambda x: F.try_divide(x, s))),
    )


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return _let(
        F.when(norm == 0, F.lit(1.0)).otherwise(norm),
        lambda n: F.transform(doubles(v), lambda x: x / n),
    )


def hill_number(p: Column) -> Column:
    """exp(Shannon entropy); zero entries carry no weight."""
    positive = F.filter(doubles(p), lambda x: x > 0)
    return F.exp(-F.aggregate(positive, F.lit(0.0), lambda acc, x: acc + x * F.log(x)))


def apply_prior(p: Column, prior: Column, renormalise: bool = False) -> Column:
    """Element-wise product; no prior leaves the vector as it is."""
    weighted = F.when(prior.isNull(), doubles(p)).otherwise(
        F.zip_with(doubles(p), doubles(prior), lambda x, y: x * y)
    )
    return normalise_sum(weighted) if renormalise else weighted


def count_above(v: Column, threshold: float) -> Column:
    return F.size(F.filter(doubles(v), lambda x: x > threshold))


def top_entries(v: Column, k: int) -> Column:
    """The k largest entries as ``array<struct<class_idx, score>>``; ties go to the lower index.

    A plain sort of the numbers finds the k-th largest; only entries that reach it are ordered with
    their index, which is much cheaper for thousands of classes.
    """
    size = F.size(v)
    kth = F.element_at(F.sort_array(doubles(v)), F.greatest(size - k + 1, F.least(size, F.lit(1))))

    def best(limit: Column) -> Column:
        keyed = F.transform(
            doubles(v), lambda x, i: F.when(x >= limit, F.struct((-x).alias("neg"), i.cast("int").alias("class_idx")))
        )
        return F.transform(
            F.slice(F.array_sort(F.filter(keyed, lambda e: e.isNotNull())), 1, k),
            lambda e: F.struct(e["class_idx"].alias("class_idx"), (-e["neg"]).alias("score")),
        )

    none = F.array().cast("array<struct<class_idx: int, score: double>>")
    return F.when(size > 0, _let(kth, best)).when(size == 0, none)


def top_entry_map(v: Column, k: int) -> Column:
    """The k largest entries as ``map<string, double>`` keyed by class index."""
    return F.map_from_entries(
        F.transform(top_entries(v, k), lambda e: F.struct(e["class_idx"].cast("string"), e["score"]))
    )


def entries_to_vector(entries: Column) -> Column:
    """``array<struct<class_idx, score>>`` -> scores in class order."""
    return F.transform(F.array_sort(entries), lambda e: e["score"])


def entries_needed(p: Column, share: float) -> Column:
    """How many of the largest entries are needed before their running sum reaches ``share``."""
    ordered = F.sort_array(doubles(p), asc=False)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x
        short = F.when(cum < share, F.lit(1)).otherwise(F.lit(0))
        return F.struct(cum.alias("cum"), (acc["n"] + short).alias("n"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"] + 1)
