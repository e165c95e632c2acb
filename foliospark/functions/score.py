"""Scores: scaling, vectors, entropy and the fusion of components. All native, all null-aware."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once a row though use reads it for every element of an array."""
    return F.transform(F.array(value), use)[0]


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _INF)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; low where x is not finite, null included."""
    return F.when(finite(x), F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(F.lit(low))


def normalize_score(x: Column, low: Column, high: Column) -> Column:
    """x scaled to [0, 1]; 0.5 if the bounds are equal, 0 where x or a bound is not finite."""
    fine = finite(x) & finite(low) & finite(high)
    return F.when(~fine, 0.0).when(low == high, 0.5).otherwise(clip((x - low) / (high - low)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_valid(v: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, all finite, not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: finite(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def norm_within(v: Column, low: float = 0.98, high: float = 1.02) -> Column:
    """Whether a vector can be compared and its squared length lies in [low, high]."""
    return vector_valid(v) & F.coalesce(dot(v, v).between(low, high), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]. Empty, unequally long, non-finite, zero and null vectors give 0. Scaled by the largest value
    first, so that no square overflows."""

    def scaled(v: Column) -> Column:
        top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        return let(top, lambda t: F.transform(v, lambda x: x.cast("double") / t))

    value = let(scaled(a), lambda p: let(scaled(b), lambda q: dot(p, q) / (F.sqrt(dot(p, p)) * F.sqrt(dot(q, q)))))
    return F.when(vector_valid(a) & vector_valid(b) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).otherwise(0.0)


def cosine_to_unit(x: Column) -> Column:
    """A cosine moved to [0, 1]."""
    return (clip(x, -1.0, 1.0) + 1) / 2


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays zero, null stays null."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def entropy(values: Column) -> Column:
    """Entropy of weights over its maximum, in [0, 1]: 0 for at most one value, 1 if all are 0. Negative and non-finite
    weights count as 0, and zeros count among the values."""
    weights = F.transform(values, lambda x: F.when(finite(x) & (x > 0), x.cast("double")).otherwise(0.0))

    def of(w: Column, total: Column) -> Column:
        h = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.when(x > 0, -(x / total) * F.log(x / total)).otherwise(0.0))
        return F.when(F.size(w) <= 1, 0.0).when(total == 0, 1.0).otherwise(clip(h / F.log(F.size(w).cast("double"))))

    return let(weights, lambda w: let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda total: of(w, total)))


def model_uncertainty(confidences: Column) -> Column:
    """Entropy of the softmax of confidences; null for a null array, 0 for at most one finite value."""
    values = F.filter(confidences, lambda x: finite(x))

    def softmax(top: Column) -> Column:
        return F.transform(values, lambda x: F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x.cast("double") - top))))

    soft = let(F.array_max(values), softmax)
    return F.when(confidences.isNull(), F.lit(None).cast("double")).when(F.size(values) <= 1, 0.0).otherwise(entropy(soft))


# Default weights of the fused components.
WEIGHTS = {"sv": 0.25, "st": 0.25, "sr": 0.20, "sf": 0.20, "sg": 0.05, "se": 0.10, "u": -0.05}
# Components and the names under which they are reported as missing.
NAMES = {"sv": "visual", "st": "text", "sr": "region", "sf": "function", "sg": "graph", "se": "evidence", "u": "model_uncertainty"}


def fuse(
    components: dict[str, Column],
    weights: dict[str, float | Column] | None = None,
    reliability: dict[str, Column] | None = None,
    available: dict[str, Column] | None = None,
) -> Column:
    """STRUCT<score, contributions, missing>: the weighted sum of components.

    A null component is missing and adds nothing; weights are not spread over the rest. ``available`` can declare one
    missing that has a value. Reliability (1 unless given) scales the five modalities. Uncertainty is subtracted.
    """
    w = WEIGHTS | (weights or {})
    there = {k: F.coalesce((available or {}).get(k, F.lit(True)), F.lit(True)) & components.get(k, F.lit(None)).isNotNull() for k in NAMES}
    parts = {}
    for k in NAMES:
        factor = F.lit(1.0) if k in ("se", "u") else clip((reliability or {}).get(k, F.lit(1.0)))
        value = components.get(k, F.lit(None)).cast("double")
        weight = w[k] if isinstance(w[k], Column) else F.lit(w[k])
        parts[k] = F.when(there[k], weight * clip(value) * factor).otherwise(0.0)
    missing = F.filter(F.array(*[F.when(~there[k], F.lit(n)) for k, n in NAMES.items()]), lambda x: x.isNotNull())
    return F.struct(
        reduce(lambda a, b: a + b, parts.values()).alias("score"),
        F.struct(*[v.alias(k) for k, v in parts.items()]).alias("contributions"),
        missing.alias("missing"),
    )
