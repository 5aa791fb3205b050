"""Vector and normalisation functions as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CURVES


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null, of another length or zero."""
    d = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d).otherwise(0.0)


def unit(a: Column) -> Column:
    """Scaled to length 1; zero and NaN lengths leave the vector as it is."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n), F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def mean_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def style_similarity(a: Column, b: Column) -> Column:
    return clip(0.5 * (dot(a, b) / (norm(a) * norm(b) + 1e-9)) + 0.5 * F.greatest(F.lit(0.0), 1.0 - 4.0 * mean_distance(a, b)), 0.0, 1.0)


def percentile(key: str, c: Column, knots: dict[str, list[float]] | None = None) -> Column:
    """Place of a raw value on the metric's curve, between 0.01 and 0.99; 0.5 for null, NaN and unknown metrics.

    A billionth is added before rounding, so that halves go up whatever the last bit of the sum; the rounding is that of binary values as in
    SQL, since Spark's own goes by the shortest decimal notation and differs where the billionth itself makes a half.
    """
    table = CURVES | (knots or {})
    base = key.split("_", 1)[1] if key[:3] in ("en_", "ja_", "zh_") else key
    d = table.get(base)
    if not d:
        return F.lit(0.5)
    y = [0.05 + 0.9 * i / (len(d) - 1) for i in range(len(d))]
    out = F.when(c <= d[0], F.lit(0.05))
    for i in range(len(d) - 1):
        out = out.when(c <= d[i + 1], F.lit(y[i]) + (c - d[i]) * ((y[i + 1] - y[i]) / (d[i + 1] - d[i])))
    return F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.floor((clip(out.otherwise(0.95), 0.01, 0.99) + 1e-9) * 10_000 + 0.5) / 10_000)


def percentile_sql(key: str, c: str) -> str:
    """The same as SQL text."""
    d = CURVES[key]
    y = [0.05 + 0.9 * i / (len(d) - 1) for i in range(len(d))]
    whens = " ".join(f"WHEN {c} <= {d[i + 1]!r} THEN {y[i]!r} + ({c} - {d[i]!r}) * {(y[i + 1] - y[i]) / (d[i + 1] - d[i])!r}" for i in range(len(d) - 1))
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.5 ELSE round(least(greatest(CASE WHEN {c} <= {d[0]!r} THEN 0.05 {whens} ELSE 0.95 END, 0.01), 0.99) + 1e-9, 4) END"


def min_max(c: Column, low: float, high: float) -> Column:
    return clip((c - low) / max(1e-9, high - low), 0.0, 1.0)


def ramp(c: Column, start: float, length: float) -> Column:
    return clip((c - start) / length, 0.0, 1.0)


def sigmoid(c: Column, steep: float = 5.5) -> Column:
    return 1 / (1 + F.exp(-steep * c))


def softmax2(a: Column, b: Column, temperature: float = 8.0) -> Column:
    """Probability of the first of two similarities."""
    return F.exp(a * temperature) / (F.exp(a * temperature) + F.exp(b * temperature))


def match_percent(distance: Column, k: float) -> Column:
    return clip(F.bround(F.round(100 - F.abs(distance) * k, 6)), 0, 100).cast("int")


def _times(w: float):
    return lambda x: x * w


def pool(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted sum of vectors."""
    out = F.transform(vectors[0], _times(weights[0]))
    for v, w in zip(vectors[1:], weights[1:]):
        out = F.zip_with(out, F.transform(v, _times(w)), lambda x, y: x + y)
    return out


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
