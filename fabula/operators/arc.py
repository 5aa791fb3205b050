"""Four-act sentiment arcs and pacing series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import sentiments
from ..functions.text import marks, non_blank, paragraphs, strip, words

ACTS = [("Ki", "Introduction"), ("Shō", "Development"), ("Ten", "Twist"), ("Ketsu", "Resolution")]


def arc_units(c: Column, lang: str) -> Column:
    """Sentences; clauses of more than three characters where there are fewer than four sentences and any such clause."""
    whole = F.transform(non_blank(F.split(c, "[.!?]+" if lang == "en" else "[。！？]+")), strip)
    clauses = F.filter(F.transform(F.split(c, "[,;:.!?\\-\\n]+" if lang == "en" else "[，、；：。！？\\n]+"), strip), lambda x: F.length(x) > 3)
    return F.when((F.size(whole) < 4) & (F.size(clauses) > 0), clauses).otherwise(whole)


def quantile_bounds(n: Column, k: int, parts: int = 4) -> tuple[Column, Column]:
    """[start, end) of the k-th part of n items by truncation, at least one item long while there are any."""
    start, end = F.floor(n * k / parts).cast("int"), F.floor(n * (k + 1) / parts).cast("int")
    return start, F.when(start >= end, F.least(n, start + 1)).otherwise(end)


def with_arc(df: DataFrame, text: str, lang: str, gain: float = 2.0, parts: int = 4, units: Column | None = None) -> DataFrame:
    """Adds ``arc``, struct(acts, quantiles, raw_quantiles) of a text: direction times magnitude times density of each part, curved by tanh.

    ``units`` gives the sentences instead of the text's own.  A text without a sentence has zeros.  The steps are columns of their own, so that no list is worked out twice.
    """
    c = F.col(text)
    df = df.withColumn("_scores", sentiments(arc_units(c, lang) if units is None else units, lang)).withColumn("_n", F.size("_scores"))
    n = F.col("_n")
    bounds = [quantile_bounds(n, k, parts) for k in range(parts)]
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("d"))
    add = lambda a, x: F.struct((a["n"] + 1.0).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["d"] + F.when(F.abs(x) > 0.05, 1.0).otherwise(0.0)).alias("d"))

    def raw(a: Column) -> Column:
        mean = a["s"] / a["n"]
        score = F.when(mean >= 0, 1.0).otherwise(-1.0) * F.sqrt(F.abs(mean) * (F.sqrt(a["q"] / a["n"]) + 1e-6)) * (1.0 + 0.5 * a["d"] / a["n"])
        return F.when(a["n"] > 0, score).otherwise(0.0)

    df = df.withColumns({f"_r{k}": F.aggregate(F.slice("_scores", a + 1, F.greatest(b - a, F.lit(0))), start, add, raw) for k, (a, b) in enumerate(bounds)})
    curved = [F.round(F.tanh(gain * F.col(f"_r{k}")), 4) for k in range(parts)]
    ranges = [F.when(n > 0, F.array(a, F.greatest(a, b - 1))).otherwise(F.array(F.lit(0), F.lit(0))) for a, b in bounds]
    acts = F.array(*[F.struct(F.lit(x).alias("act"), F.lit(y).alias("label"), s.alias("sentiment"), r.alias("sentence_range")) for (x, y), s, r in zip(ACTS, curved, ranges)])
    out = F.struct(acts.alias("acts"), F.array(*curved).alias("quantiles"), F.array(*[F.round(F.col(f"_r{k}"), 4) for k in range(parts)]).alias("raw_quantiles"))
    return df.withColumn("arc", out).drop("_scores", "_n", *[f"_r{k}" for k in range(parts)])


# Trajectories of works whose text is missing.
RISING, FALLING, WAVERING = [-0.25, 0.35, 0.45, 0.20], [0.15, -0.10, -0.45, -0.30], [0.10, 0.28, 0.38, 0.18]


def default_arc(genre: Column) -> Column:
    """Trajectory of a work whose text is missing, by genre: rising from a low, falling, or gently rising and falling."""
    low = F.lower(F.coalesce(genre, F.lit("")))
    make = lambda v: F.array(*[F.lit(x) for x in v])
    return F.when(low.rlike("isekai|progression|action"), make(RISING)).when(low.rlike("tragedy|horror"), make(FALLING)).otherwise(make(WAVERING))


def pacing(c: Column, lang: str, most: int = 100) -> Column:
    """Lengths of the paragraphs; of the clauses where there are fewer than eight paragraphs and at least as many clauses."""
    size = (lambda p: F.size(words(p))) if lang == "en" else (lambda p: F.size(marks(p)))
    bars = F.filter(F.transform(paragraphs(c), size), lambda n: n > 0)
    clauses = F.filter(F.transform(F.split(c, "[,;.!?\\n]+"), size), lambda n: n > 0)
    return F.slice(F.when((F.size(bars) < 8) & (F.size(clauses) >= F.size(bars)), clauses).otherwise(bars), 1, most)


def evenly(a: Column, m: int) -> Column:
    """m evenly spaced items of an array of at least m, by half-even rounding of i (n - 1) / (m - 1); a shorter array stays whole."""
    n = F.size(a)
    return F.when(n <= m, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get(a, F.bround(i * (n - 1) / F.lit(float(m - 1))).cast("int"))))


def intensity(series: Column) -> Column:
    """Values relative to the greatest, at least 0.25."""
    top = F.greatest(F.array_max(series), F.lit(1))
    return F.transform(series, lambda v: F.greatest(v / top, F.lit(0.25)))
