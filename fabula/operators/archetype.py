"""Archetypes: the percentiles of a text's metrics against reference vectors of genres, by cosine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, percentile
from ..functions.words import ARCHETYPE_METRICS, ARCHETYPES, WEB_ARCHETYPES


def territory(genre: Column) -> Column:
    """The territory of an archetype."""
    known = F.when(genre.isin(*WEB_ARCHETYPES), "Web Novel Territory").when(genre.isin(*ARCHETYPES), "Classic Literature Territory")
    return F.when(genre.isNotNull(), known.otherwise("Unknown Territory"))


def match_archetype(metrics: dict[str, Column]) -> Column:
    """(territory, closest_trope, confidence, similarities) of a text from its raw metrics, named without a language.

    The metrics must be columns already made (the percentile reads each several times).  A metric that is missing counts as 0; null and NaN values have the percentile 0.5.  Of equally similar archetypes the first in order is the closest.
    """
    place = F.array(*[percentile(k, metrics.get(k, F.lit(0.0)).cast("double")) for k in ARCHETYPE_METRICS])
    rows = [
        F.struct(F.lit(genre).alias("g"), F.array(*[F.lit(w) for w in v]).alias("w"), F.lit(math.sqrt(sum(w * w for w in v))).alias("n"), F.lit(-i).alias("o"))
        for i, (genre, v) in enumerate(ARCHETYPES.items())
    ]
    # ``place`` is bound as a lambda's variable, so that it is made once a row.
    score = lambda p, r: F.struct((dot(p, r["w"]) / (norm(p) * r["n"])).alias("s"), r["o"].alias("o"), r["g"].alias("g"))
    every = F.transform(F.array(place), lambda p: F.transform(F.array(*rows), lambda r: score(p, r)))[0]

    def result(e: Column) -> Column:
        best = F.array_max(e)
        likeness = F.map_from_entries(F.transform(e, lambda x: F.struct(x["g"], x["s"])))
        return F.struct(territory(best["g"]).alias("territory"), best["g"].alias("closest_trope"), best["s"].alias("confidence"), likeness.alias("similarities"))

    return F.transform(F.array(every), result)[0]
