"""Genre evidence in prose: boosts by anchor terms with corrections between genres, and calibrated genre scores of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import cjk
from ..functions.vectors import clip, cosine, sigmoid
from .classify import guardrail

# Terms of the corrections between genres.
DOMESTIC = "marriage married husband wife courtship suitor betrothal engagement wedding".split()
ROMANCE_KEEPERS = ["love story", "rom-com", "otome", "harem", "romantic comedy"]
GHOSTLY = "ghost vampire werewolf spectral exorcist paranormal necromancy".split()
FANTASTIC = ["archmage", "wizard", "sorcerer", "dragon", "magic", "spell", "reincarnat", "transmigrat", "truck-kun", "another world", "system notification", "status window", "level up", "litrpg", "dungeon", "demon lord", "grand duke", "marquess"]
REBORN = ["reincarnat", "transmigrat", "truck-kun", "another world", "summoned", "otome"]
DETECTIVE = ["inspector", "detective", "sherlock", "holmes", "watson", "blackmail", "crime scene", "homicide", "whodunit", "murder victim"]
VERSE = ["canto", "stanza", "sonnet", "epic poem", "ballad", "limerick", "haiku", "prologue", "couplet", "blank verse", "chorus", "rhymed verse"]


def _count(low: Column, terms: list[str], whole: bool = True) -> Column:
    """How many of the terms the text holds; a trailing * (or ``whole`` false) matches the beginnings of words."""
    total = F.lit(0)
    for t in terms:
        if cjk(t):
            hit = low.contains(t.lower())
        else:
            stem = t.rstrip("*")
            hit = low.rlike(f"(?U)\\b{stem}" + ("\\b" if whole and not t.endswith("*") else ""))
        total = total + hit.cast("int")
    return total


def _any(low: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def with_boosts(df: DataFrame, text: str, taxonomy: dict[str, list[str]] | None = None, name: str = "boosts") -> DataFrame:
    """Adds a map genre -> boost of a text; genres without a boost are left out.  Null texts count as empty.

    0.12 per anchor term of a genre, at most 0.35; then, in order: domestic life for romance, horror only with an atmosphere of fear, fantasy
    against history, crime against romance and ghosts, verse.  ``taxonomy`` gives the anchors of each genre.
    """
    anchors = taxonomy or {g: k.split("|") for g, k in W.GENRE_TAGS.items()}
    genres = list(dict.fromkeys([*W.GENRE_PRIORITY, *anchors]))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({f"_n{i}": _count(low, anchors.get(g, [])) for i, g in enumerate(genres)} | {
        "_domestic": _count(low, DOMESTIC), "_fear": _count(low, W.FEARS), "_monster": _count(low, [m for m in W.MONSTERS if not cjk(m)]), "_fantastic": _count(low, FANTASTIC, False), "_crime": _count(low, DETECTIVE, False), "_verse": _count(low, VERSE),
    })
    c = F.col
    b = {g: F.when(c(f"_n{i}") > 0, F.least(F.lit(0.35), 0.12 * c(f"_n{i}"))) for i, g in enumerate(genres)}
    zero = lambda g: F.coalesce(b[g], F.lit(0.0))
    b["Romance"] = F.when(c("_domestic") >= 3, zero("Romance") + 0.20).otherwise(b["Romance"])
    no_fear = (c("_fear") == 0) & (zero("Horror") <= 0)
    gothic = ~no_fear & (c("_fear") >= 2) & (c("_monster") >= 1)
    supernatural = F.when(no_fear & (c("_monster") >= 1), zero("Supernatural") + 0.25).when(gothic, zero("Supernatural") + 0.15).otherwise(b["Supernatural"])
    horror = F.when(no_fear, F.greatest(F.lit(-0.45), zero("Horror") - 0.45)).when(gothic, zero("Horror") + 0.35).otherwise(b["Horror"])
    romance = F.when(gothic & ~_any(low, [*ROMANCE_KEEPERS, "marriage proposal", "courtship"]), F.greatest(F.lit(-0.35), F.least(F.lit(-0.15), zero("Romance") - 0.35))).otherwise(b["Romance"])
    b |= {"Supernatural": supernatural, "Horror": horror, "Romance": romance}
    fantastic = c("_fantastic") >= 2
    b["Historical"] = F.when(fantastic, F.greatest(F.lit(-0.35), zero("Historical") - 0.35)).otherwise(b["Historical"])
    b["Isekai"] = F.when(fantastic & _any(low, REBORN), zero("Isekai") + 0.30).otherwise(b["Isekai"])
    crime = c("_crime") >= 1
    b["Romance"] = F.when(crime & ~_any(low, ROMANCE_KEEPERS), F.greatest(F.lit(-0.45), F.least(F.lit(-0.25), zero("Romance") - 0.45))).otherwise(b["Romance"])
    b["Supernatural"] = F.when(crime & ~_any(low, GHOSTLY), F.greatest(F.lit(-0.45), zero("Supernatural") - 0.45)).otherwise(b["Supernatural"])
    b["Mystery"] = F.when(crime, F.least(F.lit(0.40), zero("Mystery") + 0.25)).otherwise(b["Mystery"])
    b["Action / Adventure"] = F.when(crime, F.least(F.lit(0.35), zero("Action / Adventure") + 0.15)).otherwise(b["Action / Adventure"])
    verse = c("_verse") >= 1
    b["Poetry"] = F.when(verse, zero("Poetry") + 0.35).otherwise(b["Poetry"])
    b["Drama"] = F.when(verse, zero("Drama") + 0.25).otherwise(b["Drama"])
    pairs = F.array(*[F.struct(F.lit(g).alias("key"), b[g].cast("double").alias("value")) for g in genres])
    df = df.withColumn(name, F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
    return df.drop(*[f"_n{i}" for i in range(len(genres))], "_domestic", "_fear", "_monster", "_fantastic", "_crime", "_verse")


def with_genre_scores(df: DataFrame, text: str, vector: str, profiles: list[tuple[str, list[float]]], taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``genre_scores`` (array of struct(genre, score), best first), ``world``, ``plot`` and ``label`` of a text.

    A genre's score is the calibrated sum of the cosine of the text's vector with the genre's profile, less the profiles' common mean, and its
    boost; epics of war lose cultivation and gain history, and where both meet the plot is named after the war.  Ties keep the profiles' order.
    """
    dim = len(profiles[0][1])
    mean = [sum(p[i] for _, p in profiles) / len(profiles) for i in range(dim)]
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    df = with_boosts(df, text, taxonomy, "_boosts").withColumn("_guard", guardrail(F.col(text)))
    rows = []
    for i, (g, p) in enumerate(profiles):
        raw = cosine(F.col(vector).cast("array<double>"), lit([x - m for x, m in zip(p, mean)])) + F.coalesce(F.try_element_at("_boosts", F.lit(g)), F.lit(0.0))
        score = sigmoid(raw)
        if g == "Cultivation":
            score = score + F.col("_guard.cultivation_penalty")
        if g == "Historical":
            score = score + F.col("_guard.historical_boost")
        rows.append(F.struct((-F.round(clip(score, 0.01, 0.99), 4)).alias("minus"), F.lit(i).alias("pos"), F.lit(g).alias("genre")))
    df = df.withColumn("genre_scores", F.transform(F.array_sort(F.array(*rows)), lambda x: F.struct(x["genre"].alias("genre"), (-x["minus"]).alias("score"))))
    world, second = F.get("genre_scores", F.lit(0))["genre"], F.coalesce(F.get("genre_scores", F.lit(1))["genre"], F.get("genre_scores", F.lit(0))["genre"])
    scenario = F.col("_guard.scenario")
    plot = F.when(scenario == "B", "Historical / Military").otherwise(second)
    shown = F.when(scenario == "A", F.concat_ws(" ", world, second, F.lit("(Military Epic)"))).when(scenario == "B", F.concat_ws(" ", world, F.lit("Cultivation (Kingdom Building / Military)"))).otherwise(F.concat(world, F.lit(" ("), second, F.lit(")")))
    return df.withColumns({"world": world, "plot": plot, "label": shown}).drop("_boosts", "_guard")
