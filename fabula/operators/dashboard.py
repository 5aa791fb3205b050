"""Figures of the dashboard: metric cards by category, radar values, corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import min_max

# The shown metrics, each with its label, its category and how it is written.
METRICS = {
    "word_count": ("Word Count", "structure", "integer"),
    "char_count": ("Character Count", "structure", "integer"),
    "sentence_count": ("Sentence Count", "structure", "integer"),
    "avg_sentence_len": ("Avg Sentence Length", "structure", "number"),
    "avg_sentences_per_paragraph": ("Sentences/Paragraph", "structure", "number"),
    "dep_tree_depth": ("Dep Tree Depth", "structure", "number"),
    "dialogue_ratio": ("Dialogue Ratio", "prose", "percent"),
    "ttr": ("Lexical Density (TTR)", "prose", "number"),
    "adj_ratio": ("Adjective Ratio", "prose", "percent"),
    "verb_ratio": ("Verb Ratio", "prose", "percent"),
    "particle_ratio": ("Particle Ratio", "prose", "percent"),
    "kanji_ratio": ("Kanji Density", "prose", "percent"),
    "compound_sentiment": ("Sentiment Tone", "theme", "number"),
    "theme_explication_ratio": ("Thematic Explicitness", "theme", "number"),
    "sensory_body_density": ("Visceral Emotion", "theme", "percent"),
    "outside_world_engagement": ("World Grounding", "theme", "number"),
    "linearity_subversion_score": ("Temporal Complexity", "pacing", "number"),
    "temporal_shift_score": ("Time Shifts", "pacing", "number"),
    "narrative_feature_diversity": ("Subplot Diversity", "pacing", "number"),
}
# The radar's metrics and their ranges.
RADAR_RANGES = [
    ("theme_explication_ratio", 0.0, 10.0), ("linearity_subversion_score", 0.0, 0.20), ("sensory_body_density", 0.0, 1.0), ("outside_world_engagement", 0.5, 4.0),
    ("narrative_feature_diversity", 0.0, 1.0), ("dialogue_ratio", 0.0, 0.8), ("ttr", 0.3, 0.9), ("compound_sentiment", 0.0, 1.0),
]


def cards(means: DataFrame, key: str) -> DataFrame:
    """(key, category, cards): metrics of each category of which a row of ``means`` has a value in some language."""
    shown = []
    for metric, (_, category, _) in METRICS.items():
        own = [F.col(c).isNotNull() for c in (f"en_{metric}", f"ja_{metric}", f"zh_{metric}", metric) if c in means.columns]
        if own:
            some = own[0]
            for x in own[1:]:
                some = some | x
            shown.append(F.when(some, F.lit(category)))
    return means.select(key, F.explode(F.array_compact(F.array(*shown))).alias("category")).groupBy(key, "category").agg(F.count("*").alias("cards"))


def radar(means: DataFrame, normalised: str | None) -> Column:
    """The eight radar values: from the map ``normalised`` under the row's language, no language, English, Japanese or Chinese; else the raw metric
    of the row's language, English or Japanese, scaled to its range; else 0.  A row's language is Chinese, Japanese or English, whichever it has first."""
    any_of = lambda k: F.coalesce(*[F.col(c).cast("double") for c in means.columns if c.startswith(f"{k}_")], F.lit(None).cast("double")).isNotNull()
    own = F.when(any_of("zh"), "zh").when(any_of("ja"), "ja").otherwise("en")
    out = []
    for metric, low, high in RADAR_RANGES:
        col = lambda k: F.col(f"{k}_{metric}") if f"{k}_{metric}" in means.columns else F.lit(None).cast("double")  # noqa: B023, E731
        raw = F.coalesce(F.when(own == "zh", col("zh")).when(own == "ja", col("ja")).otherwise(col("en")), *([F.col(metric)] if metric in means.columns else []), col("en"), col("ja"))
        keys = [F.concat(own, F.lit(f"_{metric}")), F.lit(metric), *[F.lit(f"{k}_{metric}") for k in ("en", "ja", "zh")]]
        given = [F.try_element_at(F.col(normalised), k) for k in keys] if normalised else []
        out.append(F.coalesce(*given, min_max(raw, low, high), F.lit(0.0)))
    return F.array(*out)


def figures(works: DataFrame) -> DataFrame:
    """Genres in use, works of either territory and their shares in percent with one decimal; ``works`` has one row per work."""
    of = lambda name: F.coalesce(F.sum((F.col("territory") == name).cast("long")), F.lit(0))
    row = works.agg(F.countDistinct("genre").alias("genres"), of("Web Novel Territory").alias("web"), of("Classic Literature Territory").alias("classic"))
    share = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("web") + F.col("classic"), F.lit(1)), 1).alias(f"{c}_percent")
    return row.select("genres", "web", "classic", share("web"), share("classic"))


def distinct_titles(items: Column) -> Column:
    """The different items of an array without regard to case and outer spaces, in title form, in order of their first place; blank ones left out."""
    clean = F.filter(F.transform(items, lambda x: F.initcap(F.lower(F.trim(x)))), lambda x: x != "")
    return F.array_distinct(clean)
