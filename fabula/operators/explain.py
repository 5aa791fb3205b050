"""Explanations of matches: comparisons of metrics, badges, pillars; and what a work's story is about by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import match_percent, percentile

#: The eight style values of a vector, in order, each with its metric.
RADAR = ["theme_explication_ratio", "linearity_subversion_score", "sensory_body_density", "outside_world_engagement", "narrative_feature_diversity", "dialogue_ratio", "ttr", "temporal_shift_score"]
#: The compared metrics: name, factor of the match, value from the style vector (position, offset, factor), value without any.
COMPARED = {
    "dialogue_ratio": (200, (5, 0.0, 1.0), 0.50), "avg_sentence_len": (10, (1, 6.0, 18.0), 12.0), "ttr": (300, (6, 0.0, 1.0), 0.50),
    "sensory_body_density": (200, (2, 0.0, 1.0), 0.40), "theme_explication_ratio": (20, (0, 0.0, 5.0), 2.0),
}
LABELS = {"dialogue_ratio": "Dialogue Density", "avg_sentence_len": "Sentence Cadence", "ttr": "Lexical Richness (TTR)", "sensory_body_density": "Visceral Somatic Imagery", "theme_explication_ratio": "Thematic Explicitness"}


def agnostic(df: DataFrame, metric: str) -> Column:
    """The metric of a row's language, which is the first of English, Japanese and Chinese of which the row has any metric; a metric without a
    language comes first; null without any."""
    out = None
    for k in ("en", "ja", "zh"):
        own = [c for c in df.columns if c.startswith(f"{k}_")]
        if own:
            there, value = F.coalesce(*[F.col(c).cast("double") for c in own]).isNotNull(), F.col(f"{k}_{metric}").cast("double") if f"{k}_{metric}" in own else F.lit(None).cast("double")
            out = F.when(there, value) if out is None else out.when(there, value)
    plain = [F.col(metric).cast("double")] if metric in df.columns else []
    return F.coalesce(*plain, *([out] if out is not None else [])) if plain or out is not None else F.lit(None).cast("double")


def radar(df: DataFrame, normalised: str | None = None) -> Column:
    """The eight style values: from a map of normalised values if it has them, else the percentile of the raw metric, else 0.5."""
    out = []
    for m in RADAR:
        raw = F.when(agnostic(df, m).isNotNull(), percentile(m, agnostic(df, m)))
        given = [F.try_element_at(F.col(normalised), F.lit(k)) for k in (f"en_{m}", f"ja_{m}", f"zh_{m}", m)] if normalised else []
        out.append(F.coalesce(*given, raw, F.lit(0.5)))
    return F.array(*out)


def metric_value(metric: str, raw: Column | None, vector: Column) -> Column:
    """A raw metric, else its value by the style vector, else a constant."""
    _, (at, base, scale), constant = COMPARED[metric]
    by_vector = F.lit(base) + F.get(vector, F.lit(at)) * scale
    return F.coalesce(*([raw] if raw is not None else []), by_vector, F.lit(constant))


def _text(metric: str, v: Column) -> Column:
    if metric in ("dialogue_ratio", "sensory_body_density"):
        return F.format_string("%.1f%%", v * 100)
    return F.format_string("%.1f w/s", v) if metric == "avg_sentence_len" else F.format_string("%.2f", v)


def comparisons(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Array of struct(metric, query, candidate, match) of the five compared metrics."""
    return F.array(*[F.struct(F.lit(LABELS[m]).alias("metric"), _text(m, a[m]).alias("query"), _text(m, b[m]).alias("candidate"), F.concat(match_percent(a[m] - b[m], k).cast("string"), F.lit("%")).alias("match")) for m, (k, _, _) in COMPARED.items()])


def badges(genre: Column, shared_trope: Column, a: dict[str, Column], b: dict[str, Column], score: Column) -> Column:
    """Short marks of what two works share, at least one: genre, trope, dialogue within 0.15, cadence within 4, then vocabulary and imagery while fewer than four."""
    near = lambda m, d: F.abs(a[m] - b[m]) <= d
    make = lambda label, detail: F.struct(F.lit(label).alias("label"), detail.alias("detail"))
    pct = lambda c: F.bround(c * 100).cast("int").cast("string")
    first = F.array_compact(F.array(
        F.when(genre.isNotNull(), make("Genre", genre)), F.when(shared_trope.isNotNull(), make("Trope", shared_trope)),
        F.when(near("dialogue_ratio", 0.15), make("Dialogue", F.concat(pct(a["dialogue_ratio"]), F.lit("% ≈ "), pct(b["dialogue_ratio"]), F.lit("%")))),
        F.when(near("avg_sentence_len", 4.0), make("Cadence", F.format_string("%.1f ≈ %.1f w/s", a["avg_sentence_len"], b["avg_sentence_len"]))),
    ))
    more = F.when((F.size(first) < 4) & near("ttr", 0.08), F.array_append(first, make("Vocab", F.format_string("TTR %.2f ≈ %.2f", a["ttr"], b["ttr"])))).otherwise(first)
    imagery = (b["sensory_body_density"] >= 0.40) | near("sensory_body_density", 0.15)
    more = F.when((F.size(more) < 4) & imagery, F.array_append(more, make("Imagery", F.concat(F.lit("Visceral "), pct(b["sensory_body_density"]), F.lit("%"))))).otherwise(more)
    return F.when(F.size(more) > 0, more).otherwise(F.array(make("Affinity", F.concat(pct(score), F.lit("% prose affinity")))))


#: Ordered rules of a story's parts: the first pattern that a text holds names the part.
STORY = {
    "catalyst": [("Reincarnation", "reincarnat|reborn|another life|転生|重生|转生"), ("Summoning", "summon|another world|異世界|穿越"), ("Inheritance", "inherit|heir|legacy|will and testament"), ("Murder", "murder|corpse|killed|homicide"), ("Betrayal", "betray|revenge|vengeance|復讐"), ("Arrival", "arriv|newcomer|stranger")],
    "setting": [("Palace", "palace|court|emperor|empress|宮殿|宫"), ("Academy", "academy|school|student|学園|学院"), ("Sect", "\\bsect\\b|宗門|宗门"), ("Dungeon", "dungeon|labyrinth|迷宮|迷宫"), ("Sea", "\\bsea\\b|ship|sailor|harbour"), ("City", "city|street|market|街")],
    "conflict": [("War", "war\\b|army|soldier|battle|戦|战"), ("Mystery", "mystery|secret|clue|detective|謎|谜"), ("Romance", "love|marri|wedding|恋|婚"), ("Survival", "surviv|hunger|escape|逃"), ("Power", "power|level up|strength|修炼")],
}


def story_part(text: Column, part: str) -> Column:
    """The first rule that fits; null without one."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, pattern in STORY[part]:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def shared_tropes(a: Column, b: Column, most: int = 3) -> Column:
    """Sorted common tropes; the first of the candidate's where there is none in common."""
    both = F.sort_array(F.array_intersect(a, b))
    return F.slice(F.when(F.size(both) > 0, both).otherwise(F.sort_array(b)), 1, most)


def pillars(factors: dict[str, Column], query: dict[str, Column], candidate: dict[str, Column]) -> Column:
    """Array of struct(name, score, query_val, cand_val, explanation): catalyst, setting, conflict and style cadence, each between 0.05 and 0.98."""
    rows = []
    for part, weight in (("catalyst", 0.9), ("setting", 0.85), ("conflict", 0.8)):
        same = F.coalesce(query[part] == candidate[part], F.lit(False))
        score = F.round(F.least(F.greatest(factors["semantic"] * weight + F.when(same, 0.2).otherwise(0.0), F.lit(0.05)), F.lit(0.98)), 2)
        words = F.when(same, F.concat(F.lit("Both works turn on "), F.lower(query[part]))).otherwise(F.lit("The works differ here"))
        rows.append(F.struct(F.lit(part).alias("name"), score.alias("score"), F.coalesce(query[part], F.lit("Unknown")).alias("query_val"), F.coalesce(candidate[part], F.lit("Unknown")).alias("cand_val"), words.alias("explanation")))
    cadence = [F.format_string("%.1f w/s", x["avg_sentence_len"]) for x in (query, candidate)]
    score = F.round(F.least(F.greatest(factors["style"], F.lit(0.05)), F.lit(0.98)), 2)
    rows.append(F.struct(F.lit("style_cadence").alias("name"), score.alias("score"), cadence[0].alias("query_val"), cadence[1].alias("cand_val"), F.concat(F.lit("Sentences run "), cadence[0], F.lit(" against "), cadence[1]).alias("explanation")))
    return F.array(*rows)


def title_overlap(title: Column, query: Column) -> Column:
    """0.15 per distinct word of four letters or more of the title that the query holds, at most 0.30."""
    common = ["with", "from", "that", "this", "into", "over", "about", "world"]
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("\\b[a-z]{4,}\\b"), F.lit(0))), lambda w: ~w.isin(common))
    return F.least(F.lit(0.30), 0.15 * F.size(F.filter(tokens, lambda w: F.lower(query).contains(w))))
