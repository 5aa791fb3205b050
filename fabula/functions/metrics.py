"""Style metrics of a text: each takes a text column and a language and gives one double column.

English counts words; Japanese and Chinese count characters that aren't white space.  Empty texts give the
neutral values named in the functions; null texts give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .text import count_part, count_word, language, marks, non_blank, paragraphs, sentences, words

PUNCTUATION = {"en": W.EN_PUNCTUATION, "ja": W.JA_PUNCTUATION, "zh": W.ZH_PUNCTUATION}
QUOTED = "[\"“「『]([^\"”」』]+)[\"”」』]|'([^']+)'"
_PARAGRAPH_END = {"en": "[.!?]+", "ja": "[。！？]+", "zh": "[。！？]+"}


def units(c: Column, lang: str) -> Column:
    """Words, or characters of scripts without spaces."""
    return words(c) if lang == "en" else marks(c)


def unit_count(c: Column, lang: str) -> Column:
    return F.size(units(c, lang))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def average_sentence(c: Column, lang: str) -> Column:
    return ratio(unit_count(c, lang), F.size(sentences(c, lang)))


def punctuation_density(c: Column, lang: str) -> Column:
    return ratio(F.regexp_count(c, F.lit(PUNCTUATION[lang])), F.length(c))


def sentences_per_paragraph(c: Column, lang: str) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"))
    add = lambda a, p: F.struct((a["n"] + 1).alias("n"), (a["s"] + F.size(non_blank(F.split(p, _PARAGRAPH_END[lang])))).alias("s"))
    return F.aggregate(paragraphs(c), start, add, lambda a: F.when(a["n"] > 0, a["s"].cast("double") / a["n"]).otherwise(0.0))


def type_token_ratio(tokens: Column, window: int = 500, step: int = 100) -> Column:
    """Mean share of distinct tokens over full windows; of a text of at most one window the plain share; 0 if empty."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - window, F.lit(step))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tokens, i + 1, window))) / F.lit(float(window)))
    mean = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.size(shares)
    return F.when(n == 0, 0.0).when(n <= window, F.size(F.array_distinct(tokens)) / n).otherwise(mean)


def quoted(c: Column) -> Column:
    """The text inside quotation marks; apostrophes may open a span."""
    pick = lambda g: F.filter(F.regexp_extract_all(c, F.lit(QUOTED), F.lit(g)), lambda x: x != "")
    return F.concat_ws(" ", F.concat(pick(1), pick(2)))


def dialogue_ratio(c: Column, lang: str) -> Column:
    return unit_count(quoted(c), lang) / F.greatest(F.lit(1), unit_count(c, lang))


def theme_explicitness(c: Column, lang: str) -> Column:
    """Didactic, epiphanic and thematic terms per thousand units, weighted 2, 1 and 0.15."""
    low = F.lower(c)
    lists = {"en": (W.EN_DIDACTIC, W.EN_EPIPHANIC, W.EN_THEMES), "ja": (W.JA_DIDACTIC, W.JA_EPIPHANIC, W.JA_THEMES), "zh": (W.ZH_DIDACTIC, W.ZH_EPIPHANIC, W.ZH_THEMES)}[lang]
    a, b, t = (count_word(low, x) if lang == "en" else count_part(c, x) for x in lists)
    return F.round((a * 2.0 + b + t * 0.15) / (F.greatest(F.lit(1), unit_count(c, lang)) / 1000.0), 2)


def temporal_complexity(c: Column, lang: str) -> Column:
    """2.5 times the variance of the share of past forms over paragraphs, plus markers of time per sentence."""
    if lang == "en":
        markers = F.regexp_count(F.lower(c), F.lit("\\b(?:" + "|".join(W.EN_TIME_MARKERS) + ")\\b"))
        tokens = F.transform(paragraphs(c), words)
        counts = F.transform(tokens, lambda t: F.struct(_matching(t, f"^(?:{W.EN_PAST})$").alias("a"), _matching(t, f"^(?:{W.EN_PRESENT})$").alias("b")))
        shares = F.transform(counts, lambda x: x["a"] / F.greatest(F.lit(1), x["a"] + x["b"]))
    else:
        markers = count_part(c, W.JA_TIME_MARKERS if lang == "ja" else W.ZH_TIME_MARKERS)
        shares = F.transform(paragraphs(c), lambda p: F.regexp_count(p, F.lit(W.CJK_PAST)) / F.greatest(F.lit(1), F.length(p)))
    # One pass: count, sum and sum of squares.
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    variance = F.aggregate(
        shares, start,
        lambda a, x: F.struct((a["n"] + 1.0).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.when(a["n"] > 1, F.greatest(a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]), F.lit(0.0))).otherwise(0.0),
    )
    return variance * 2.5 + markers / F.greatest(F.lit(1), F.size(sentences(c, lang)))


def body_share(c: Column, lang: str) -> Column:
    """Body sensations among all emotional expressions; 0.35 if there are none."""
    if lang == "en":
        low = F.lower(c)
        body, direct = count_word(low, W.EN_BODY_PHRASES) + count_word(low, W.EN_BODY_WORDS), count_word(low, W.EN_DIRECT_EMOTIONS)
    else:
        body = count_part(c, W.JA_BODY_WORDS if lang == "ja" else W.ZH_BODY_WORDS)
        direct = count_part(c, W.JA_DIRECT_EMOTIONS if lang == "ja" else W.ZH_DIRECT_EMOTIONS)
    return F.when(body + direct == 0, 0.35).otherwise(body.cast("double") / (body + direct))


def _matching(tokens: Column, pattern: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(pattern)))


def world_engagement(c: Column, lang: str) -> Column:
    """(adjectives + nouns) / verbs by word endings; by fixed shares of the characters where there are no spaces."""
    if lang == "en":
        tokens = words(c)
        n, adjectives, verbs = F.size(tokens), _matching(tokens, W.EN_WORLD_ADJECTIVE), _matching(tokens, W.EN_WORLD_VERB)
        nouns = F.greatest(F.lit(1), n - adjectives - verbs)
    else:
        n = unit_count(c, lang)
        nouns, adjectives, verbs = F.floor(n * 0.45), F.floor(n * 0.15), F.greatest(F.lit(1), F.floor(n * 0.25))
    return F.when(F.length(c) == 0, 1.0).otherwise((adjectives + nouns).cast("double") / F.greatest(F.lit(1), verbs))


def depth(c: Column) -> Column:
    """Mean sentence depth by clause markers and length; 2.5 without a sentence.  (English; other languages have 0.)"""
    parts = F.transform(sentences(c, "en"), words)
    per = F.transform(parts, lambda t: 2.0 + _matching(t, f"^(?:{W.EN_CLAUSE})$") * 0.75 + F.sqrt(F.size(t).cast("double")) * 0.35)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    add = lambda a, x: F.struct((a["n"] + 1.0).alias("n"), (a["s"] + x).alias("s"))
    return F.aggregate(per, start, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(2.5))


def adjective_ratio(c: Column) -> Column:
    return ratio(_matching(words(c), W.EN_ADJECTIVE), unit_count(c, "en"))


def verb_ratio(c: Column) -> Column:
    return ratio(_matching(words(c), W.EN_VERB), unit_count(c, "en"))


def kanji_ratio(c: Column) -> Column:
    return ratio(F.regexp_count(c, F.lit("[\\u4e00-\\u9fff]")), unit_count(c, "ja"))


def sentiments(parts: Column, lang: str) -> Column:
    """Sentiment of each sentence of an array, between -1 and 1 by word lists; the counts are made once and then combined."""

    def count(s: Column) -> Column:
        if lang == "en":
            up, down = count_word(F.lower(s), W.EN_POSITIVE), count_word(F.lower(s), W.EN_NEGATIVE)
        elif lang == "ja":
            up, down = count_part(s, W.JA_POSITIVE), count_part(s, W.JA_NEGATIVE)
        else:
            up, down = count_part(s, W.ZH_POSITIVE), count_part(s, W.ZH_NEGATIVE)
        return F.struct(up.alias("u"), down.alias("d"))

    total = (lambda x: x["u"] + x["d"] + 1) if lang == "en" else (lambda x: F.greatest(F.lit(1), x["u"] + x["d"]))
    return F.transform(F.transform(parts, count), lambda x: (x["u"] - x["d"]).cast("double") / total(x))


def sentiment_intensity(c: Column, lang: str) -> Column:
    """Mean absolute sentiment of the sentences; 0 without one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    add = lambda a, x: F.struct((a["n"] + 1.0).alias("n"), (a["s"] + F.abs(x)).alias("s"))
    return F.aggregate(sentiments(sentences(c, lang), lang), start, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0))


def location_shifts(c: Column) -> Column:
    """Places named in the second to fourth quarter of a text that no quarter before names."""
    w = F.floor(F.length(c) / 4).cast("int")
    quarter = lambda k: F.substring(c, w * k + 1, w if k < 3 else F.length(c))
    places = [F.array_distinct(F.regexp_extract_all(quarter(k), F.lit(f"\\b(?:[A-Z][a-z]+\\s+)?(?:{W.PLACE})\\b"), F.lit(0))) for k in range(4)]
    places = [F.array_distinct(F.transform(p, lambda x: F.lower(x))) for p in places]
    seen, total = places[0], F.lit(0)
    for p in places[1:]:
        total = total + F.size(F.array_except(p, seen))
        seen = F.array_union(seen, p)
    return total


def narrative_diversity(c: Column, distance: Column | None = None) -> Column:
    """Mean distance of adjacent quarters (from an embedder; 0.35 without one) plus 0.05 per new place; 0 below 100 characters."""
    score = F.round(F.least(F.greatest((distance if distance is not None else F.lit(0.35)) + 0.05 * location_shifts(c), F.lit(0.0)), F.lit(1.0)), 4)
    return F.when(F.length(c) < 100, 0.0).otherwise(score)


def features(c: Column, lang: str) -> dict[str, Column]:
    """All metrics of one language under their usual names."""
    count = "word_count" if lang == "en" else "char_count"
    time = temporal_complexity(c, lang)
    out = {
        count: unit_count(c, lang), "sentence_count": F.size(sentences(c, lang)), "avg_sentence_len": average_sentence(c, lang), "punc_density": punctuation_density(c, lang),
        "avg_sentences_per_paragraph": sentences_per_paragraph(c, lang), "ttr": type_token_ratio(units(c, lang)), "dialogue_ratio": dialogue_ratio(c, lang),
        "compound_sentiment": sentiment_intensity(c, lang), "theme_explication_ratio": theme_explicitness(c, lang), "linearity_subversion_score": time, "temporal_shift_score": time,
        "sensory_body_density": body_share(c, lang), "outside_world_engagement": world_engagement(c, lang), "narrative_feature_diversity": narrative_diversity(c),
    }
    if lang == "en":
        out |= {"dep_tree_depth": depth(c), "adj_ratio": adjective_ratio(c), "verb_ratio": verb_ratio(c), "pron_ratio": F.lit(0.0), "entity_density": F.lit(0.0)}
    else:
        out |= {"dep_tree_depth": F.lit(0.0), "particle_ratio": F.lit(0.0), "verb_ratio": F.lit(0.0)} | ({"kanji_ratio": kanji_ratio(c)} if lang == "ja" else {})
    return {k: v.cast("double") for k, v in out.items()}


def with_features(df: DataFrame, text: str, lang: str | None = None) -> DataFrame:
    """Adds the metrics with a language prefix; ``lang`` fixes the language, else it is detected and the other languages' columns are null.

    Each language is a branch of its own, so that a task's code holds the metrics of one language only.
    """
    c = F.col(text)
    own = F.lit(lang) if lang else language(c)
    codes = [lang] if lang else ["en", "ja", "zh"]
    parts = []
    for code in codes:
        new = {f"{code}_{k}": F.when(c != "", v) for k, v in features(c, code).items()}
        parts.append((df if lang else df.where(own == code)).withColumns(new))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
