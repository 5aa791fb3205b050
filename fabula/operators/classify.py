"""Genre, guardrail and territory rules as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import cjk, count_markers, distinct_markers
from ..functions.vectors import clip, ramp, softmax2


def _matches(pattern: str):
    return lambda t: F.lower(t).rlike(pattern)


def consolidate(tags: Column) -> Column:
    """The first parent genre, in order of priority, of which any tag holds a key word; null without one.  ``tags`` is an array."""
    out = None
    for genre in W.GENRE_PRIORITY:
        keys = W.GENRE_TAGS[genre].split("|")
        latin, other = [k for k in keys if not cjk(k)], [k for k in keys if cjk(k)]
        pattern = "|".join(([r"(?<![\p{L}\p{N}_])(?:" + "|".join(latin) + r")(?![\p{L}\p{N}_])"] if latin else []) + other)
        hit = F.exists(tags, _matches(pattern))
        out = F.when(hit, genre) if out is None else out.when(hit, genre)
    return out.otherwise(F.lit(None).cast("string"))


def guardrail(text: Column) -> Column:
    """struct(military, cultivation, scenario, cultivation_penalty, historical_boost): A for epics of war without cultivation, B for a mixture."""
    mil, cul = distinct_markers(text, W.MILITARY_EPIC), distinct_markers(text, W.HARD_CULTIVATION)
    a, b = (mil >= 3) & (cul == 0), (mil >= 3) & (cul >= 2)
    return F.struct(mil.alias("military"), cul.alias("cultivation"), F.when(a, "A").when(b, "B").otherwise("NONE").alias("scenario"), F.when(a, -0.40).otherwise(0.0).alias("cultivation_penalty"), F.when(a, 0.20).otherwise(0.0).alias("historical_boost"))


def marker_counts(corpus: Column) -> dict[str, Column]:
    return {k: count_markers(corpus, v) for k, v in (("monster", W.MONSTERS), ("fear", W.FEARS), ("scifi", W.PURE_SCIFI), ("system", W.SYSTEMS), ("cultivation", W.CULTIVATION_CORE), ("isekai", W.OTHER_WORLDS))}


def rank_genres(df, tags: str, text: str, source: str, territory: str, initial: str):
    """Adds ``scores`` (map), ``genres`` (at most three, best first), ``primary_genre``, ``penalties``: tag evidence corrected for tropes that genres share.

    Steps in order: evidence of tags, initial genre, horror of atmosphere, then for web works horror against system tropes, science fiction
    against game interfaces, cultivation, other worlds, everyday life.  Null strings count as empty.  Ties keep the order of the genres.
    """
    s = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    df = df.withColumn("_corpus", F.concat_ws(" ", s(tags), s(text))).withColumn("_tags", F.transform(F.split(s(tags), ","), lambda t: F.trim(t)))
    df = df.withColumns({f"_{k}": v for k, v in marker_counts(F.col("_corpus")).items()})
    df = df.withColumn("_classic", (s(source) == "gutenberg") | s(territory).contains("classic literature") | s(initial).contains("classic literature"))
    first = {}
    for g in W.GENRE_PRIORITY:
        keys = W.GENRE_TAGS[g].split("|")
        latin, other = [k for k in keys if not cjk(k)], [k for k in keys if cjk(k)]
        matched = F.lit(0)
        exact = F.array_contains("_tags", g.lower())
        for k in latin:
            matched = matched + F.size(F.filter("_tags", _matches(rf"(?<![\p{{L}}\p{{N}}_]){k}(?![\p{{L}}\p{{N}}_])")))
            exact = exact | F.array_contains("_tags", k)
        wide = F.lit(0.0)
        for k in other:
            exact = exact | s(tags).contains(k)
            wide = wide + F.when(s(tags).contains(k), 2.0).when(F.col("_corpus").contains(k), 1.0).otherwise(0.0)
        score = F.when(exact, 1.5 + wide).when((matched >= 3) | (wide > 0), matched + wide).otherwise(0.0)
        first[g] = score + F.when(s(initial).contains(g.lower()), 1.5).otherwise(0.0)
    df = df.withColumns({f"_g{i}": first[g] for i, g in enumerate(W.GENRE_PRIORITY)})
    at = {g: f"_g{i}" for i, g in enumerate(W.GENRE_PRIORITY)}
    col = lambda g: F.col(at[g])
    c = F.col
    web = ~c("_classic")
    classic_fear = c("_classic") & ((c("_fear") >= 2) | ((c("_monster") >= 1) & (c("_fear") >= 1)))
    df = df.withColumn(at["Horror"], col("Horror") + F.when(classic_fear | (web & (c("_fear") >= 3) & (c("_fear") > c("_monster"))), 1.5).otherwise(0.0))
    tropes = c("_system") + c("_isekai")
    df = df.withColumn("_a", web & (c("_monster") > 0) & (tropes > 0) & (c("_fear") <= tropes))
    df = df.withColumns({
        at["Horror"]: F.when(c("_a"), F.greatest(F.lit(0.0), col("Horror") - 0.30)).otherwise(col("Horror")),
        at["Fantasy"]: F.when(c("_a") & (col("Fantasy") == 0), 0.5).otherwise(col("Fantasy")),
        at["Isekai"]: col("Isekai") + F.when(c("_a") & (c("_isekai") > 0), 0.5).otherwise(0.0),
        at["Progression Fantasy"]: col("Progression Fantasy") + F.when(c("_a") & (c("_isekai") == 0), 0.5).otherwise(0.0),
    })
    game = c("_corpus").contains("vrmmo")
    df = df.withColumn("_b", web & ((col("Sci-Fi") > 0) | c("_corpus").contains("sci-fi")) & (c("_system") > 0) & (c("_scifi") < c("_system")))
    df = df.withColumns({
        at["Sci-Fi"]: F.when(c("_b"), F.greatest(F.lit(0.0), col("Sci-Fi") - 0.35)).otherwise(col("Sci-Fi")),
        at["Progression Fantasy"]: col("Progression Fantasy") + F.when(c("_b") & game, 0.5).otherwise(0.0),
        at["Fantasy"]: col("Fantasy") + F.when(c("_b") & ~game, 0.5).otherwise(0.0),
    })
    any_of = lambda words: F.expr(" OR ".join(f"contains(lower(coalesce(`{tags}`, '')), '{w}')" for w in words))
    many = c("_cultivation") >= 3
    explicit = any_of(["cultivation", "xianxia", "wuxia", "xuanhuan", "修仙", "仙侠", "修真", "玄幻", "武侠"])
    own = F.when(many, F.greatest(col("Cultivation") + 1.5, col("Fantasy") + 0.5, col("Action / Adventure") + 0.5)).when(explicit | (c("_cultivation") >= 1), col("Cultivation") + 1.0).when(col("Cultivation") < 1.0, 0.0).otherwise(col("Cultivation"))
    df = df.withColumn("_c", F.when(web, own).otherwise(col("Cultivation")))
    with_isekai = web & many & ((c("_isekai") >= 3) | any_of(["isekai", "穿越", "重生"]))
    df = df.withColumn(at["Isekai"], F.when(with_isekai, F.greatest(col("Isekai"), col("Fantasy") + 0.25)).otherwise(col("Isekai")))
    chinese = s(source).isin("cnnovel", "qidian", "faloo", "ciweimao") | c("_corpus").rlike("[\\u4e00-\\u9fff]")
    df = df.withColumn("_non", web & ~chinese & (c("_c") > 0)).withColumn(at["Cultivation"], F.when(c("_non"), F.greatest(F.lit(0.0), c("_c") - 0.01)).otherwise(c("_c")))
    tagged = any_of(["isekai", "reincarnation", "transmigration", "tensei"])
    df = df.withColumn("_i", web & ((c("_isekai") >= 3) | tagged))
    df = df.withColumn(at["Isekai"], F.when(c("_i") & (c("_cultivation") < 3), F.greatest(col("Isekai") + 1.0, col("Action / Adventure") + 0.25)).otherwise(col("Isekai")))
    daily = web & any_of(["slice of life", "slice-of-life", "slow life", "slow-life", "daily life", "everyday life", "cozy", "farming", "cooking", "school life"])
    df = df.withColumn(at["Slice of Life"], col("Slice of Life") + F.when(daily, 1.0).otherwise(0.0))
    pairs = F.array(*[F.struct((-col(g)).alias("minus"), F.lit(i).alias("pos"), F.lit(g).alias("genre")) for i, g in enumerate(W.GENRE_PRIORITY)])
    df = df.withColumn("_order", F.transform(F.filter(F.array_sort(pairs), lambda x: x["minus"] < 0), lambda x: x["genre"]))
    df = df.withColumn("_order", F.when(F.size("_order") == 0, F.array(F.lit("Action / Adventure"), F.lit("Fantasy"))).otherwise(c("_order")))
    has = lambda g: F.array_contains("_order", g)
    rest = F.filter("_order", lambda x: ~x.isin("Cultivation", "Isekai"))
    no_isekai = F.filter("_order", lambda x: x != "Isekai")
    cult_first = F.concat(F.array(F.lit("Cultivation")), F.when(has("Isekai"), F.array(F.lit("Isekai"))).otherwise(F.array().cast("array<string>")), rest)
    isekai_first = F.when(F.get(no_isekai, F.lit(0)).isin("Romance", "Comedy", "Progression Fantasy", "Slice of Life"), F.concat(F.slice(no_isekai, 1, 1), F.array(F.lit("Isekai")), F.slice(no_isekai, 2, 20))).otherwise(F.concat(F.array(F.lit("Isekai")), no_isekai))
    order = F.when(web & many & has("Cultivation"), cult_first).when(web & ~many & c("_i") & has("Isekai"), isekai_first).otherwise(c("_order"))
    penalties = F.array_compact(F.array(F.when(c("_a"), "Horror Penalty"), F.when(c("_b"), "Sci-Fi Penalty"), F.when(c("_non"), "Cultivation Non-Chinese Penalty")))
    scores = F.map_from_arrays(F.array(*[F.lit(g) for g in W.GENRE_PRIORITY]), F.array(*[col(g) for g in W.GENRE_PRIORITY]))
    df = df.withColumn("genres", F.slice(order, 1, 3)).withColumn("scores", scores).withColumn("penalties", penalties)
    return df.withColumn("primary_genre", F.get("genres", F.lit(0))).drop(*[x for x in df.columns if x.startswith("_")])


def style_classic(avg_sentence_len: Column, sentences_per_paragraph: Column, depth: Column, text: Column) -> Column:
    """Likelihood of classic style by three ramps, less 0.12 per web marker in the text (at most 0.45), within 0.05 and 0.95."""
    base = 0.35 * ramp(sentences_per_paragraph, 1.5, 4.5) + 0.35 * ramp(depth, 4.5, 2.2) + 0.30 * ramp(avg_sentence_len, 11.0, 10.0)
    low, hits = F.lower(text), F.lit(0)
    for m in W.WEB_MARKERS:
        hits = hits + low.contains(m).cast("int")
    return clip(base - F.least(F.lit(0.45), hits * 0.12), 0.05, 0.95)


def territory(embedding_classic: Column, embedding_web: Column, style: Column, genre_is_classic: Column) -> Column:
    """struct(territory, confidence): 45 % embedding, 40 % style, 15 % genre."""
    classic = 0.45 * softmax2(embedding_classic, embedding_web) + 0.40 * style + 0.15 * genre_is_classic.cast("double")
    return F.struct(F.when(classic >= 1 - classic, "Classic Literature Territory").otherwise("Web Novel Territory").alias("territory"), F.greatest(classic, 1 - classic).alias("confidence"))


def default_territory(source: Column) -> Column:
    return F.when(F.lower(F.trim(source)) == "gutenberg", "Classic Literature Territory").otherwise("Web Novel Territory")


def benchmark_chip(n: Column) -> Column:
    """High, Low or Balanced with the distance from the middle in percent."""
    return F.when(n >= 0.65, F.concat(F.lit("High +"), F.bround((n - 0.5) * 100).cast("int").cast("string"))).when(n <= 0.35, F.lit("Low")).otherwise(F.lit("Balanced"))


def affinity(scores: Column, least: float = 0.65) -> Column:
    """Scores (array of struct with field score, best first) of at least 0.65; the first four where fewer than two qualify."""
    good = F.filter(scores, lambda x: x["score"] >= least)
    return F.when(F.size(good) >= 2, good).otherwise(F.slice(scores, 1, 4))
