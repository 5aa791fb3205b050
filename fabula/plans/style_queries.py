"""Queries of the style metrics, arcs and pacing, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import words as W
from ..functions.text import chapter_number, clean_english, clean_html, clean_japanese, count_word, distinct_markers, generic_title, language, marks, paragraphs, sample_words, sentences, words
from ..operators import arc as A

WS = "\\s\\x{3000}\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
LANGS = {"en": "text_en", "ja": "text_ja", "zh": "text_zh"}


def texts(spark: SparkSession, d: str, lang: str) -> DataFrame:
    """(id, t): the chapters that have a text in the language; repeated deliveries are left to the distinct of each result."""
    c = LANGS[lang]
    return spark.read.parquet(f"{d}/chapter.parquet").where(F.col(c) != "").select("id", F.col(c).alias("t"))


def per_text(lang: str, columns: Callable[[Column, str], dict[str, Column]]):
    """Query of metrics per chapter of one language."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d, lang).select("id", *[v.alias(k) for k, v in columns(F.col("t"), lang).items()]).distinct()

    return run


def r9(c: Column) -> Column:
    return F.round(c, 9)


# --- SQL texts of the same pieces -------------------------------------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"


def s_marks(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({t}, '[{WS}]', '', 'g'), ''), lambda x: x <> '')"


def s_units(t: str, lang: str) -> str:
    return f"len({s_words(t)})" if lang == "en" else f"length(regexp_replace({t}, '[{WS}]', '', 'g'))"


def s_non_blank(parts: str) -> str:
    return f"list_filter({parts}, lambda x: regexp_matches(x, '[^{WS}]'))"


def s_split(t: str, pattern: str) -> str:
    return f"regexp_split_to_array({t}, {q(pattern)})"


def s_sentences(t: str, lang: str) -> str:
    return s_non_blank(s_split(t, {"en": "[.!?]+", "ja": "[。！？]+", "zh": "[。！？\\n]+"}[lang]))


def s_paragraphs(t: str) -> str:
    both = f"CASE WHEN regexp_matches({t}, '[a-zA-Z0-9,]\\r?\\n[a-z]') THEN {s_split(t, '(?:\\r?\\n\\s*){2,}')} ELSE {s_split(t, '[\\r\\n]+')} END"
    return f"list_transform({s_non_blank(both)}, lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g'))"


def s_count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def s_count_words(t: str, terms: list[str]) -> str:
    single = [x for x in terms if " " not in x and "-" not in x]
    parts = [s_count(t, "\\b(?:" + "|".join(single) + ")\\b")] if single else []
    return "(" + " + ".join(parts + [s_count(t, f"\\b{x}\\b") for x in terms if x not in single]) + ")"


def s_count_parts(t: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST((length({t}) - length(replace({t}, {q(x)}, ''))) / {len(x)} AS INT)" for x in terms) + ")"


def s_mean(values: str) -> str:
    return f"coalesce(list_sum({values}) / len({values}), 0)"


def s_texts(lang: str) -> str:
    return f"t0 AS (SELECT DISTINCT id, {LANGS[lang]} AS t FROM chapter WHERE {LANGS[lang]} <> '')"


def s_sentiment(s: str, lang: str) -> str:
    if lang == "en":
        up, down = s_count_words(f"lower({s})", W.EN_POSITIVE), s_count_words(f"lower({s})", W.EN_NEGATIVE)
        return f"(CAST({up} - {down} AS DOUBLE) / ({up} + {down} + 1))"
    up, down = (s_count_parts(s, W.JA_POSITIVE), s_count_parts(s, W.JA_NEGATIVE)) if lang == "ja" else (s_count_parts(s, W.ZH_POSITIVE), s_count_parts(s, W.ZH_NEGATIVE))
    return f"(CAST({up} - {down} AS DOUBLE) / greatest(1, {up} + {down}))"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _lang in LANGS:
    # Sizes, sentence length, punctuation, paragraphs.
    _par = {"en": "[.!?]+", "ja": "[。！？]+", "zh": "[。！？]+"}[_lang]
    QUERIES[f"f_basic_{_lang}"] = per_text(_lang, lambda t, k: dict(units=M.unit_count(t, k), sentence_count=F.size(sentences(t, k)), avg_sentence_len=r9(M.average_sentence(t, k)),
        punc_density=r9(M.punctuation_density(t, k)), avg_sentences_per_paragraph=r9(M.sentences_per_paragraph(t, k))))
    ORACLES[f"f_basic_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, t, {s_units('t', _lang)} AS u, len({s_sentences('t', _lang)}) AS s, {s_paragraphs('t')} AS p FROM t0)
        SELECT id, u AS units, s AS sentence_count, round(CASE WHEN s > 0 THEN u / s ELSE 0 END, 9) AS avg_sentence_len,
        round({s_count('t', M.PUNCTUATION[_lang])} / length(t), 9) AS punc_density,
        round({s_mean(f"list_transform(p, lambda x: len({s_non_blank(s_split('x', _par))}))")}, 9) AS avg_sentences_per_paragraph FROM t1"""
    # sliding type-token ratio.
    QUERIES[f"f_ttr_{_lang}"] = per_text(_lang, lambda t, k: dict(ttr=r9(M.type_token_ratio(M.units(t, k)))))
    _tokens = s_words("t") if _lang == "en" else s_marks("t")
    ORACLES[f"f_ttr_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, {_tokens} AS w FROM t0)
        SELECT id, round(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN len(list_distinct(w)) / len(w)
        ELSE list_avg(list_transform(range(0, len(w) - 499, 100), lambda i: len(list_distinct(w[i + 1:i + 500])) / 500.0)) END, 9) AS ttr FROM t1"""
    # dialogue.
    QUERIES[f"f_dialogue_{_lang}"] = per_text(_lang, lambda t, k: dict(dialogue_ratio=r9(M.dialogue_ratio(t, k))))
    _quoted = " || ' ' || ".join(f"array_to_string(list_filter(regexp_extract_all(t, {q(M.QUOTED)}, {g}), lambda x: x <> ''), ' ')" for g in (1, 2))
    ORACLES[f"f_dialogue_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, t, {_quoted} AS quo FROM t0)
        SELECT id, round({s_units('quo', _lang)} / greatest(1, {s_units('t', _lang)}), 9) AS dialogue_ratio FROM t1"""
    # sentiment.
    QUERIES[f"f_sentiment_{_lang}"] = per_text(_lang, lambda t, k: dict(compound_sentiment=r9(M.sentiment_intensity(t, k))))
    ORACLES[f"f_sentiment_{_lang}"] = f"""WITH {s_texts(_lang)}, s AS (SELECT id, unnest({s_sentences('t', _lang)}) AS x FROM t0), v AS (SELECT id, avg(abs({s_sentiment('x', _lang)})) AS m FROM s GROUP BY id)
        SELECT id, round(coalesce(m, 0), 9) AS compound_sentiment FROM t0 LEFT JOIN v USING (id)"""
    # Themes and body.
    QUERIES[f"f_theme_{_lang}"] = per_text(_lang, lambda t, k: dict(theme_explication_ratio=M.theme_explicitness(t, k), sensory_body_density=r9(M.body_share(t, k))))
    if _lang == "en":
        _a, _b, _c = (s_count_words("lower(t)", x) for x in (W.EN_DIDACTIC, W.EN_EPIPHANIC, W.EN_THEMES))
        _body, _direct = f"({s_count_words('lower(t)', W.EN_BODY_PHRASES)} + {s_count_words('lower(t)', W.EN_BODY_WORDS)})", s_count_words("lower(t)", W.EN_DIRECT_EMOTIONS)
    else:
        _x = {"ja": (W.JA_DIDACTIC, W.JA_EPIPHANIC, W.JA_THEMES, W.JA_BODY_WORDS, W.JA_DIRECT_EMOTIONS), "zh": (W.ZH_DIDACTIC, W.ZH_EPIPHANIC, W.ZH_THEMES, W.ZH_BODY_WORDS, W.ZH_DIRECT_EMOTIONS)}[_lang]
        _a, _b, _c, _body, _direct = (s_count_parts("t", x) for x in _x)
    ORACLES[f"f_theme_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, {_a} AS a, {_b} AS b, {_c} AS c, {_body} AS body, {_direct} AS direct, {s_units('t', _lang)} AS u FROM t0)
        SELECT id, round(CAST((a * 2.0 + b + c * 0.15) AS DOUBLE) / (greatest(1, u) / 1000.0), 2) AS theme_explication_ratio,
        round(CASE WHEN body + direct = 0 THEN 0.35 ELSE CAST(body AS DOUBLE) / (body + direct) END, 9) AS sensory_body_density FROM t1"""
    # time.
    QUERIES[f"f_time_{_lang}"] = per_text(_lang, lambda t, k: dict(temporal_shift_score=r9(M.temporal_complexity(t, k))))
    if _lang == "en":
        _mark = s_count("lower(t)", "\\b(?:" + "|".join(W.EN_TIME_MARKERS) + ")\\b")
        _past, _pres = (f"len(list_filter({s_words('x')}, lambda y: regexp_matches(y, {q(f'^(?:{p})$')})))" for p in (W.EN_PAST, W.EN_PRESENT))
        _share = f"CAST({_past} AS DOUBLE) / greatest(1, {_past} + {_pres})"
    else:
        _mark = s_count_parts("t", W.JA_TIME_MARKERS if _lang == "ja" else W.ZH_TIME_MARKERS)
        _share = f"CAST({s_count('x', W.CJK_PAST)} AS DOUBLE) / greatest(1, length(x))"
    ORACLES[f"f_time_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, {_mark} AS m, len({s_sentences('t', _lang)}) AS s, {s_paragraphs('t')} AS p FROM t0),
        t2 AS (SELECT id, unnest(p) AS x FROM t1), t3 AS (SELECT id, var_pop({_share}) AS v FROM t2 GROUP BY id)
        SELECT id, round(coalesce(v, 0) * 2.5 + m / greatest(1, s), 9) AS temporal_shift_score FROM t1 LEFT JOIN t3 USING (id)"""
    # world.
    QUERIES[f"f_world_{_lang}"] = per_text(_lang, lambda t, k: dict(outside_world_engagement=r9(M.world_engagement(t, k))))
    if _lang == "en":
        _adj, _vrb = (f"len(list_filter(w, lambda x: regexp_matches(x, {q(p)})))" for p in (W.EN_WORLD_ADJECTIVE, W.EN_WORLD_VERB))
        ORACLES["f_world_en"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, {s_words('t')} AS w FROM t0), t2 AS (SELECT id, len(w) AS n, {_adj} AS a, {_vrb} AS v FROM t1)
            SELECT id, round(CAST(a + greatest(1, n - a - v) AS DOUBLE) / greatest(1, v), 9) AS outside_world_engagement FROM t2"""
    else:
        ORACLES[f"f_world_{_lang}"] = f"""WITH {s_texts(_lang)}, t1 AS (SELECT id, CAST({s_units('t', _lang)} AS DOUBLE) AS n FROM t0)
            SELECT id, round((floor(n * 0.45) + floor(n * 0.15)) / greatest(1, floor(n * 0.25)), 9) AS outside_world_engagement FROM t1"""

# Depth, adjectives, verbs (English); F17: Han characters (Japanese).
QUERIES["f_syntax_en"] = per_text("en", lambda t, k: dict(dep_tree_depth=r9(M.depth(t)), adj_ratio=r9(M.adjective_ratio(t)), verb_ratio=r9(M.verb_ratio(t))))
_share = "CASE WHEN len(w) > 0 THEN CAST(len(list_filter(w, lambda x: regexp_matches(x, {p}))) AS DOUBLE) / len(w) ELSE 0 END"
ORACLES["f_syntax_en"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, t, {s_words('t')} AS w FROM t0), s AS (SELECT id, unnest({s_sentences('t', 'en')}) AS x FROM t0),
    d AS (SELECT id, avg(2.0 + 0.75 * len(list_filter({s_words('x')}, lambda y: regexp_matches(y, '^(?:{W.EN_CLAUSE})$'))) + 0.35 * sqrt(len({s_words('x')}))) AS m FROM s GROUP BY id)
    SELECT id, round(coalesce(m, 2.5), 9) AS dep_tree_depth, round({_share.format(p=q(W.EN_ADJECTIVE))}, 9) AS adj_ratio, round({_share.format(p=q(W.EN_VERB))}, 9) AS verb_ratio FROM t1 LEFT JOIN d USING (id)"""
QUERIES["f_kanji_ja"] = per_text("ja", lambda t, k: dict(kanji_ratio=r9(M.kanji_ratio(t))))
ORACLES["f_kanji_ja"] = f"""WITH {s_texts('ja')} SELECT id, round(CASE WHEN {s_units('t', 'ja')} > 0 THEN {s_count('t', '[一-鿿]')} / {s_units('t', 'ja')} ELSE 0 END, 9) AS kanji_ratio FROM t0"""
# places; without an embedder the distance is the constant 0.35.
QUERIES["f_diversity_en"] = per_text("en", lambda t, k: dict(narrative_feature_diversity=M.narrative_diversity(t)))
_place = f"\\b(?:[A-Z][a-z]+\\s+)?(?:{W.PLACE})\\b"
_quarter = lambda k: f"list_distinct(list_transform(regexp_extract_all(substr(t, CAST(floor(length(t) / 4) AS INT) * {k} + 1, {'CAST(floor(length(t) / 4) AS INT)' if k < 3 else 'length(t)'}), {q(_place)}), lambda x: lower(x)))"
ORACLES["f_diversity_en"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, t, {', '.join(f'{_quarter(k)} AS p{k}' for k in range(4))} FROM t0),
    t2 AS (SELECT id, t, len(list_filter(p1, lambda x: NOT list_contains(p0, x))) + len(list_filter(p2, lambda x: NOT list_contains(list_concat(p0, p1), x)))
    + len(list_filter(p3, lambda x: NOT list_contains(list_concat(list_concat(p0, p1), p2), x))) AS n FROM t1)
    SELECT id, CASE WHEN length(t) < 100 THEN 0 ELSE round(least(0.35 + 0.05 * n, 1.0), 4) END AS narrative_feature_diversity FROM t2"""


def f_all_features(spark: SparkSession, d: str) -> DataFrame:
    """all metrics of every document by detected language; other languages' columns are null."""
    df = M.with_features(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text")
    return df.drop("text").select("doc_id", *[F.round(F.col(c), 5).alias(c) for c in df.columns if c[:3] in ("en_", "ja_", "zh_")])


def f_preview(spark: SparkSession, d: str) -> DataFrame:
    """the short preview of every English chapter."""
    return texts(spark, d, "en").select("id", F.size(words(F.col("t"))).alias("token_count"), F.size(sentences(F.col("t"), "en")).alias("sentence_count"), r9(M.punctuation_density(F.col("t"), "en")).alias("punctuation_density"), r9(M.dialogue_ratio(F.col("t"), "en")).alias("dialogue_ratio")).distinct()


def f_source_style(spark: SparkSession, d: str) -> DataFrame:
    """Average sentence length, punctuation density and sentences per paragraph per source (flagship)."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower(F.trim("source")).alias("source"), F.col("text").alias("t")).where(language(F.col("t")) == "en")
    per = docs.select("source", M.average_sentence(F.col("t"), "en").alias("a"), M.punctuation_density(F.col("t"), "en").alias("p"), M.sentences_per_paragraph(F.col("t"), "en").alias("s"))
    return per.groupBy("source").agg(F.count("*").alias("documents"), r9(F.avg("a")).alias("avg_sentence_len"), r9(F.avg("p")).alias("punc_density"), r9(F.avg("s")).alias("avg_sentences_per_paragraph"))


def f_language(spark: SparkSession, d: str) -> DataFrame:
    """Documents per detected script."""
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(language(F.col("text")).alias("language")).agg(F.count("*").alias("documents"))


def f_pacing(spark: SparkSession, d: str) -> DataFrame:
    """C24, DS5: pacing bars of every English chapter with their sum and greatest intensity step."""
    bars = A.pacing(F.col("t"), "en")
    return texts(spark, d, "en").select("id", F.array_join(bars.cast("array<string>"), ",").alias("pacing"), r9(F.array_min(A.intensity(bars))).alias("least_intensity")).distinct()


def f_pacing_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean length of the i-th paragraph over all English chapters for i < 40; 20 where there is none."""
    own = texts(spark, d, "en").select("id", F.posexplode(F.slice(F.transform(paragraphs(F.col("t")), lambda p: F.size(words(p))), 1, 40)).alias("pos", "n")).distinct().where("n > 0")
    means = own.groupBy("pos").agg(F.bround(F.avg("n")).cast("int").alias("words"))
    return spark.range(40).select(F.col("id").cast("int").alias("pos")).join(means, "pos", "left").select("pos", F.coalesce("words", F.lit(20)).alias("words"))


def f_arc_en(spark: SparkSession, d: str) -> DataFrame:
    """Four-act arc of every English chapter."""
    out = A.with_arc(texts(spark, d, "en"), "t", "en").withColumnRenamed("arc", "a")
    return out.select("id", *[F.col("a.quantiles")[k].alias(f"q{k + 1}") for k in range(4)], *[F.array_join(F.col("a.acts")[k]["sentence_range"].cast("array<string>"), "-").alias(f"range{k + 1}") for k in range(4)]).distinct()


def f_arc_openings(spark: SparkSession, d: str) -> DataFrame:
    """G12 in three languages: the arcs recomputed from the openings in arc_cache."""
    own = spark.read.parquet(f"{d}/arc_cache.parquet").select("novel_id", "opening").distinct()
    parts = [A.with_arc(own.where(language(F.col("opening")) == k), "opening", k) for k in LANGS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("novel_id", *[F.col("arc.quantiles")[k].alias(f"q{k + 1}") for k in range(4)])


def f_arc_mean(spark: SparkSession, d: str) -> DataFrame:
    """Positional mean of the stored arc quantiles and mean absolute act sentiment."""
    arcs = spark.read.parquet(f"{d}/arc_cache.parquet").select("novel_id", "quantiles").dropDuplicates(["novel_id"])
    return arcs.select("novel_id", F.posexplode("quantiles").alias("pos", "v")).groupBy("pos").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.avg(F.abs("v")), 4).alias("mean_abs"))


def f_clean_english(spark: SparkSession, d: str) -> DataFrame:
    """English chapters without the notes of translators, by length and print."""
    return texts(spark, d, "en").select("id", F.length(clean_english(F.col("t"))).alias("chars"), F.md5(clean_english(F.col("t"))).alias("print")).distinct()


def f_clean_japanese(spark: SparkSession, d: str) -> DataFrame:
    """Japanese chapters normalised and without ruby."""
    return texts(spark, d, "ja").select("id", F.length(clean_japanese(F.col("t"))).alias("chars"), F.md5(clean_japanese(F.col("t"))).alias("print")).distinct()


def f_clean_html(spark: SparkSession, d: str) -> DataFrame:
    """The documents wrapped as markup come back as their text."""
    t = F.regexp_replace("text", "&", "&amp;")
    markup = F.concat(F.lit("<html><body><p>"), F.regexp_replace(F.regexp_replace(t, "<", "&lt;"), "\\n", "<br>"), F.lit("</p></body></html>"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(clean_html(markup)).alias("print"))


def f_chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """Chapter numbers read from titles, and generic titles numbered."""
    ch = spark.read.parquet(f"{d}/chapter.parquet").select("id", "title", "chapter_number")
    return ch.select("id", chapter_number(F.col("title")).alias("parsed"), generic_title(F.col("title"), F.col("chapter_number")).alias("title")).distinct()


def f_samples(spark: SparkSession, d: str) -> DataFrame:
    """Representative samples of the English chapters."""
    return texts(spark, d, "en").select("id", F.md5(sample_words(F.col("t"), 30)).alias("print")).distinct()


def f_markers(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and distinct markers in every document."""
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", count_word(F.lower(t), [x for x in W.MONSTERS if x.isascii()]).alias("monsters"), distinct_markers(t, [x for x in W.MILITARY_EPIC if x.isascii()]).alias("military"))


for _f in (f_all_features, f_preview, f_source_style, f_language, f_pacing, f_pacing_profile, f_arc_en, f_arc_openings, f_arc_mean, f_clean_english, f_clean_japanese, f_clean_html, f_chapter_titles, f_samples, f_markers):
    QUERIES[_f.__name__] = _f

_lang_sql = "CASE WHEN regexp_matches({t}, '[぀-ゟ゠-ヿ]') THEN 'ja' WHEN regexp_matches({t}, '[一-鿿]') THEN 'zh' ELSE 'en' END"
ORACLES["f_preview"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, t, {_quoted} AS quo FROM t0) SELECT id, len({s_words('t')}) AS token_count, len({s_sentences('t', 'en')}) AS sentence_count,
    round({s_count('t', W.EN_PUNCTUATION)} / length(t), 9) AS punctuation_density, round(len({s_words('quo')}) / greatest(1, len({s_words('t')})), 9) AS dialogue_ratio FROM t1"""
_avg = f"CASE WHEN len({s_sentences('t', 'en')}) > 0 THEN CAST(len({s_words('t')}) AS DOUBLE) / len({s_sentences('t', 'en')}) ELSE 0 END"
ORACLES["f_source_style"] = f"""WITH d0 AS (SELECT lower(trim(source)) AS source, text AS t FROM documents WHERE {_lang_sql.format(t='text')} = 'en'),
    d1 AS (SELECT source, {_avg} AS a, CASE WHEN length(t) > 0 THEN {s_count('t', W.EN_PUNCTUATION)} / length(t) ELSE 0 END AS p, {s_paragraphs('t')} AS pp FROM d0),
    d2 AS (SELECT source, a, p, {s_mean(f"list_transform(pp, lambda x: len({s_non_blank(s_split('x', '[.!?]+'))}))")} AS s FROM d1)
    SELECT source, count(*) AS documents, round(avg(a), 9) AS avg_sentence_len, round(avg(p), 9) AS punc_density, round(avg(s), 9) AS avg_sentences_per_paragraph FROM d2 GROUP BY source"""
ORACLES["f_language"] = f"SELECT {_lang_sql.format(t='text')} AS language, count(*) AS documents FROM documents GROUP BY 1"
_sizes = lambda parts: f"list_filter(list_transform({parts}, lambda p: len({s_words('p')})), lambda n: n > 0)"
ORACLES["f_pacing"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, {_sizes(s_paragraphs('t'))} AS a, {_sizes(s_split('t', '[,;.!?\\n]+'))} AS b FROM t0),
    t2 AS (SELECT id, (CASE WHEN len(a) < 8 AND len(b) >= len(a) THEN b ELSE a END)[1:100] AS s FROM t1)
    SELECT id, array_to_string(s, ',') AS pacing, round(list_min(list_transform(s, lambda v: greatest(v / greatest(list_max(s), 1), 0.25))), 9) AS least_intensity FROM t2"""
ORACLES["f_pacing_profile"] = f"""WITH {s_texts('en')}, t1 AS (SELECT id, {s_paragraphs('t')} AS p FROM t0), t2 AS (SELECT id, generate_subscripts(p, 1) - 1 AS pos, len({s_words('unnest(p)')}) AS n FROM t1),
    m AS (SELECT pos, CAST(round_even(avg(n), 0) AS INT) AS words FROM t2 WHERE pos < 40 AND n > 0 GROUP BY pos)
    SELECT CAST(r.pos AS INT) AS pos, coalesce(words, 20) AS words FROM (SELECT unnest(range(40)) AS pos) r LEFT JOIN m ON m.pos = r.pos"""


def _arc_sql(source: str, lang: str) -> str:
    end, clause = ("[.!?]+", "[,;:.!?\\-\\n]+") if lang == "en" else ("[。！？]+", "[，、；：。！？\\n]+")
    clauses = f"list_filter(list_transform({s_split('t', clause)}, lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: length(x) > 3)"
    return f"""a0 AS ({source}), a1 AS (SELECT id, {s_non_blank(s_split('t', end))} AS s, {clauses} AS c FROM a0), a2 AS (SELECT id, CASE WHEN len(s) < 4 AND len(c) > 0 THEN c ELSE s END AS u FROM a1),
    a3 AS (SELECT id, len(u) AS n, list_transform(u, lambda x: {s_sentiment('x', lang)}) AS v FROM a2), a4 AS (SELECT id, n, v, unnest(range(4)) AS k FROM a3),
    a5 AS (SELECT id, n, k, v, CAST(n * k // 4 AS INT) AS a, CASE WHEN n * k // 4 >= n * (k + 1) // 4 THEN least(n, n * k // 4 + 1) ELSE n * (k + 1) // 4 END AS b FROM a4),
    a6 AS (SELECT id, n, k, a, b, v[a + 1:b] AS w FROM a5),
    a7 AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 ELSE (CASE WHEN list_avg(w) >= 0 THEN 1.0 ELSE -1.0 END) * sqrt(abs(list_avg(w)) * (sqrt(list_avg(list_transform(w, lambda x: x * x))) + 1e-6))
    * (1.0 + 0.5 * len(list_filter(w, lambda x: abs(x) > 0.05)) / len(w)) END AS raw FROM a6),
    a8 AS (SELECT id, k + 1 AS k, round(tanh(2.0 * raw), 4) AS s, CASE WHEN n > 0 THEN a || '-' || greatest(a, b - 1) ELSE '0-0' END AS r FROM a7)"""


_pick = ", ".join(f"max(CASE WHEN k = {k} THEN s END) AS q{k}" for k in range(1, 5))
ORACLES["f_arc_en"] = f"WITH {_arc_sql(s_texts('en')[7:-1], 'en')} SELECT id, {_pick}, {', '.join(f'max(CASE WHEN k = {k} THEN r END) AS range{k}' for k in range(1, 5))} FROM a8 GROUP BY id"
_open = f"SELECT DISTINCT novel_id AS id, opening AS t FROM arc_cache WHERE {_lang_sql.format(t='opening')} = "
ORACLES["f_arc_openings"] = " UNION ALL ".join(f"SELECT * FROM (WITH {_arc_sql(_open + q(k), k)} SELECT id AS novel_id, {_pick} FROM a8 GROUP BY id)" for k in LANGS)
ORACLES["f_arc_mean"] = """WITH a AS (SELECT novel_id, any_value(quantiles) AS v FROM arc_cache GROUP BY novel_id), b AS (SELECT generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM a)
    SELECT CAST(pos AS INT) AS pos, round(avg(x), 4) AS mean, round(avg(abs(x)), 4) AS mean_abs FROM b GROUP BY 1"""
_notes = "(?:TL\\s*note|T/N|Editor's\\s*note|EN|TN)"
_clean = f"regexp_replace(regexp_replace(t, {q(f'(?is)(?:\\[{_notes}:.*?\\]|\\({_notes}:.*?\\))')}, '', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"
ORACLES["f_clean_english"] = f"WITH {s_texts('en')} SELECT id, length({_clean}) AS chars, md5({_clean}) AS print FROM t0"
ORACLES["f_clean_html"] = f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')) AS print FROM documents"
ORACLES["f_chapter_titles"] = """SELECT DISTINCT id, CAST(coalesce(nullif(regexp_extract(title, '(?i)ch(?:apter)?\\s*(\\d+)', 1), ''), nullif(regexp_extract(title, '^(\\d+)', 1), '')) AS INT) AS parsed,
    CASE WHEN title IN ('Chapter', 'Chapter ') THEN 'Chapter ' || chapter_number ELSE title END AS title FROM chapter"""
ORACLES["f_samples"] = f"WITH {s_texts('en')} SELECT id, md5(array_to_string(({s_non_blank(s_split('t', f'[{WS}]+'))})[1:30], ' ')) AS print FROM t0"
ORACLES["f_markers"] = f"""SELECT doc_id, {s_count_words('lower(text)', [x for x in W.MONSTERS if x.isascii()])} AS monsters,
    {' + '.join(f"CAST(regexp_matches(lower(text), {q(f'\\b{x}\\b')}) AS INT)" for x in W.MILITARY_EPIC if x.isascii())} AS military FROM documents"""
