"""Queries of whole reports: all metrics of texts, novels and sources, percentiles, archetypes, works by id, and the dashboard's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import vectors as V
from ..functions import words as W
from ..functions.text import language, non_blank, split_list, strip
from ..operators import arc as A
from ..operators import dashboard as D
from ..operators.archetype import match_archetype
from ..sources import catalogue
from ..sources.readers import point
from . import style_queries as Y
from .flow_queries import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The work that the queries of one work ask for.
WORK = 7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- All metrics ---------------------------------------------------------------------------------------------------------------------------------

_PARTS = ["f_basic", "f_ttr", "f_dialogue", "f_sentiment", "f_theme", "f_time", "f_world"]
_SAME = "sentence_count avg_sentence_len punc_density avg_sentences_per_paragraph ttr dialogue_ratio compound_sentiment theme_explication_ratio temporal_shift_score sensory_body_density outside_world_engagement narrative_feature_diversity".split()
_OWN = {
    "en": {"dep_tree_depth": "dep_tree_depth", "adj_ratio": "adj_ratio", "verb_ratio": "verb_ratio", "pron_ratio": "0.0", "entity_density": "0.0"},
    "ja": {"dep_tree_depth": "0.0", "particle_ratio": "0.0", "verb_ratio": "0.0", "kanji_ratio": "kanji_ratio"},
    "zh": {"dep_tree_depth": "0.0", "particle_ratio": "0.0", "verb_ratio": "0.0"},
}


def features_sql(lang: str, source: str) -> str:
    """SELECT id and all metrics, with the language's prefix, of ``source``, a SELECT of (id, t)."""
    parts = [f"{p}_{lang}" for p in _PARTS] + ["f_diversity_en"] + {"en": ["f_syntax_en"], "ja": ["f_kanji_ja"], "zh": []}[lang]
    tables = []
    for k, p in enumerate(parts):
        sql = Y.ORACLES[p].replace(Y.s_texts("en"), f"t0 AS ({source})").replace(Y.s_texts(lang), f"t0 AS ({source})")
        tables.append(f"({sql}) x{k}")
    out = {"word_count" if lang == "en" else "char_count": "units"} | {k: k for k in _SAME} | {"linearity_subversion_score": "temporal_shift_score"} | _OWN[lang]
    return f"SELECT id, {', '.join(f'CAST({e} AS DOUBLE) AS {lang}_{k}' for k, e in out.items())} FROM {tables[0]} " + " ".join(f"JOIN {t} USING (id)" for t in tables[1:])


def metrics_of(lang: str) -> list[str]:
    """Names of the metrics of a language."""
    return ["word_count" if lang == "en" else "char_count", *_SAME, "linearity_subversion_score", *_OWN[lang]]


ALL = {k: metrics_of(k) for k in Y.LANGS}
_COLUMNS = [f"{k}_{m}" for k in Y.LANGS for m in ALL[k]]


def text_features(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``df`` with all metrics of its texts of one language, rounded to nine places."""
    return df.withColumns({f"{lang}_{k}": F.round(v, 9) for k, v in M.features(F.col(text), lang).items()}).drop(text)


def chapter_features(chapters: DataFrame) -> DataFrame:
    """(id, novel_id, metrics of each language): one row per chapter that has a text; repeated deliveries count once."""
    parts = [text_features(chapters.where(F.col(c) != "").select("id", "novel_id", F.col(c).alias("t")), "t", k) for k, c in Y.LANGS.items()]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.groupBy("id", "novel_id").agg(*[F.max(c).alias(c) for c in _COLUMNS])


def _chapter_sql(where: str = "") -> str:
    own = {k: features_sql(k, f"SELECT DISTINCT id, {c} AS t FROM chapter WHERE {c} <> ''{where}") for k, c in Y.LANGS.items()}
    ids = f"SELECT DISTINCT id, novel_id FROM chapter WHERE (text_en <> '' OR text_ja <> '' OR text_zh <> ''){where}"
    return f"SELECT * FROM ({ids}) c " + " ".join(f"LEFT JOIN ({sql}) {k} USING (id)" for k, sql in own.items())


_docs = {k: features_sql(k, f"SELECT doc_id AS id, text AS t FROM documents WHERE text <> '' AND {Y._lang_sql.format(t='text')} = '{k}'") for k in Y.LANGS}
QUERIES["f_all_features"] = Y.f_all_features
ORACLES["f_all_features"] = " UNION ALL BY NAME ".join(f"SELECT id AS doc_id, {', '.join(f'round({k}_{m}, 5) AS {k}_{m}' for m in ALL[k])} FROM ({sql})" for k, sql in _docs.items())


def _percentiles(lang: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = text_features(Y.texts(spark, d, lang), "t", lang).distinct()
        return raw.select("id", *[V.percentile(m, F.col(f"{lang}_{m}")).alias(m) for m in ALL[lang]])

    run.__doc__ = "M1: percentiles of all metrics of every chapter of one language."
    return run


for _k, _c in Y.LANGS.items():
    _name = "f_percentiles" if _k == "en" else f"f_percentiles_{_k}"
    QUERIES[_name] = _percentiles(_k)
    ORACLES[_name] = f"SELECT id, {', '.join(f'{V.percentile_sql(m, f"{_k}_{m}")} AS {m}' for m in ALL[_k])} FROM ({features_sql(_k, f"SELECT DISTINCT id, {_c} AS t FROM chapter WHERE {_c} <> ''")})"


def _archetype_sql(table: str, key: str, prefix: str) -> str:
    """SELECT key and the closest archetype of the rows of a table with the columns ``prefix`` + metric."""
    names = W.ARCHETYPE_METRICS
    place = "[" + ", ".join(V.percentile_sql(m, f"{prefix}{m}") for m in names) + "]"
    refs = ", ".join(f"({i}, {Y.q(g)}, [{', '.join(map(repr, v))}], {Y.q('Web Novel Territory' if g in W.WEB_ARCHETYPES else 'Classic Literature Territory')})" for i, (g, v) in enumerate(W.ARCHETYPES.items()))
    return f"""SELECT {key}, g AS closest_trope, terr AS territory, round(s, 6) AS confidence FROM (SELECT a.*, o, g, terr, list_dot_product(p, CAST(w AS DOUBLE[])) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(CAST(w AS DOUBLE[]), CAST(w AS DOUBLE[])))) AS s
        FROM (SELECT {key}, CAST({place} AS DOUBLE[]) AS p FROM {table}) a, (VALUES {refs}) r(o, g, w, terr)) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(s, 12) DESC, o) = 1"""


@query(" UNION ALL ".join(f"SELECT id, '{k}' AS lang, closest_trope, territory, confidence FROM ({_archetype_sql(f'({features_sql(k, f"SELECT DISTINCT id, {c} AS t FROM chapter WHERE {c} <> {Y.q('')}")})', 'id', k + '_')})" for k, c in Y.LANGS.items()))
def v_archetypes(spark: SparkSession, d: str) -> DataFrame:
    """The closest of the 17 archetypes of every chapter in each of its languages."""
    parts = []
    for k in Y.LANGS:
        raw = text_features(Y.texts(spark, d, k), "t", k).distinct()
        m = raw.select("id", F.lit(k).alias("lang"), match_archetype({x: F.col(f"{k}_{x}") for x in ALL[k]}).alias("a"))
        parts.append(m.select("id", "lang", "a.closest_trope", "a.territory", F.round("a.confidence", 6).alias("confidence")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Added before rounding, so that means that are halves of the last place (of few values with nine places) go up whatever their last bit.
_UP = 3.3e-10


def _means(keys: list[str], fill: bool = False) -> list[Column]:
    return [F.round((F.coalesce(F.avg(c), F.lit(0.0)) if fill else F.avg(c)) + _UP, 7).alias(c) for c in keys]


def _means_sql(fill: bool = False) -> str:
    return ", ".join(f"round({f'coalesce(avg({c}), 0)' if fill else f'avg({c})'} + {_UP}, 7) AS {c}" for c in _COLUMNS)


@query(f"SELECT novel_id, {_means_sql()} FROM ({_chapter_sql()}) GROUP BY novel_id")
def f_novel_means(spark: SparkSession, d: str) -> DataFrame:
    """A5: mean of every metric over each novel's chapters; novels without any text are left out."""
    return chapter_features(_t(spark, d, "chapter")).groupBy("novel_id").agg(*_means(_COLUMNS))


_SOURCES = "SELECT DISTINCT id AS novel_id, lower(trim(source)) AS source FROM novel"


def _with_source(spark: SparkSession, d: str) -> DataFrame:
    nv = _t(spark, d, "novel").select(F.col("id").alias("novel_id"), F.lower(F.trim("source")).alias("source")).distinct()
    return chapter_features(_t(spark, d, "chapter")).join(nv, "novel_id")


@query(f"SELECT source, count(*) AS chapters, {_means_sql(True)} FROM ({_chapter_sql()}) f JOIN ({_SOURCES}) n USING (novel_id) GROUP BY source")
def f_source_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of every metric per source over the chapters of known novels; a metric missing everywhere gives 0."""
    return _with_source(spark, d).groupBy("source").agg(F.count("*").alias("chapters"), *_means(_COLUMNS, True))


@query(_archetype_sql(f"(SELECT source, {_means_sql(True)} FROM ({_chapter_sql()}) f JOIN ({_SOURCES}) n USING (novel_id) GROUP BY source)", "source", "en_"))
def q_source_archetypes(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the sources: the archetype of each source's mean metrics (of the first language that the means have, English)."""
    m = f_source_means(spark, d)
    a = m.select("source", match_archetype({x: F.col(f"en_{x}") for x in ALL["en"]}).alias("a"))
    return a.select("source", "a.closest_trope", "a.territory", F.round("a.confidence", 6).alias("confidence"))


@query(f"""SELECT CASE WHEN source = 'gutenberg' THEN 'classic' ELSE 'web' END AS side, count(*) AS chapters, {', '.join(f'round(avg(coalesce({c}, 0)) + {_UP}, 7) AS {c}' for c in _COLUMNS)}
    FROM ({_chapter_sql()}) f JOIN ({_SOURCES}) n USING (novel_id) GROUP BY 1""")
def f_two_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Means of every metric of the classic and the web works, missing values counted as 0."""
    side = F.when(F.col("source") == "gutenberg", "classic").otherwise("web").alias("side")
    return _with_source(spark, d).groupBy(side).agg(F.count("*").alias("chapters"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))) + _UP, 7).alias(c) for c in _COLUMNS])


# --- One work ------------------------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT n.id, n.title, n.author, n.source, c.id AS chapter_id, c.chapter_number, c.title AS chapter_title, md5(coalesce(text_ja, '')) AS ja, md5(coalesce(text_en, '')) AS en, md5(coalesce(text_zh, '')) AS zh
    FROM novel n LEFT JOIN chapter c ON c.novel_id = n.id WHERE n.id = {WORK}""")
def q_work(spark: SparkSession, d: str) -> DataFrame:
    """Detail of one work with its chapters; the id reaches both scans."""
    nv = point(_t(spark, d, "novel"), "id", WORK).select("id", "title", "author", "source").distinct()
    ch = point(_t(spark, d, "chapter"), "novel_id", WORK)
    prints = [F.md5(F.coalesce(f"text_{k}", F.lit(""))).alias(k) for k in ("ja", "en", "zh")]
    own = ch.select(F.col("novel_id").alias("id"), F.col("id").alias("chapter_id"), "chapter_number", F.col("title").alias("chapter_title"), *prints).distinct()
    out = nv.join(own, "id", "left")
    return out.select("id", "title", "author", "source", "chapter_id", "chapter_number", "chapter_title", *[F.coalesce(c, F.md5(F.lit(""))).alias(c) for c in ("ja", "en", "zh")])


@query(f"""WITH m AS (SELECT novel_id, {_means_sql()} FROM ({_chapter_sql(f" AND novel_id = {WORK}")}) GROUP BY novel_id), u AS (UNPIVOT m ON {', '.join(_COLUMNS)} INTO NAME metric VALUE raw)
    SELECT n.id, n.title, u.metric, u.raw, CASE {' '.join(f"WHEN metric = '{k}_{m}' THEN {V.percentile_sql(m, 'raw')}" for k in Y.LANGS for m in ALL[k])} END AS place FROM u JOIN (SELECT DISTINCT id, title FROM novel WHERE id = {WORK}) n ON n.id = u.novel_id""")
def q_work_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of one work: mean of every metric over its chapters, and its percentile."""
    own = chapter_features(point(_t(spark, d, "chapter"), "novel_id", WORK)).groupBy("novel_id").agg(*_means(_COLUMNS))
    long = own.unpivot("novel_id", _COLUMNS, "metric", "raw").where("raw IS NOT NULL")
    place = F.lit(None).cast("double")
    for k in Y.LANGS:
        for m in ALL[k]:
            place = F.when(F.col("metric") == f"{k}_{m}", V.percentile(m, F.col("raw"))).otherwise(place)
    nv = point(_t(spark, d, "novel"), "id", WORK).select("id", "title").distinct()
    return long.withColumn("place", place).join(nv, F.col("id") == F.col("novel_id")).select("id", "title", "metric", "raw", "place")


_EVENLY = "list_transform(range({m}), lambda i: CAST(round_even(i * ({n} - 1) / {d}.0, 0) AS INT))"
_first = "CASE WHEN coalesce(text_en, '') <> '' THEN 'en' WHEN coalesce(text_ja, '') <> '' THEN 'ja' WHEN coalesce(text_zh, '') <> '' THEN 'zh' ELSE 'en' END"
_sents = "CASE lang {} END".format(" ".join(f"WHEN '{k}' THEN list_transform({Y.s_non_blank(Y.s_split(f'coalesce({c}, {Y.q('')})', '[.!?]+' if k == 'en' else '[。！？]+'))}, lambda x: regexp_replace(x, '^[{Y.WS}]+|[{Y.WS}]+$', '', 'g'))" for k, c in Y.LANGS.items()))


def _work_arc_sql(lang: str) -> str:
    tail = Y._arc_sql("SELECT 1", lang)
    tail = tail[tail.index("a3 AS") :]
    return f"""SELECT id AS novel_id, '{lang}' AS lang, {Y._pick} FROM (WITH c0 AS (SELECT DISTINCT ON (id) id, novel_id, chapter_number, text_en, text_ja, text_zh FROM chapter),
        c1 AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY novel_id) AS n, first_value({_first}) OVER w AS lang FROM c0 WINDOW w AS (PARTITION BY novel_id ORDER BY chapter_number, id)),
        c2 AS (SELECT * FROM c1 WHERE lang = '{lang}' AND (n <= 16 OR list_contains({_EVENLY.format(m=16, n='n', d=15)}, k))),
        c3 AS (SELECT novel_id AS id, flatten(list({_sents} ORDER BY k)) AS s FROM c2 GROUP BY novel_id),
        a2 AS (SELECT id, CASE WHEN len(s) <= 160 THEN s ELSE list_transform({_EVENLY.format(m=160, n='len(s)', d=159)}, lambda i: s[i + 1]) END AS u FROM c3 WHERE len(s) > 0), {tail} SELECT * FROM a8) GROUP BY id"""


@query(" UNION ALL ".join(_work_arc_sql(k) for k in Y.LANGS))
def v_work_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The arc of every work from 160 evenly spaced sentences of 16 evenly spaced chapters, in the language of its first chapter.

    Chapters are ranked by their keys alone; only the picked ones' texts are read into the works' groups."""
    from pyspark.sql import Window

    ch = _t(spark, d, "chapter")
    has = [F.coalesce(F.col(c), F.lit("")) != "" for c in Y.LANGS.values()]
    first = F.when(has[0], "en").when(has[1], "ja").when(has[2], "zh").otherwise("en")
    keys = ch.select("id", "novel_id", "chapter_number", first.alias("l")).distinct()
    order = Window.partitionBy("novel_id").orderBy("chapter_number", "id")
    sizes = keys.groupBy("novel_id").agg(F.count("*").alias("n"), F.min_by("l", F.struct("chapter_number", "id")).alias("lang"))
    ranked = keys.withColumn("k", F.row_number().over(order) - 1).join(sizes, "novel_id")
    spots = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.bround(i * (F.col("n") - 1) / 15.0).cast("int"))
    picked = ranked.where((F.col("n") <= 16) | F.array_contains(spots, F.col("k"))).select("id", "novel_id", "k", "lang")
    texts = picked.join(ch.select("id", *Y.LANGS.values()).where(has[0] | has[1] | has[2]), "id").dropDuplicates(["id"])
    out = None
    for k, c in Y.LANGS.items():
        parts = F.transform(non_blank(F.split(F.coalesce(F.col(c), F.lit("")), "[.!?]+" if k == "en" else "[。！？]+")), strip)
        own = texts.where(F.col("lang") == k).select("novel_id", "k", parts.alias("s")).groupBy("novel_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])).alias("s"))
        own = own.where(F.size("s") > 0).withColumn("u", A.evenly(F.col("s"), 160))
        arc = A.with_arc(own, "u", k, units=F.col("u")).select("novel_id", F.lit(k).alias("lang"), *[F.col("arc.quantiles")[i].alias(f"q{i + 1}") for i in range(4)])
        out = arc if out is None else out.unionByName(arc)
    return out


@query("""SELECT DISTINCT id, CASE WHEN regexp_matches(lower(coalesce(genre, '')), 'isekai|progression|action') THEN '-0.25,0.35,0.45,0.2' WHEN regexp_matches(lower(coalesce(genre, '')), 'tragedy|horror') THEN '0.15,-0.1,-0.45,-0.3'
    ELSE '0.1,0.28,0.38,0.18' END AS arc FROM novel""")
def g_default_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The trajectory that stands for a work without a text."""
    return _t(spark, d, "novel").select("id", F.array_join(A.default_arc(F.col("genre")).cast("array<string>"), ",").alias("arc")).distinct()


# --- Dashboard -----------------------------------------------------------------------------------------------------------------------------------


_meta = ", ".join(f"('{m}', '{c}')" for m, (_, c, _) in D.METRICS.items())


@query(f"""WITH m AS (SELECT novel_id, {_means_sql()} FROM ({_chapter_sql()}) GROUP BY novel_id), u AS (UNPIVOT m ON {', '.join(_COLUMNS)} INTO NAME name VALUE raw)
    SELECT novel_id, category, count(DISTINCT metric) AS cards FROM (SELECT novel_id, substr(name, 4) AS metric FROM u) JOIN (VALUES {_meta}) x(metric, category) USING (metric) GROUP BY 1, 2""")
def d_cards(spark: SparkSession, d: str) -> DataFrame:
    """DS1, DS3: how many metrics of each category a work can show."""
    return D.cards(f_novel_means(spark, d), "novel_id")


_dims = ", ".join(f"({i}, '{m}', {lo}, {hi})" for i, (m, lo, hi) in enumerate(D.RADAR_RANGES))


@query(f"""WITH m AS (SELECT novel_id, {_means_sql()} FROM ({_chapter_sql()}) GROUP BY novel_id),
    v AS (SELECT m.*, CASE WHEN {' OR '.join(f'zh_{x} IS NOT NULL' for x in ALL['zh'])} THEN 'zh' WHEN {' OR '.join(f'ja_{x} IS NOT NULL' for x in ALL['ja'])} THEN 'ja' ELSE 'en' END AS p FROM m),
    r AS (SELECT novel_id, i, lo, hi, CASE metric {' '.join(f"WHEN '{m}' THEN coalesce(CASE p WHEN 'zh' THEN zh_{m} WHEN 'ja' THEN ja_{m} ELSE en_{m} END, en_{m}, ja_{m})" for m, _, _ in D.RADAR_RANGES)} END AS raw FROM v, (VALUES {_dims}) d(i, metric, lo, hi))
    SELECT novel_id, string_agg(CAST(CAST(round(CASE WHEN raw IS NULL THEN 0 ELSE least(greatest((raw - lo) / (hi - lo), 0), 1) END * 1000, 0) AS INT) AS VARCHAR), ',' ORDER BY i) AS radar FROM r GROUP BY novel_id""")
def d_radar(spark: SparkSession, d: str) -> DataFrame:
    """DS4: the radar values of every work without normalised ones: its language's raw metric scaled to its range, else English, else Japanese, else 0 (in thousandths)."""
    values = D.radar(f_novel_means(spark, d), None)
    return f_novel_means(spark, d).select("novel_id", F.array_join(F.transform(values, lambda x: F.round(x * 1000).cast("int").cast("string")), ",").alias("radar"))


@query("""WITH n AS (SELECT DISTINCT id, genre, territory FROM novel), t AS (SELECT count(*) FILTER (territory = 'Web Novel Territory') AS web, count(*) FILTER (territory = 'Classic Literature Territory') AS classic FROM n)
    SELECT (SELECT count(DISTINCT genre) FROM n WHERE genre IS NOT NULL) AS genres, web, classic, round(100.0 * web / greatest(web + classic, 1), 1) AS web_percent, round(100.0 * classic / greatest(web + classic, 1), 1) AS classic_percent FROM t""")
def d_figures(spark: SparkSession, d: str) -> DataFrame:
    """Genres in use and the share of either territory."""
    return D.figures(_t(spark, d, "novel").select("id", "genre", "territory").distinct())


@query("""WITH s AS (SELECT DISTINCT id, tags FROM stats_cache), p AS (SELECT id, list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS v FROM s WHERE tags IS NOT NULL)
    SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS tropes FROM p""")
def d_distinct_tropes(spark: SparkSession, d: str) -> DataFrame:
    """SE6: the different tags of a work without regard to case, in their order (shown in lower case)."""
    own = _t(spark, d, "stats_cache").select("id", "tags").distinct().where(F.col("tags").isNotNull())
    return own.select("id", F.array_join(F.transform(D.distinct_titles(split_list("tags")), F.lower), "|").alias("tropes"))


# --- Catalogues ----------------------------------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT id, title, author, tags FROM novel WHERE lower(trim(source)) = 'gutenberg'), t AS (SELECT novel_id, min(id) AS c FROM chapter WHERE text_en <> '' GROUP BY novel_id),
    b AS (SELECT n.id, n.title, coalesce(nullif(author, ''), 'Unknown Author') AS author, any_value(text_en) AS x FROM n JOIN t ON t.novel_id = n.id JOIN chapter ch ON ch.id = t.c GROUP BY ALL),
    w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\s\\x{3000}\\x{a0}]+'), lambda y: y <> '') AS v FROM b) SELECT id AS book, title AS series_title, author, len(v[1:3000]) AS words, md5(array_to_string(v[1:3000], ' ')) AS print FROM w""")
def s_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue pages landed as JSON, joined with landed texts; the first 3,000 words of each book."""
    place = scratch(spark)
    ch = _t(spark, d, "chapter").where("text_en <> ''")
    least = ch.groupBy("novel_id").agg(F.min("id").alias("id"))
    texts = ch.join(least.select("id"), "id", "left_semi").select(F.col("novel_id").alias("book"), F.col("text_en").alias("text")).dropDuplicates(["book"])
    nv = _t(spark, d, "novel").where(F.lower(F.trim("source")) == "gutenberg").select("id", "title", "author", "tags").distinct()
    book = F.struct("id", "title", F.when(F.coalesce("author", F.lit("")) != "", F.array(F.struct(F.col("author").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("authors"), split_list("tags").alias("subjects"))
    pages = nv.withColumn("page", F.pmod("id", F.lit(8))).groupBy("page").agg(F.to_json(F.struct(F.collect_list(book).alias("results"))).alias("value"))
    pages.select("value").write.text(f"{place}/pages")
    out = catalogue.books(catalogue.pages(spark, f"{place}/pages"), texts, words=3000)
    return out.select("book", "series_title", "author", F.size(F.split("text_en", " ")).alias("words"), F.md5("text_en").alias("print"))


_kinds = {g: list(dict.fromkeys([g.lower(), *W.GENRE_TAGS.get(g, "").split("|")])) for g in ("Horror", "Romance", "Slice of Life")}


@query("WITH n AS (SELECT DISTINCT id, tags FROM novel) " + " UNION ALL ".join(f"SELECT id, {Y.q(g)} AS genre FROM n WHERE regexp_matches(lower(tags), {Y.q('(?:^|[^\\p{L}\\p{N}_])(?:' + '|'.join(ks) + ')(?:$|[^\\p{L}\\p{N}_])')})" for g, ks in _kinds.items()))
def s_target_genres(spark: SparkSession, d: str) -> DataFrame:
    """P12, PL3: works whose tags name one of three wanted genres or one of its keywords."""
    nv = _t(spark, d, "novel").select("id", "tags").distinct()
    parts = [nv.where(catalogue.matches_genre(F.col("tags"), g)).select("id", F.lit(g).alias("genre")) for g in _kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH n AS (SELECT DISTINCT id, genre, title, lower(trim(source)) AS source FROM novel), g AS (SELECT *, CASE WHEN source = 'gutenberg' THEN 'classic' ELSE 'web' END AS side, trim(string_split(genre, ',')[1]) AS stratum FROM n WHERE genre IS NOT NULL AND genre <> '')
    SELECT id, side, stratum FROM g QUALIFY row_number() OVER (PARTITION BY side, stratum ORDER BY id) <= 20""")
def s_stratified(spark: SparkSession, d: str) -> DataFrame:
    """PL2: a corpus of at most twenty works per genre of either side."""
    nv = _t(spark, d, "novel").select("id", "genre", F.lower(F.trim("source")).alias("source")).distinct().where("genre <> ''")
    own = nv.select("id", F.when(F.col("source") == "gutenberg", "classic").otherwise("web").alias("side"), F.trim(F.split("genre", ",")[0]).alias("stratum"))
    return catalogue.stratified(own, ["side", "stratum"], [F.col("id")], 20)
