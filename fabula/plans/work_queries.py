"""Queries over works and chapters: catalogue, rules, similarity, ingestion; with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import words as W
from ..functions.metrics import average_sentence, depth, sentences_per_paragraph
from ..functions.text import cjk, first_text, language, split_list
from ..operators import classify as C
from ..operators import relational as R
from ..operators import similarity as S
from .style_queries import q, s_count_parts, s_count_words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def novels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "novel").distinct()


def chapter_keys(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _t(spark, d, "chapter").select("id", "novel_id", "chapter_number", *more).distinct()


NV = "nv AS (SELECT DISTINCT * FROM novel)"
CH = "ch AS (SELECT DISTINCT id, novel_id, chapter_number FROM chapter)"


@query(f"WITH {NV}, {CH} SELECT nv.id, count(ch.id) AS chapters, max(ch.chapter_number) AS last_number FROM nv LEFT JOIN ch ON ch.novel_id = nv.id GROUP BY nv.id")
def c_novel_chapters(spark, d):
    """Chapters of every novel, also of those without any."""
    ch = chapter_keys(spark, d).groupBy("novel_id").agg(F.count("*").alias("chapters"), F.max("chapter_number").alias("last_number"))
    return novels(spark, d).select("id").join(ch, F.col("id") == F.col("novel_id"), "left").select("id", F.coalesce("chapters", F.lit(0)).alias("chapters"), "last_number")


@query(f"WITH {NV} SELECT lower(trim(source)) AS source, count(*) AS novels FROM nv GROUP BY 1")
def c_source_counts(spark, d):
    """A1: novels per source."""
    return novels(spark, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("novels"))


@query(f"WITH {NV} SELECT coalesce(genre, 'Unclassified') AS genre, count(*) AS novels FROM nv GROUP BY 1")
def c_genre_counts(spark, d):
    """A2: novels per stored genre string, unclassified ones under their own name."""
    return novels(spark, d).groupBy(F.coalesce("genre", F.lit("Unclassified")).alias("genre")).agg(F.count("*").alias("novels"))


@query(f"WITH {NV}, {CH} SELECT ch.id, ch.novel_id, nv.title FROM ch JOIN nv ON ch.novel_id = nv.id WHERE lower(trim(nv.source)) = 'gutenberg'")
def c_classic_chapters(spark, d):
    """Chapters of the novels of one source."""
    nv = novels(spark, d).where(F.lower(F.trim("source")) == "gutenberg").select(F.col("id").alias("novel_id"), "title")
    return chapter_keys(spark, d).join(nv, "novel_id").select("id", "novel_id", "title")


@query(f"WITH {NV}, {CH} SELECT id FROM nv WHERE EXISTS (SELECT 1 FROM ch WHERE ch.novel_id = nv.id)")
def c_novels_with_chapters(spark, d):
    """Novels that have a chapter."""
    return novels(spark, d).join(_t(spark, d, "chapter").select(F.col("novel_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {NV}, {CH} SELECT id FROM nv WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.novel_id = nv.id)")
def c_novels_without_chapters(spark, d):
    """Novels that have no chapter."""
    return novels(spark, d).join(_t(spark, d, "chapter").select(F.col("novel_id").alias("id")), "id", "left_anti").select("id")


_genres = ", ".join(f"({q(g)})" for g in W.GENRE_PRIORITY)


@query(f"""WITH {NV} SELECT 'total' AS section, 'novels' AS name, count(*) AS n FROM nv UNION ALL SELECT 'source', split_part(lower(trim(source)), '/', 1), count(*) FROM nv GROUP BY 2
    UNION ALL SELECT 'territory', coalesce(territory, CASE WHEN lower(trim(source)) = 'gutenberg' THEN 'Classic Literature Territory' ELSE 'Web Novel Territory' END), count(*) FROM nv GROUP BY 2
    UNION ALL SELECT 'genre', g, (SELECT count(*) FROM nv WHERE contains(lower(coalesce(genre, '')), lower(g))) FROM (VALUES {_genres}) v(g)""")
def c_overview(spark, d):
    """Totals by source, territory (derived where missing) and the 17 genres, in several of which a novel may count."""
    nv = novels(spark, d)
    one = lambda section, c: nv.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    total = nv.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("novels").alias("name"), "n")
    by_genre = R.multi_bucket_counts(nv, "genre", W.GENRE_PRIORITY).select(F.lit("genre").alias("section"), F.col("bucket").alias("name"), "n")
    return total.unionByName(one("source", F.split(F.lower(F.trim("source")), "/")[0])).unionByName(one("territory", F.coalesce("territory", C.default_territory(F.col("source"))))).unionByName(by_genre)


@query(f"WITH {NV} SELECT id FROM nv WHERE lower(trim(source)) <> 'gutenberg' AND (contains(lower(coalesce(genre, '')), 'fantasy') OR contains(lower(coalesce(genre, '')), 'isekai')) AND NOT contains(lower(coalesce(genre, '')), 'romance')")
def c_genre_filter(spark, d):
    """Web works with any of some genres and none of others."""
    return novels(spark, d).where((F.lower(F.trim("source")) != "gutenberg") & R.has_any(F.col("genre"), ["Fantasy", "Isekai"]) & ~R.has_any(F.col("genre"), ["Romance"])).select("id")


@query(f"WITH {NV} SELECT id, title FROM nv WHERE contains(lower(title), 'lantern') OR contains(lower(author), 'lantern') OR contains(lower(coalesce(genre, '')), 'lantern') OR contains(lower(source), 'lantern')")
def c_search(spark, d):
    """P10: free-text search."""
    return R.search(novels(spark, d), ["title", "author", "genre", "source"], "Lantern").select("id", "title")


@query("""WITH c AS (SELECT DISTINCT id, text_ja, text_en, text_zh FROM chapter) SELECT count(*) AS chapters, count(*) FILTER (text_en <> '') AS en, count(*) FILTER (text_ja <> '') AS ja, count(*) FILTER (text_zh <> '') AS zh,
    count(*) FILTER (text_en <> '' AND text_ja <> '') AS both FROM c""")
def c_language_presence(spark, d):
    """Chapters that have a text in each language."""
    has = {k: (F.coalesce(F.col(f"text_{k}"), F.lit("")) != "") for k in ("en", "ja", "zh")}
    ch = _t(spark, d, "chapter").select("id", *[v.alias(k) for k, v in has.items()]).distinct()
    return ch.agg(F.count("*").alias("chapters"), *[F.count_if(F.col(k)).alias(k) for k in has], F.count_if(F.col("en") & F.col("ja")).alias("both"))


@query(f"WITH {NV} SELECT id, title FROM nv ORDER BY title, id LIMIT 8 OFFSET 16")
def c_page(spark, d):
    """The third page of the library."""
    return R.page(novels(spark, d).select("id", "title"), [F.col("title"), F.col("id")], 3)


@query("WITH c AS (SELECT DISTINCT id, novel_id, chapter_number, title FROM chapter) SELECT novel_id, id, title FROM c QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY chapter_number, id) = 1")
def c_first_chapter(spark, d):
    """The first chapter of every novel."""
    first = chapter_keys(spark, d, "title").groupBy("novel_id").agg(F.min(F.struct("chapter_number", "id", "title")).alias("m"))
    return first.select("novel_id", "m.id", "m.title")


@query("""WITH c AS (SELECT DISTINCT id, novel_id, chapter_number, coalesce(nullif(text_en, ''), nullif(text_ja, ''), nullif(text_zh, ''), '') AS t FROM chapter),
    r AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_number, id) - 1 AS i, count(*) OVER (PARTITION BY novel_id) AS n FROM c)
    SELECT novel_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS print FROM r WHERE i = 0 OR i = n - 1 OR (n >= 3 AND i = n // 2) GROUP BY novel_id""")
def c_three_chapters(spark, d):
    """First, middle and last chapter of every novel as one text."""
    ch = _t(spark, d, "chapter").select("id", "novel_id", "chapter_number", first_text("text_en", "text_ja", "text_zh").alias("t"))
    return R.opening_middle_end(ch, "novel_id", [F.col("chapter_number"), F.col("id")], "t").select("novel_id", F.md5("t").alias("print"))


@query("WITH c AS (SELECT id, any_value(novel_id) AS novel_id, min(ingested_at) AS came FROM chapter GROUP BY id) SELECT id, novel_id FROM c QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY came, id) <= 12")
def c_chapter_quota(spark, d):
    """At most twelve chapters per novel in the order of arrival; a chapter delivered again counts once."""
    ch = _t(spark, d, "chapter").groupBy("id").agg(F.first("novel_id").alias("novel_id"), F.min("ingested_at").alias("at"))
    return R.quota(ch, ["novel_id"], [F.col("at"), F.col("id")], 12).select("id", "novel_id")


@query(f"WITH {NV}, g AS (SELECT id, trim(split_part(genre, ',', 1)) AS genre FROM nv WHERE genre IS NOT NULL) SELECT id, genre FROM g WHERE genre <> '' QUALIFY row_number() OVER (PARTITION BY genre ORDER BY id) <= 20")
def c_genre_quota(spark, d):
    """At most twenty novels per leading genre."""
    nv = novels(spark, d).where(F.col("genre").isNotNull()).select("id", F.trim(F.split("genre", ",")[0]).alias("genre")).where("genre <> ''")
    return R.quota(nv, ["genre"], [F.col("id")], 20)


@query("""WITH c AS (SELECT id, any_value(novel_id) AS novel_id, any_value(chapter_number) AS n, min(ingested_at) AS came FROM chapter GROUP BY id),
    m AS (SELECT *, coalesce(max(CASE WHEN n <> 0 THEN n END) OVER (PARTITION BY novel_id), 0) AS top, row_number() OVER (PARTITION BY novel_id, n = 0 ORDER BY came, id) AS i FROM c)
    SELECT id, novel_id, CASE WHEN n = 0 THEN top + i ELSE n END AS chapter_number FROM m""")
def c_numbered(spark, d):
    """Chapters without a number get the next ones of their novel in the order of arrival."""
    ch = _t(spark, d, "chapter").groupBy("id").agg(F.first("novel_id").alias("novel_id"), F.first("chapter_number").alias("chapter_number"), F.min("ingested_at").alias("at"))
    return R.number_missing(ch, "novel_id", "chapter_number", [F.col("at"), F.col("id")], F.col("chapter_number") == 0).select("id", "novel_id", "chapter_number")


@query(f"WITH {NV} SELECT id FROM nv ORDER BY md5(id || ':42'), id LIMIT 30")
def c_seeded_sample(spark, d):
    """Thirty novels by a seed."""
    return R.seeded_sample(novels(spark, d).select("id"), "id", 30, 42)


@query("""WITH o AS (SELECT DISTINCT * FROM novel), i AS (SELECT lower(trim(title)) AS k0, lower(trim(author)) AS k1, min(genre) AS g, min(territory) AS t FROM stats_cache GROUP BY 1, 2)
    SELECT o.id, coalesce(o.genre, i.g) AS genre, coalesce(o.territory, i.t) AS territory FROM o FULL JOIN i ON lower(trim(o.title)) = k0 AND lower(trim(o.author)) = k1""")
def c_upsert(spark, d):
    """K2, K3: genre and territory of the novels filled from the cached statistics where missing; unknown works are added."""
    return R.upsert(novels(spark, d), _t(spark, d, "stats_cache").select("title", "author", "genre", "territory"), ["title", "author"], ["genre", "territory"]).select("id", "genre", "territory")


@query("SELECT DISTINCT id, title, epoch_us(updated_at) AS updated_us FROM stats_cache QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, title) = 1")
def c_keep_latest(spark, d):
    """K4: the latest cached row of every novel."""
    return R.keep_latest(_t(spark, d, "stats_cache").select("id", "title", "updated_at"), ["id"], [F.desc("updated_at"), F.col("title")]).select("id", "title", F.unix_micros("updated_at").alias("updated_us"))


@query(f"""WITH {NV}, s AS (SELECT DISTINCT id, coalesce(territory, '') AS territory FROM stats_cache), a AS (SELECT DISTINCT novel_id FROM arc_cache)
    SELECT nv.id, CASE WHEN s.id IS NOT NULL AND a.novel_id IS NOT NULL THEN 'full' WHEN s.id IS NOT NULL THEN 'stats' WHEN a.novel_id IS NOT NULL THEN 'arc' ELSE 'base' END AS tier
    FROM nv LEFT JOIN (SELECT DISTINCT id FROM s) s ON s.id = nv.id LEFT JOIN a ON a.novel_id = nv.id""")
def c_tiers(spark, d):
    """From which cached table each novel can be answered."""
    s, a = _t(spark, d, "stats_cache").select("id", F.lit(True).alias("s")).distinct(), _t(spark, d, "arc_cache").select(F.col("novel_id").alias("id"), F.lit(True).alias("a")).distinct()
    tier = F.when(F.col("s") & F.col("a"), "full").when(F.col("s"), "stats").when(F.col("a"), "arc").otherwise("base")
    return novels(spark, d).select("id").join(s, "id", "left").join(a, "id", "left").select("id", tier.alias("tier"))


@query(f"WITH {NV}, s AS (SELECT DISTINCT id FROM stats_cache WHERE top_matches IS NOT NULL) SELECT id FROM nv WHERE id NOT IN (SELECT id FROM s)")
def c_pending(spark, d):
    """K7: novels that a rebuild of the matches has still to do."""
    done = _t(spark, d, "stats_cache").where(F.col("top_matches").isNotNull()).select("id")
    return novels(spark, d).select("id").join(done, "id", "left_anti")


# --- Rules ------------------------------------------------------------------------------------------------------------------------------------


def _tag_sql() -> str:
    out = []
    for g in W.GENRE_PRIORITY:
        keys = W.GENRE_TAGS[g].split("|")
        latin, other = [k for k in keys if not cjk(k)], [k for k in keys if cjk(k)]
        pattern = "|".join(([r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(latin) + r")(?:$|[^\p{L}\p{N}_])"] if latin else []) + other)
        out.append(f"WHEN len(list_filter(tags, lambda t: regexp_matches(lower(t), {q(pattern)}))) > 0 THEN {q(g)}")
    return "CASE " + " ".join(out) + " END"


_TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH {NV}, t AS (SELECT id, {_TAGS} AS tags FROM nv) SELECT id, {_tag_sql()} AS genre FROM t")
def g_consolidate(spark, d):
    """G1: the parent genre of every novel by its tags."""
    return novels(spark, d).select("id", C.consolidate(split_list(F.col("tags"))).alias("genre"))


def _markers_sql(t: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {q(x)}) AS INT)" if cjk(x) else f"CAST(regexp_matches({t}, {q(f'\\b{x}\\b')}) AS INT)" for x in terms) + ")"


@query(f"""WITH m AS (SELECT doc_id, {_markers_sql('lower(text)', W.MILITARY_EPIC)} AS military, {_markers_sql('lower(text)', W.HARD_CULTIVATION)} AS cultivation FROM documents)
    SELECT doc_id, military, cultivation, CASE WHEN military >= 3 AND cultivation = 0 THEN 'A' WHEN military >= 3 AND cultivation >= 2 THEN 'B' ELSE 'NONE' END AS scenario FROM m""")
def g_guardrail(spark, d):
    """Military and cultivation markers of every document and the scenario they make."""
    return _t(spark, d, "documents").select("doc_id", C.guardrail(F.col("text")).alias("g")).select("doc_id", "g.military", "g.cultivation", "g.scenario")


@query(f"""WITH m AS (SELECT DISTINCT id, {', '.join(f"({s_count_words('lower(c)', [x for x in v if not cjk(x)])} + {s_count_parts('lower(c)', [x for x in v if cjk(x)])}) AS {k}" for k, v in (('monster', W.MONSTERS), ('fear', W.FEARS), ('scifi', W.PURE_SCIFI), ('game', W.SYSTEMS), ('cultivation', W.CULTIVATION_CORE), ('isekai', W.OTHER_WORLDS)))}
    FROM (SELECT id, coalesce(genre, '') || ' ' || coalesce(tags, '') AS c FROM novel)) SELECT * FROM m""")
def g_marker_counts(spark, d):
    """Trope markers in the tags and genres of every novel."""
    counts = C.marker_counts(F.concat(F.coalesce("genre", F.lit("")), F.lit(" "), F.coalesce("tags", F.lit(""))))
    return novels(spark, d).select("id", *[v.alias({"system": "game"}.get(k, k)) for k, v in counts.items()])


@query()
def g_rank_genres(spark, d):
    """Ranked genres of every novel by tags, source and stored genre."""
    nv = novels(spark, d).withColumn("text", F.lit(""))
    return C.rank_genres(nv, "tags", "text", "source", "territory", "genre").select("id", "primary_genre", F.array_join("genres", ", ").alias("genres"), F.array_join("penalties", ", ").alias("penalties"))


_web = " + ".join(f"CAST(contains(lower(t), {q(m)}) AS INT)" for m in W.WEB_MARKERS)


@query()
def g_territory(spark, d):
    """Territory of every English chapter by style, tropes and the genre of its novel."""
    t = F.col("t")
    ch = _t(spark, d, "chapter").where("text_en <> ''").select("id", "novel_id", F.col("text_en").alias("t"))
    raw = ch.select("id", "novel_id", average_sentence(t, "en").alias("l"), sentences_per_paragraph(t, "en").alias("p"), depth(t).alias("dep"), "t").dropDuplicates(["id"])
    raw = raw.select("id", "novel_id", C.style_classic(F.col("l"), F.col("p"), F.col("dep"), t).alias("style"))
    nv = novels(spark, d).select(F.col("id").alias("novel_id"), (~R.has_any(F.col("genre"), ["Isekai", "Cultivation", "Progression", "Fantasy"])).alias("classic"))
    out = raw.join(nv, "novel_id").select("id", C.territory(F.lit(0.0), F.lit(0.0), F.col("style"), F.col("classic")).alias("x"))
    return out.select("id", "x.territory", F.round("x.confidence", 6).alias("confidence"))


# --- Vectors ----------------------------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) SELECT label, pos - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 9) AS value, count(*) AS samples_used FROM e GROUP BY 1, 2""")
def v_centroids(spark, d):
    """Element-wise mean vector of every label."""
    e = _t(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg("x"), 9).alias("value"), F.count("*").alias("samples_used"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"))


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label), s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS s FROM embeddings e, c)
    SELECT vec_id, label, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) = 1""")
def v_nearest_label(spark, d):
    """The label whose centroid is most similar to each vector (the labels are few)."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    labels = F.broadcast(_centroids(spark, d).agg(F.collect_list(F.struct("label", "centroid")).alias("all")))
    sims = F.transform("all", lambda c: F.struct((-F.round(V.cosine(F.col("v"), c["centroid"]), 9)).alias("minus"), c["label"].alias("label")))
    best = e.join(labels).select("vec_id", F.array_min(sims).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("label"), F.round(-F.col("b.minus"), 6).alias("similarity"))


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2),
    n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS len FROM m), u AS (SELECT label, pos, x / len AS x FROM n), c AS (SELECT label, pos, x - avg(x) OVER (PARTITION BY pos) AS x FROM u)
    SELECT label, round(sqrt(sum(x * x)), 6) AS length FROM c GROUP BY label""")
def v_centred(spark, d):
    """Unit centroids less their common mean, by their remaining length."""
    u = _centroids(spark, d).select("label", F.posexplode(V.unit(F.col("centroid"))).alias("pos", "x"))
    return u.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("pos"))).groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


_nv8 = "SELECT DISTINCT id, vector FROM novel_vector WHERE vector IS NOT NULL"


@query(f"""WITH a AS ({_nv8}), g AS (SELECT a.id, vector, trim(split_part(genre, ',', 1)) AS label FROM a JOIN (SELECT DISTINCT id, genre FROM novel) USING (id) WHERE trim(split_part(genre, ',', 1)) IN ({', '.join(map(q, W.GENRE_PRIORITY))})),
    p AS (SELECT label, generate_subscripts(vector, 1) AS pos, unnest(vector) AS x FROM g), m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
    s AS (SELECT a.id, c.label, round(list_cosine_similarity(a.vector, c.c), 9) AS s FROM a, c) SELECT id, label, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, label) = 1""")
def v_archetype(spark, d):
    """For every novel the genre profile (mean style of the novels of a genre) that it is nearest to."""
    own = _t(spark, d, "novel_vector").where(F.col("vector").isNotNull()).select("id", "vector").dropDuplicates(["id"])
    nv = novels(spark, d).select("id", F.trim(F.split("genre", ",")[0]).alias("label")).where(F.col("label").isin(W.GENRE_PRIORITY))
    p = own.join(nv, "id").select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    profiles = p.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("all"))
    sims = F.transform("all", lambda c: F.struct((-F.round(V.cosine(F.col("vector"), c["c"]), 9)).alias("minus"), c["label"].alias("label")))
    best = own.join(F.broadcast(profiles)).select("id", F.array_min(sims).alias("b"))
    return best.select("id", F.col("b.label").alias("label"), F.round(-F.col("b.minus"), 6).alias("similarity"))


@query(f"""WITH a AS ({_nv8}), n AS (SELECT id, list_transform(vector, lambda x: least(greatest((x - 0.2) / 0.6, 0.0), 1.0)) AS v FROM a)
    SELECT id, round(list_avg(v), 9) AS mean, round(1 / (1 + exp(-5.5 * v[1])), 9) AS sigmoid, round(exp(v[1] * 8) / (exp(v[1] * 8) + exp(v[2] * 8)), 9) AS first_of_two, round(least(greatest((v[3] - 0.1) / 0.5, 0.0), 1.0), 9) AS ramp,
    CAST(least(greatest(round_even(round(100 - abs(v[4] - v[5]) * 200, 6), 0), 0), 100) AS INT) AS match_percent FROM n""")
def v_normalised(spark, d):
    """Scaled style values and the curves over them."""
    v = F.col("v")
    own = _t(spark, d, "novel_vector").where(F.col("vector").isNotNull()).select("id", F.transform("vector", lambda x: V.min_max(x, 0.2, 0.8)).alias("v")).distinct()
    return own.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 9).alias("mean"), F.round(V.sigmoid(v[0]), 9).alias("sigmoid"), F.round(V.softmax2(v[0], v[1]), 9).alias("first_of_two"),
                      F.round(V.ramp(v[2], 0.1, 0.5), 9).alias("ramp"), V.match_percent(v[3] - v[4], 200).alias("match_percent"))


# --- Similar works ----------------------------------------------------------------------------------------------------------------------------

_WORKS = """n AS (SELECT DISTINCT * FROM novel), w AS (SELECT n.id, title, list_filter(list_transform(string_split(lower(coalesce(genre, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS g,
    list_distinct(list_filter(list_transform(string_split(lower(coalesce(tags, '')), ','), lambda x: trim(x)), lambda x: x <> '')) AS t, coalesce(lower(territory), 'unknown') AS terr,
    coalesce(v.vector, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) AS s, CASE WHEN v.concept IS NULL OR len(list_filter(v.concept, lambda x: isnan(x) OR x IS NULL)) > 0 THEN NULL ELSE CAST(v.concept AS DOUBLE[]) END AS c
    FROM n LEFT JOIN (SELECT DISTINCT ON (id) id, vector, concept FROM novel_vector) v ON v.id = n.id), x AS (SELECT *, sqrt(list_sum(list_transform(s, lambda y: y * y))) AS ns, sqrt(coalesce(list_sum(list_transform(c, lambda y: y * y)), 0)) AS nc,
    coalesce(g[1], '') AS p, list_distinct(g) AS gs FROM w), pr AS (SELECT a.id, b.id AS match, a.title AS title_a, b.title AS title_b, a.p AS ap, b.p AS bp, a.gs AS ag, b.gs AS bg, a.t AS tags_a, b.t AS tags_b, a.terr AS ar, b.terr AS br,
    list_dot_product(a.s, b.s) / (a.ns * b.ns + 1e-9) AS cos8, list_avg(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]))) AS l1,
    CASE WHEN a.nc > 1e-9 AND b.nc > 1e-9 THEN least(greatest(list_dot_product(a.c, b.c) / (a.nc * b.nc), 0.0), 1.0) ELSE 0.40 END AS sem FROM x a JOIN x b ON a.id <> b.id WHERE a.id % 20 = 0)"""
_ONLINE = """f0 AS (SELECT *, len(list_intersect(ag, bg)) AS gi, len(list_intersect(tags_a, tags_b)) AS ti FROM pr),
    f1 AS (SELECT *, gi / greatest(1, len(ag) + len(bg) - gi) AS gj, 0.6 * (CASE WHEN ap <> '' AND list_contains(bg, ap) THEN 0.5 WHEN gi > 0 THEN 0.25 ELSE 0.0 END) + 0.4 * cos8 AS rough FROM f0),
    f2 AS (SELECT *, CASE WHEN ap <> '' AND ap = bp THEN 0.85 + 0.15 * gj WHEN ap <> '' AND list_contains(bg, ap) THEN 0.60 + 0.25 * gj WHEN len(ag) > 0 AND len(bg) > 0 THEN 0.20 * gj ELSE 0.40 END AS genre
    FROM f1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(rough, 12) DESC, match) <= 40),
    f3 AS (SELECT *, CASE WHEN len(tags_a) > 0 AND len(tags_b) > 0 THEN ti / greatest(1, len(tags_a) + len(tags_b) - ti) ELSE 0.80 * genre END AS tag,
    CASE WHEN ar = 'unknown' OR br = 'unknown' THEN 0.50 WHEN ar = br THEN 1.0 WHEN contains(ar, br) OR contains(br, ar) THEN 0.60 ELSE 0.20 END AS terr FROM f2)"""
_BATCH = """f3 AS (SELECT *, CASE WHEN ap <> '' AND ap = bp THEN 0.90 ELSE 0.40 END AS genre, 0.8 * (CASE WHEN ap <> '' AND ap = bp THEN 0.90 ELSE 0.40 END) AS tag,
    CASE WHEN ar <> 'unknown' AND ar = br THEN 1.0 ELSE 0.50 END AS terr FROM pr)"""
_FINAL = """f4 AS (SELECT *, least(greatest(0.45 * sem + 0.35 * genre + 0.15 * tag + 0.05 * terr, 0.0), 1.0) AS story, least(greatest(0.5 * cos8 + 0.5 * greatest(0.0, 1.0 - 4.0 * l1), 0.0), 1.0) AS style FROM f3),
    f5 AS (SELECT *, round(least(greatest(0.85 * story + 0.15 * style, 0.01), 0.99), 4) AS score FROM f4)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, round(story, 12) DESC, match) AS rank, match, score FROM f5 QUALIFY rank <= 5"""


def _matches(spark: SparkSession, d: str, mode: str, titles: bool = False) -> DataFrame:
    works = S.work_rows(novels(spark, d), _t(spark, d, "novel_vector"))
    return S.top_matches(works, F.col("id") % 20 == 0, mode=mode, titles=titles)


@query(f"WITH {_WORKS}, {_ONLINE}, {_FINAL}")
def n_top_matches(spark, d):
    """The five most similar works of every work whose id is divisible by 20, by the online score."""
    return _matches(spark, d, "online").select("id", "rank", "match", "score")


@query(f"WITH {_WORKS}, {_BATCH}, {_FINAL}")
def n_batch_matches(spark, d):
    """The same by the batch score."""
    return _matches(spark, d, "batch").select("id", "rank", "match", "score")


_OVERLAP = """least(0.30, 0.15 * len(list_filter(list_distinct(regexp_extract_all(lower(title_b), '\\b[a-z]{4,}\\b')), lambda w: w NOT IN ('with', 'from', 'that', 'this', 'into', 'over', 'about', 'world') AND contains(lower(title_a), w))))"""
_TITLED = _ONLINE.replace("f2 AS (SELECT *,", f"f1b AS (SELECT * REPLACE (CASE WHEN coalesce(title_a, '') <> '' THEN least(greatest(0.70 * sem + {_OVERLAP}, 0.0), 1.0) ELSE sem END AS sem) FROM f1), f2 AS (SELECT *,").replace("FROM f1 QUALIFY", "FROM f1b QUALIFY")


@query(f"WITH {_WORKS}, {_TITLED}, {_FINAL}")
def n_titled_matches(spark, d):
    """The same by the online score of works that ask with their titles."""
    return _matches(spark, d, "online", titles=True).select("id", "rank", "match", "score")


_REASONS = """SELECT id, match, rank, CASE WHEN len(r) > 0 THEN array_to_string(r, '; ') ELSE 'Overall thematic and stylistic affinity' END AS reasons FROM (SELECT id, match, rank, list_filter([
    CASE WHEN ap <> '' AND ap = bp THEN 'Matching primary archetype: ' || bp WHEN ap <> '' AND list_contains(bg, ap) THEN 'Shared genre: ' || ap WHEN genre >= 0.60 THEN 'Strong genre overlap' END,
    CASE WHEN sem >= 0.80 THEN 'Closely aligned plot premise & themes' WHEN sem >= 0.65 THEN 'Thematic narrative overlap' END, CASE WHEN tag >= 0.60 THEN 'Overlapping narrative tropes' END,
    CASE WHEN terr >= 0.85 AND contains(br, 'classic') THEN 'Shared Classic Literature tradition' WHEN terr >= 0.85 AND contains(br, 'web') THEN 'Shared Web Novel territory' END,
    CASE WHEN style >= 0.88 THEN 'Similar prose style & sentence structure' WHEN style >= 0.75 THEN 'Comparable sentence cadence' END], lambda x: x IS NOT NULL) AS r
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, round(story, 12) DESC, match) AS rank FROM f5 QUALIFY rank <= 5))"""


@query(f"WITH {_WORKS}, {_ONLINE}, {_FINAL[: _FINAL.index('SELECT id, row_number')]} {_REASONS}")
def n_explained(spark, d):
    """Reasons of the matches, story before style."""
    m = _matches(spark, d, "online")
    works = S.work_rows(novels(spark, d), _t(spark, d, "novel_vector"))
    side = lambda p: works.select(F.col("id").alias(f"{p}id"), F.coalesce(F.get("genres", F.lit(0)), F.lit("")).alias(f"{p}primary"), F.col("genres").alias(f"{p}genres"), F.col("territory").alias(f"{p}territory"))
    j = m.join(side("a_").select("a_id", "a_primary"), F.col("id") == F.col("a_id")).join(side("b_"), F.col("match") == F.col("b_id"))
    why = S.reasons({k: F.col(k) for k in ("genre", "semantic", "tag", "territory", "style")}, F.col("a_primary"), F.col("b_primary"), F.col("b_genres"), F.col("b_territory"))
    return j.select("id", "match", "rank", F.array_join(why, "; ").alias("reasons"))


# --- Star-schema shapes of the same operators --------------------------------------------------------------------------------------------------


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def r_total_by_nation(spark, d):
    """A chain of inner joins before a sum."""
    dims = _t(spark, d, "customer").select("c_custkey", "c_nationkey").join(_t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _t(spark, d, "orders").select("o_custkey", "o_totalprice").join(dims, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def r_customers_without_orders(spark, d):
    """An anti join."""
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def r_pricing_summary(spark, d):
    """A4: filtered means and sums per group."""
    li = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def r_top_orders(spark, d):
    """T5: top three per key."""
    return R.quota(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def r_daily_events(spark, d):
    """Tumbling windows over the event table (an extension: works have no event time)."""
    e = _t(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""WITH c AS (SELECT unnest(['text_en', 'text_ja', 'text_zh']) AS field_name, unnest([text_en, text_ja, text_zh]) AS t, id FROM (SELECT DISTINCT id, text_en, text_ja, text_zh FROM chapter))
    SELECT field_name, count(*) AS texts, count(DISTINCT md5(t)) AS different, sum(length(t)) AS chars FROM c WHERE t <> '' GROUP BY 1""")
def c_unpivoted(spark, d):
    """SE7, SE8: the three text columns as rows."""
    ch = _t(spark, d, "chapter").select("id", "text_en", "text_ja", "text_zh")
    long = ch.unpivot("id", ["text_en", "text_ja", "text_zh"], "field_name", "t").where("t <> ''").select("id", "field_name", F.md5("t").alias("p"), F.length("t").alias("n")).distinct()
    return long.groupBy("field_name").agg(F.count("*").alias("texts"), F.countDistinct("p").alias("different"), F.sum("n").alias("chars"))


@query("""WITH d AS (SELECT lower(trim(source)) AS source, CASE WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language, count(*) AS n FROM documents GROUP BY 1, 2)
    SELECT *, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM d""")
def c_detected_languages(spark, d):
    """C7 per source: share of documents in each script."""
    docs = _t(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source"), language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))
    return docs.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("""SELECT novel_id, count(*) AS acts, round(avg(abs(a.sentiment)), 6) AS mean_abs, max(a.sentence_range[2]) AS last_sentence FROM (SELECT novel_id, unnest(acts) AS a FROM (SELECT DISTINCT ON (novel_id) novel_id, acts FROM arc_cache)) GROUP BY novel_id""")
def c_acts(spark, d):
    """Nested acts of the arcs taken apart."""
    a = _t(spark, d, "arc_cache").select("novel_id", "acts").dropDuplicates(["novel_id"]).select("novel_id", F.explode("acts").alias("a"))
    return a.groupBy("novel_id").agg(F.count("*").alias("acts"), F.round(F.avg(F.abs("a.sentiment")), 6).alias("mean_abs"), F.max(F.col("a.sentence_range")[1]).alias("last_sentence"))


# --- Explanations and profiles ------------------------------------------------------------------------------------------------------------------


@query()
def n_explained_full(spark, d):
    """Comparisons, badges, tropes and pillars of the matches."""
    from ..operators import explain as X

    m = _matches(spark, d, "online")
    nv = novels(spark, d).dropDuplicates(["id"])
    vec = _t(spark, d, "novel_vector").dropDuplicates(["id"]).select("id", "vector")
    side = lambda p: nv.join(vec, "id", "left").select(F.col("id").alias(f"{p}id"), F.concat_ws(" ", "title", "genre", "tags").alias(f"{p}text"), F.coalesce("vector", F.array_repeat(F.lit(0.5), 8)).alias(f"{p}v"), split_list(F.lower("tags")).alias(f"{p}tags"))
    j = m.join(side("a_"), F.col("id") == F.col("a_id")).join(side("b_"), F.col("match") == F.col("b_id"))
    vals = {p: {k: X.metric_value(k, None, F.col(f"{p}v")) for k in X.COMPARED} for p in ("a_", "b_")}
    story = {p: {k: X.story_part(F.col(f"{p}text"), k) for k in X.STORY} | vals[p] for p in ("a_", "b_")}
    trope = F.get(X.shared_tropes(F.col("a_tags"), F.col("b_tags")), F.lit(0))
    same = F.when(F.col("genre") >= 0.85, "Same genre")
    return j.select("id", "match", "rank", F.to_json(X.comparisons(vals["a_"], vals["b_"])).alias("comparisons"), F.to_json(X.badges(same, trope, vals["a_"], vals["b_"], F.col("score"))).alias("badges"),
                    F.to_json(X.pillars({"semantic": F.col("semantic"), "style": F.col("style")}, story["a_"], story["b_"])).alias("pillars"))


@query(f"""WITH {NV} SELECT id, CASE WHEN x = '' THEN 'fiction' ELSE x END AS concept FROM (SELECT id, concat_ws('. ', CASE WHEN trim(title) NOT IN ('', 'Unknown Title') THEN trim(title) END, 'Genre: ' || nullif(trim(genre), ''),
    'Tropes: ' || nullif(trim(tags), ''), 'Tradition: ' || nullif(trim(territory), '')) AS x FROM nv)""")
def n_concept_text(spark, d):
    """The text that stands for a work's concept."""
    from ..functions.embed import concept_text

    none = F.lit(None).cast("string")
    return novels(spark, d).select("id", concept_text(F.col("title"), none, F.col("genre"), none, none, F.col("tags"), F.col("territory")).alias("concept"))


@query(f"""WITH {NV} SELECT id, least(0.30, 0.15 * len(list_filter(list_distinct(regexp_extract_all(lower(title), '\\b[a-z]{{4,}}\\b')), lambda w: w NOT IN ('with', 'from', 'that', 'this', 'into', 'over', 'about', 'world')
    AND contains('the quiet lantern and the broken mirror', w)))) AS overlap FROM nv""".replace("\\\\", "\\"))
def n_title_overlap(spark, d):
    """Overlap of every title with a query."""
    from ..operators.explain import title_overlap

    return novels(spark, d).select("id", title_overlap(F.col("title"), F.lit("The Quiet Lantern and the Broken Mirror")).cast("double").alias("overlap"))


@query()
def v_prose_profiles(spark, d):
    """A13, C17, M11, U3, PL4: prose vectors of English chapters by source as profiles, with the number of texts used."""
    from .pipelines import profiles

    ch = _t(spark, d, "chapter").where("text_en <> ''").select("id", "novel_id", "text_en")
    nv = novels(spark, d).select(F.col("id").alias("novel_id"), F.lower(F.trim("source")).alias("source"))
    out = profiles(ch.join(nv, "novel_id"), "source", "text_en", 200, ["gutenberg", "royalroad", "scribblehub", "syosetu", "cnnovel", "fanglot"])
    return out.select("label", "samples_used", F.round(V.norm(F.col("centroid")), 6).alias("length"))


@query("""WITH c AS (SELECT DISTINCT id, text_en AS t FROM chapter WHERE text_en <> ''), s AS (SELECT * FROM c ORDER BY md5(id || ':42'), id LIMIT 5),
    m AS (SELECT avg(len(list_distinct(w)) / len(w)) AS ttr, count(*) AS chapters FROM (SELECT regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') AS w FROM s))
    SELECT chapters, """.replace("\\\\", "\\") + V.percentile_sql("ttr", "round(ttr, 9)") + " AS ttr FROM m")
def f_radar_baseline(spark, d):
    """Percentile of the mean vocabulary richness of five sampled chapters (the sampled texts are short, so one window each)."""
    from ..functions.metrics import type_token_ratio
    from ..functions.text import words

    ch = _t(spark, d, "chapter").where("text_en <> ''").select("id", F.col("text_en").alias("t"))
    few = R.seeded_sample(ch.select("id").distinct(), "id", 5, 42)
    own = ch.join(F.broadcast(few), "id", "left_semi").dropDuplicates(["id"]).select(type_token_ratio(words(F.col("t"))).alias("x"))
    return own.agg(F.count("*").alias("chapters"), F.round(F.avg("x"), 9).alias("m")).select("chapters", V.percentile("ttr", F.col("m")).alias("ttr"))


@query("""SELECT benchmark AS chip, count(*) AS n FROM (SELECT CASE WHEN v >= 0.65 THEN 'High +' || CAST(round_even((v - 0.5) * 100, 0) AS INT) WHEN v <= 0.35 THEN 'Low' ELSE 'Balanced' END AS benchmark
    FROM (SELECT DISTINCT id, round(vector[6], 2) AS v FROM novel_vector WHERE vector IS NOT NULL)) GROUP BY 1""")
def f_chips(spark, d):
    """P17, DS2: novels per benchmark chip of their dialogue."""
    v = _t(spark, d, "novel_vector").where(F.col("vector").isNotNull()).select("id", F.round(F.col("vector")[5], 2).alias("v")).distinct()
    return v.groupBy(C.benchmark_chip(F.col("v")).alias("chip")).agg(F.count("*").alias("n"))


@query()
def g_anchor_boosts(spark, d):
    """Boosts of genres by anchor terms in every document."""
    from ..operators.anchors import with_boosts

    return with_boosts(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.explode("boosts").alias("genre", "boost")).withColumn("boost", F.round("boost", 4))


@query()
def g_prose_genres(spark, d):
    """World, plot and label of every English chapter by prose vectors against the profiles of some sources' genres."""
    from ..functions.embed import with_prose_vector
    from ..operators.anchors import with_genre_scores
    from .pipelines import profiles

    ch = _t(spark, d, "chapter").where("text_en <> ''").select("id", "novel_id", "text_en").dropDuplicates(["id"])
    nv = novels(spark, d).select(F.col("id").alias("novel_id"), F.trim(F.split("genre", ",")[0]).alias("genre")).where(F.col("genre").isin(W.GENRE_PRIORITY))
    rows = profiles(ch.join(nv, "novel_id"), "genre", "text_en", None).select("label", "centroid").orderBy("label").collect()
    out = with_genre_scores(with_prose_vector(ch, "text_en"), "text_en", "vector", [(r[0], r[1]) for r in rows])
    return out.select("id", "world", "plot", "label", F.get("genre_scores", F.lit(0))["score"].alias("score"))
