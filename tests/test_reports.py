import json

from pyspark.sql import functions as F

from fabula.functions.words import ARCHETYPE_METRICS, ARCHETYPES, CURVES
from fabula.operators import arc as A
from fabula.operators import dashboard as D
from fabula.operators.archetype import match_archetype
from fabula.operators.explain import agnostic
from fabula.operators.similarity import reasons, top_matches
from fabula.sources import catalogue


def test_archetype_of_its_own_percentiles(spark):
    def raw(metric, place):  # inverse of the curve
        d = CURVES[metric]
        x = (place - 0.05) / 0.9 * (len(d) - 1)
        i = min(int(x), len(d) - 2)
        return d[i] + (x - i) * (d[i + 1] - d[i])

    rows = [(g, *[float(raw(m, v)) for m, v in zip(ARCHETYPE_METRICS, ref)]) for g, ref in ARCHETYPES.items()]
    df = spark.createDataFrame(rows, ["g", *ARCHETYPE_METRICS])
    got = df.select("g", match_archetype({m: F.col(m) for m in ARCHETYPE_METRICS}).alias("a")).select("g", "a.*").collect()
    for r in got:
        assert r["closest_trope"] == r["g"] and r["confidence"] > 0.999 and len(r["similarities"]) == 17
        assert r["territory"] == ("Web Novel Territory" if r["g"] in ("Slice of Life", "Cultivation", "Isekai", "Progression Fantasy") else "Classic Literature Territory")
    empty = df.limit(1).select(match_archetype({"ttr": F.lit(None).cast("double")}).alias("a")).first()["a"]
    assert empty["closest_trope"] in ARCHETYPES and 0 < empty["confidence"] <= 1


def test_default_arc(spark):
    df = spark.createDataFrame([("Isekai, Action",), ("Gothic Horror",), ("Poetry",), (None,)], "g string")
    got = [r[0] for r in df.select(A.default_arc(F.col("g"))).collect()]
    assert got == [[-0.25, 0.35, 0.45, 0.20], [0.15, -0.10, -0.45, -0.30], [0.10, 0.28, 0.38, 0.18], [0.10, 0.28, 0.38, 0.18]]


def test_one_language_a_row(spark):
    df = spark.createDataFrame([(None, 0.2, 0.5), (0.1, None, 0.5), (None, None, None)], "en_ttr double, en_punc_density double, ja_ttr double")
    assert [r[0] for r in df.select(agnostic(df, "ttr")).collect()] == [None, 0.1, None]


def test_radar_and_cards(spark):
    df = spark.createDataFrame([(1, 0.4, None, {"ttr": 0.9}), (2, None, 0.6, {"ja_ttr": 0.1}), (3, None, None, None)], "id long, en_ttr double, ja_ttr double, n map<string, double>")
    raw = {r["id"]: r["v"][6] for r in df.select("id", D.radar(df, None).alias("v")).collect()}
    assert round(raw[1], 6) == round(0.1 / 0.6, 6) and round(raw[2], 6) == 0.5 and raw[3] == 0.0
    assert {r["id"]: r["v"][6] for r in df.select("id", D.radar(df, "n").alias("v")).collect()} == {1: 0.9, 2: 0.1, 3: 0.0}
    assert {(r["id"], r["category"], r["cards"]) for r in D.cards(df, "id").collect()} == {(1, "prose", 1), (2, "prose", 1)}
    assert [r[0] for r in spark.createDataFrame([([" Magic", "magic", "", "slow LIFE "],)], "t array<string>").select(D.distinct_titles(F.col("t"))).collect()] == [["Magic", "Slow Life"]]
    assert D.figures(spark.createDataFrame([], "id long, genre string, territory string")).first().asDict() == {"genres": 0, "web": 0, "classic": 0, "web_percent": 0.0, "classic_percent": 0.0}


def test_catalogue(spark, tmp_path):
    page = {"results": [{"id": 1, "title": "A", "authors": [{"name": "X"}], "subjects": ["Horror tales"]}, {"id": 2, "title": None, "authors": [], "subjects": None}, {"id": 3, "title": "C", "authors": [], "subjects": []}]}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n" + json.dumps(page) + "\nbroken\n")
    texts = spark.createDataFrame([(1, "one two  three\nfour"), (2, "few"), (3, "")], "book long, text string")
    got = sorted(tuple(r) for r in catalogue.books(catalogue.pages(spark, str(tmp_path)), texts, words=3).select("book", "series_title", "author", "text_en", "tags").collect())
    assert got == [(1, "A", "X", "one two three", "Horror tales"), (2, "Unknown Title", "Unknown Author", "few", "")]
    assert catalogue.books(catalogue.pages(spark, str(tmp_path)), texts, least=4).count() == 1
    df = spark.createDataFrame([("magic, gothic",), ("horrors",), (None,), ("",)], "tags string")
    assert [r[0] for r in df.select(catalogue.matches_genre(F.col("tags"), "Horror")).collect()] == [True, False, False, False]
    landed = spark.createDataFrame([("S", "T", "gothic"), ("S", "T", "gothic"), ("U", "V", "romance")], "series_title string, author string, tags string")
    more = spark.createDataFrame([("B", "W", "")], "series_title string, author string, tags string")
    assert [(r["series_title"], r["genre"]) for r in catalogue.top_up(landed, more, "Horror", 2).collect()] == [("S", "Horror"), ("B", "Horror")]


def _works(spark, n):
    rows = [(i, f"The Golden Lamp {i}" if i % 2 else "Quiet Harbour", ["horror"] if i % 3 else ["romance"], ["t"], "web", [0.5 + i / 1000] * 8, [1.0, i / 10]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, genres array<string>, tags array<string>, territory string, style array<double>, concept array<double>")


def test_few_candidates_are_all_scored(spark):
    few = top_matches(_works(spark, 49), F.col("id") == 1, k=48, pool=5).collect()
    assert len(few) == 48  # not cut to the pool below 51 candidates
    assert len(top_matches(_works(spark, 60), F.col("id") == 1, k=48, pool=5).collect()) == 5
    slices = top_matches(_works(spark, 300), F.lit(True), k=3, mode="batch", block=70).collect()
    alone = top_matches(_works(spark, 300), F.lit(True), k=3, mode="batch", block=1000, ask_block=40).collect()
    assert sorted(map(tuple, slices)) == sorted(map(tuple, alone)) and len(slices) == 900


def test_titles_count_towards_the_semantic_factor(spark):
    got = {r["match"]: r["semantic"] for r in top_matches(_works(spark, 6), F.col("id") == 1, titles=True).collect()}
    plain = {r["match"]: r["semantic"] for r in top_matches(_works(spark, 6), F.col("id") == 1).collect()}
    assert abs(got[3] - min(1, 0.7 * plain[3] + 0.30)) < 1e-9 and abs(got[2] - 0.7 * plain[2]) < 1e-9


def test_reasons(spark):
    df = spark.createDataFrame([(0.9, 0.85, 0.7, 1.0, 0.9, "horror", "horror", ["horror"], "web novel territory"), (0.65, 0.7, 0.1, 0.2, 0.8, "horror", "romance", ["romance", "horror"], "x"), (0.4, 0.1, 0.1, 0.2, 0.1, "", None, [], "unknown")], "genre double, semantic double, tag double, territory double, style double, a string, b string, g array<string>, t string")
    f = {k: F.col(k) for k in ("genre", "semantic", "tag", "territory", "style")}
    got = [r[0] for r in df.select(reasons(f, F.col("a"), F.col("b"), F.col("g"), F.col("t"))).collect()]
    assert got[0] == ["Matching primary archetype: horror", "Closely aligned plot premise & themes", "Overlapping narrative tropes", "Shared Web Novel territory", "Similar prose style & sentence structure"]
    assert got[1] == ["Shared genre: horror", "Thematic narrative overlap", "Comparable sentence cadence"]
    assert got[2] == ["Overall thematic and stylistic affinity"]
