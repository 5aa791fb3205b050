import pytest
from pyspark.sql import functions as F

from fabula.functions.embed import HashingEmbedder, concept_text, embed
from fabula.operators import explain as X
from fabula.plans import pipelines as P


def test_embedder(spark):
    df = spark.createDataFrame([("a quiet lantern",), ("",), (None,), ("手紙",)], "t string")
    v = [r[0] for r in df.select(embed(F.col("t"))).collect()]
    assert [round(sum(x * x for x in y), 4) for y in v] == [1.0, 0.0, 0.0, 1.0] and len(v[0]) == 384
    assert HashingEmbedder(8)(["x y", "x y"])[0].tolist() == HashingEmbedder(8)(["x y"])[0].tolist()


def test_concept_text(spark):
    df = spark.createDataFrame([("T", None, "G", None, "p", "a, b", ""), ("Unknown Title", "", None, None, None, None, None)], "a string, b string, c string, d string, e string, f string, g string")
    assert [r[0] for r in df.select(concept_text(*[F.col(c) for c in "abcdefg"])).collect()] == ["T. Genre: G. Plot: p. Tropes: a, b", "fiction"]


def test_analyze(spark):
    row = P.analyze(spark, "The general and the emperor sent troops and cavalry. A good day! 'Yes,' he said. It was sad.").first()
    assert row["lang"] == "en" and row["en_sentence_count"] == 4 and row["guardrail"]["scenario"] == "A" and len(row["arc"]["acts"]) == 4 and sum(row["pacing"]) > 10
    for text, lang in (("", "auto"), (None, "auto"), ("x", "xx")):
        with pytest.raises(ValueError):
            P.analyze(spark, text, lang)


def test_ingest_records(spark):
    raw = spark.createDataFrame([(i, ("New - Chapter %d" % i, "A"), "text") for i in range(5)] + [(9, ("Old - Chapter 1", "B"), "text")], "arrival int, meta struct<title: string, author: string>, text string")
    novels = spark.createDataFrame([(1, "old ", "b", "s", None, None, None)], "id long, title string, author string, source string, genre string, territory string, tags string")
    n, ch = P.ingest_records(raw, "titled", novels, most=3)
    assert n.count() == 2 and ch.count() == 4 and n.where("id = 1").first()["territory"] == "Web Novel Territory"
    assert P.ingest_records(raw, "titled", novels, only_existing=True)[1].count() == 1


def test_profiles(spark):
    df = spark.createDataFrame([("a", "one two three"), ("a", "one two four"), ("b", "x")], "label string, t string")
    rows = {r["label"]: r for r in P.profiles(df, "label", "t", 10, ["a", "b", "c"]).collect()}
    assert rows["a"]["samples_used"] == 2 and rows["c"]["samples_used"] == 0 and set(rows["c"]["centroid"]) == {0.0} and len(rows["b"]["centroid"]) == 384


def test_explanations(spark):
    df = spark.createDataFrame([([0.5] * 8, [0.5] * 8, 0.7)], "a array<double>, b array<double>, s double")
    va, vb = ({m: X.metric_value(m, None, F.col(c)) for m in X.COMPARED} for c in "ab")
    r = df.select(X.comparisons(va, vb).alias("c"), X.badges(F.lit(None).cast("string"), F.lit(None).cast("string"), va, vb, F.col("s")).alias("b")).first()
    assert [x["match"] for x in r["c"]] == ["100%"] * 5 and "w/s" in r["c"][1]["query"]
    assert [x["label"] for x in r["b"]] == ["Dialogue", "Cadence", "Vocab", "Imagery"]
    far = {m: v + 100 for m, v in vb.items()} | {"sensory_body_density": vb["sensory_body_density"] - 50}
    assert [x["label"] for x in df.select(X.badges(F.lit(None).cast("string"), F.lit(None).cast("string"), va, far, F.col("s")).alias("b")).first()["b"]] == ["Affinity"]
    text = spark.createDataFrame([("Reborn in the palace, she planned war.",), (None,)], "t string")
    assert [r[0] for r in text.select(X.story_part(F.col("t"), "catalyst")).collect()] == ["Reincarnation", None]
    assert text.select(X.title_overlap(F.lit("The Quiet Lantern"), F.lit("a quiet lantern"))).first()[0] == 0.30


def test_radar_and_agnostic(spark):
    df = spark.createDataFrame([(None, 0.48, {"en_dialogue_ratio": 0.9})], "en_ttr double, ja_ttr double, n map<string, double>")
    v = df.select(X.radar(df, "n")).first()[0]
    assert v[5] == 0.9 and v[6] == 0.5 and v[0] == 0.5
    assert df.select(X.agnostic(df, "ttr")).first()[0] == 0.48


def test_genre_profiles_use_every_chapter(spark, monkeypatch):
    from fabula.plans.work_queries import g_prose_genres

    used, real = {}, P.profiles
    monkeypatch.setattr(P, "profiles", lambda *a: [used.update({r["label"]: r["samples_used"] for r in real(*a).collect()}), real(*a)][1])
    g_prose_genres(spark, "/root/testdata/sf0.01")
    assert max(used.values()) > 50


def test_a_text_with_its_matches(spark):
    from fabula.plans.pipelines import analyze

    rows = [(i, f"The Golden Lamp {i}" if i % 2 else "Quiet Harbour", ["poetry"], ["t"], "classic literature territory", [0.5] * 8, None) for i in range(20)]
    works = spark.createDataFrame(rows, "id long, title string, genres array<string>, tags array<string>, territory string, style array<double>, concept array<double>")
    r = analyze(spark, "Nobody saw the golden lamp again. It was gone! Why?\n\nThe old house stood empty for years.", works=works).first()
    assert r["lang"] == "en" and r["archetype"]["closest_trope"] and len(r["radar"]) == 8 and len(r["top_matches"]) == 5
    assert all(m["id"] % 2 == 1 for m in r["top_matches"])
    assert "top_matches" not in analyze(spark, "短い文章です。終わり。").columns
