import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabula.functions.text import split_list
from fabula.operators import arc as A
from fabula.operators import classify as C
from fabula.operators import relational as R
from fabula.operators import similarity as S
from fabula.operators.packed import finder, split_packed, unpack


def test_arc_parts(spark):
    for n, sizes in ((1, ["0-0", "0-0", "0-0", "0-0"]), (10, ["0-1", "2-4", "5-6", "7-9"]), (4, ["0-0", "1-1", "2-2", "3-3"])):
        text = " ".join(f"good day {i} here." for i in range(n))
        a = A.with_arc(spark.createDataFrame([(text,)], "t string"), "t", "en").first()["arc"]
        assert len(a["quantiles"]) == 4
        if n > 1:
            assert ["-".join(map(str, x["sentence_range"])) for x in a["acts"]] == sizes
    for text in ("", "..."):
        assert A.with_arc(spark.createDataFrame([(text,)], "t string"), "t", "en").first()["arc"]["quantiles"] == [0.0] * 4


def test_evenly(spark):
    df = spark.createDataFrame([(list(range(10)),)], "a array<int>")
    assert df.select(A.evenly(F.col("a"), 4)).first()[0] == [0, 3, 6, 9]
    assert df.select(A.evenly(F.col("a"), 20)).first()[0] == list(range(10))


@pytest.mark.parametrize("tags, genre", [
    ("litrpg, adventure", "Progression Fantasy"), ("isekai, fantasy", "Isekai"), ("cultivation, action", "Cultivation"), ("mystery", "Mystery"), ("unknown-tag-xyz", None), ("", None),
    ("Isekai", "Isekai"), ("Sea stories, Pirates -- Fiction", "Action / Adventure"), ("Humorous stories, Satire", "Comedy"), ("Horror tales, Gothic fiction", "Horror"), ("Poetry, Sonnets", "Poetry"),
    ("Historical fiction", "Historical"), ("Philosophical fiction, Ethics", "Philosophy"), ("Supernatural -- Fiction, Apparitions", "Supernatural"),
])
def test_consolidate(spark, tags, genre):
    assert spark.createDataFrame([(tags,)], "t string").select(C.consolidate(split_list(F.col("t")))).first()[0] == genre


def _rank(spark, tags, source, genre=""):
    df = spark.createDataFrame([(tags, "", source, "", genre)], "tags string, text string, source string, territory string, genre string")
    return C.rank_genres(df, "tags", "text", "source", "territory", "genre").first()


def test_rank_genres(spark):
    r = _rank(spark, "skeleton, necromancer, level up, status window, system notification, reincarnate", "syosetu")
    assert "Horror Penalty" in r["penalties"] and r["primary_genre"] in ("Fantasy", "Progression Fantasy", "Isekai")
    r = _rank(spark, "vampire, dread, terrifying, chilling, gothic fiction", "gutenberg", "Horror")
    assert "Horror" in r["genres"] and not r["penalties"]
    r = _rank(spark, "reincarnate, another world, qi, dantian, golden core, sect, cultivator", "syosetu")
    assert r["primary_genre"] == "Cultivation" and "Isekai" in r["genres"]
    assert _rank(spark, "magic, energy, sword and sorcery, elf", "syosetu")["scores"]["Cultivation"] == 0.0
    assert _rank(spark, "qi, dantian, cultivation, sect", "cnnovel")["scores"]["Cultivation"] > _rank(spark, "qi, dantian, cultivation, sect", "syosetu")["scores"]["Cultivation"]
    assert _rank(spark, None, None, None)["genres"] == ["Action / Adventure", "Fantasy"]


@pytest.mark.parametrize("text, scenario", [
    ("将军率领军队，诸侯叛乱。", "A"), ("The general and the emperor sent troops and cavalry against the rebellion.", "A"),
    ("The emperor and the general laid siege; a breakthrough in his dantian.", "B"), ("Nothing of note.", "NONE"), (None, "NONE"), ("", "NONE"),
])
def test_guardrail(spark, text, scenario):
    assert spark.createDataFrame([(text,)], "t string").select(C.guardrail(F.col("t")).alias("g")).first()["g"]["scenario"] == scenario


def test_quota_and_numbers(spark):
    df = spark.createDataFrame([(i, 1, 0 if i % 2 else i) for i in range(1, 8)] + [(9, 2, 0)], "id long, novel long, n int")
    assert R.quota(df, ["novel"], [F.col("id")], 5).where("novel = 1").count() == 5
    held = spark.createDataFrame([(1, 3)], "novel long, n2 long").withColumnRenamed("n2", "n")
    assert R.quota(df.drop("n"), ["novel"], [F.col("id")], 5, held).where("novel = 1").count() == 2
    got = {r["id"]: r["n"] for r in R.number_missing(df, "novel", "n", [F.col("id")], F.col("n") == 0).collect()}
    assert got == {1: 7, 2: 2, 3: 8, 4: 4, 5: 9, 6: 6, 7: 10, 9: 1}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "A ", "x", None), (2, "b", "y", "G")], "id long, title string, author string, genre string")
    new = spark.createDataFrame([(" a", "X", "N"), ("B", "y", "Z"), ("c", "z", "C"), ("c", "z", "C")], "title string, author string, genre string")
    rows = {r["title"].strip().lower(): (r["id"], r["genre"]) for r in R.upsert(old, new, ["title", "author"], ["genre"]).collect()}
    assert rows == {"a": (1, "N"), "b": (2, "G"), "c": (None, "C")}


def test_opening_middle_end(spark):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k, n in (("a", 1), ("b", 2), ("c", 5)) for i in range(n)], "k string, i int, t string")
    got = {r["k"]: r["t"] for r in R.opening_middle_end(df, "k", [F.col("i")], "t").collect()}
    assert got == {"a": "a0", "b": "b0\n\nb1", "c": "c0\n\nc2\n\nc4"}


FIND = finder(["Action / Adventure", "Enemies / Lovers", "Slice of Life", "litrpg"])


@pytest.mark.parametrize("text, values", [
    (None, []), ("", []), (" , ;", []), ("a", ["a"]), ("a, b;c|d/e、f，g；h｜i·j", list("abcdefghij")), ('"a, b"; c', ["a, b", "c"]), ('["x", "The \\"Last\\" Heir"]', ["x", 'The "Last" Heir']),
    ('"The ""Last"" Heir" / y', ['The "Last" Heir', "y"]), ("['a', \"it's\"]", ["a", "it's"]), ("[a] [b]", ["a", "b"]), ("[a][Action / Adventure]", ["a", "Action / Adventure"]),
    ("Drama / Action / Adventure / x", ["Drama", "Action / Adventure", "x"]), ("Enemies / Lovers/Enemies / Lovers", ["Enemies / Lovers", "Enemies / Lovers"]), ("a -- b, c", ["a -- b", "c"]),
    ("a, a", ["a", "a"]), (",a,,b,", ["a", "b"]), ('"open, b', ['"open', "b"]), ("a\\, b, c", ["a, b", "c"]), ("a\tb\nc", ["a", "b", "c"]),
])
def test_split_packed(text, values):
    assert split_packed(text, FIND) == values


def test_packed_round_trip():
    rng = random.Random(1)
    words = ["Action / Adventure", "slow burn", "Tea, with Ghosts", 'The "Last" Heir', "a|b", "x"]
    for _ in range(300):
        values = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        packed = rng.choice([", ", ";", " / ", "|"]).join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',|/"') else v for v in values)
        assert split_packed(packed, FIND) == values


def test_unpack(spark):
    df = spark.createDataFrame([(1, "a, b", None, 5), (1, "a, b", None, 5), (2, "", "litrpg", 6)], "id long, genre string, tags string, val int")
    known = spark.createDataFrame([("litrpg",), (None,)], "label string")
    rows = sorted(tuple(r) for r in unpack(df, "id", ["genre", "tags"], known).collect())
    assert rows == [(1, "genre", 1, "a", 2), (1, "genre", 2, "b", 2), (2, "tags", 1, "litrpg", 1)]
    assert unpack(df.limit(0), "id", ["genre"], known).count() == 0


def test_top_matches_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 60
    nov = spark.createDataFrame([(i, ["Fantasy", "Drama, Fantasy", None][i % 3], ["a, b", "b", None][i % 3], ["Web Novel Territory", None][i % 2]) for i in range(n)], "id long, genre string, tags string, territory string")
    vec = spark.createDataFrame([(i, rng.random(8).tolist() if i % 7 else None, rng.standard_normal(4).tolist() if i % 5 else [0.0] * 4) for i in range(n)], "id long, vector array<double>, concept array<double>")
    works = S.work_rows(nov, vec)
    whole = {(r["id"], r["rank"]): (r["match"], r["score"]) for r in S.top_matches(works, F.col("id") < 10, mode="batch").collect()}
    split = {(r["id"], r["rank"]): (r["match"], r["score"]) for r in S.top_matches(works, F.col("id") < 10, mode="batch", block=7, ask_block=3).collect()}
    assert whole == split and len(whole) == 50 and all(k[0] != v[0] for k, v in whole.items())
    online = S.top_matches(works, F.col("id") < 10, block=16).collect()
    assert len(online) == 50 and all(0 <= r[f] <= 1 for r in online for f in S.FACTORS)


def _block(n, seed, low=0.0):
    rng = np.random.default_rng(seed)
    style = np.round(rng.random((n, 8)), 1) * (low or 1)
    genres = [[["horror"], ["drama", "horror"], [], ["romance", "drama", "drama"]][i] for i in rng.integers(0, 4, n)]
    style[rng.random(n) < 0.3] = style[0]  # equal works
    return pa.table({"id": rng.permutation(n), "style": style.tolist(), "genres": pa.array(genres, pa.list_(pa.string()))})


@pytest.mark.parametrize("low", [1.0, 1e-3])
def test_rough_pool_against_brute_force(low):
    x = _block(2500, 3, low)
    q = x.slice(0, 140)
    style, genres, ids = np.array(x["style"].to_pylist()), x["genres"].to_pylist(), x["id"].to_pylist()
    want = []
    for i in range(140):
        got = []
        for j in range(2500):
            bonus = 0.5 if genres[i] and genres[i][0] in genres[j] else 0.25 if set(genres[i]) & set(genres[j]) else 0.0
            cos = style[i] @ style[j] / (np.linalg.norm(style[i]) * np.linalg.norm(style[j]) + 1e-9)
            got.append((-round(0.6 * bonus + 0.4 * cos, 12), ids[j]))
        want += [(ids[i], m) for _, m in sorted(g for g in got if g[1] != ids[i])[:40]]
    got = S.rough_pool(q, x, 40)
    assert list(zip(got["id"].to_pylist(), got["match"].to_pylist())) == want
    assert S.rough_pool(q, x.slice(0, 0), 40).num_rows == S.rough_pool(q.slice(0, 0), x, 40).num_rows == 0


def test_equal_rough_scores_go_to_the_smaller_id(spark):
    """The same values in another order: sums differ in their last bits only, which SQL rounds away."""
    rng = np.random.default_rng(5)
    values = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
    rows = [(i, "", [], [], "unknown", [0.3] * 8 if i == 0 else rng.permutation(values).tolist(), None) for i in range(60)]
    works = spark.createDataFrame(rows, "id long, title string, genres array<string>, tags array<string>, territory string, style array<double>, concept array<double>")
    for titles in (False, True):
        assert sorted(r["match"] for r in S.top_matches(works, F.col("id") == 0, pool=5, titles=titles).collect()) == [1, 2, 3, 4, 5]
