import duckdb
from pyspark.sql import functions as F

from fabula.functions import metrics as M
from fabula.functions import text as T
from fabula.functions.vectors import cosine, match_percent, percentile, percentile_sql, pool, unit


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def test_language(spark):
    for text, lang in (("かな", "ja"), ("三国", "zh"), ("abc", "en"), ("", "en"), (None, "en")):
        assert one(spark, text, T.language(F.col("t"))) == lang


def test_words_and_marks(spark):
    assert one(spark, "café naïve 三国 don't_x", T.words(F.col("t"))) == ["café", "naïve", "三国", "don", "t_x"]
    assert one(spark, " 三　国 a", T.marks(F.col("t"))) == ["三", "国", "a"]


def test_paragraphs(spark):
    assert one(spark, "a line\nwraps here\n\nnext one\n", T.paragraphs(F.col("t"))) == ["a line\nwraps here", "next one"]
    assert one(spark, "One.\nTwo.\r\n\nThree.", T.paragraphs(F.col("t"))) == ["One.", "Two.", "Three."]
    assert one(spark, "", T.paragraphs(F.col("t"))) == []


def test_cleaning(spark):
    assert one(spark, "<p>a<br>b</p><p>c &amp; d</p>", T.clean_html(F.col("t"))) == "a\nb\n\nc & d"
    assert one(spark, "ＡＢ《るび》｜漢", T.clean_japanese(F.col("t"))) == "AB|漢"
    assert one(spark, "ＡＢ《るび》｜漢", T.clean_japanese(F.col("t"), drop_bar_first=True)) == "AB漢"
    assert one(spark, "x [TL note: y\nmore] z (T/N: w)", T.clean_english(F.col("t"))) == "x  z"
    for title, n in (("Chapter 12: X", 12), ("ch 7", 7), ("77 Y", 77), ("Prologue", None), (None, None)):
        assert one(spark, title, T.chapter_number(F.col("t"))) == n


def test_header_parts(spark):
    df = spark.createDataFrame([("77.気づき\n本文", "Chapter 77: Noticed\nBody"), ("本文だけ", "Only body")], "a string, b string")
    rows = df.select(*[v.alias(k) for k, v in T.header_parts(F.col("a"), F.col("b")).items()]).collect()
    assert tuple(rows[0]) == (77, "気づき", "Noticed", "本文", "Body")
    assert tuple(rows[1]) == (None, "Chapter ", "Chapter ", "本文だけ", "Only body")


def test_ttr_windows(spark):
    for n in (0, 500, 501, 599, 600, 1250):
        tokens = [f"w{i % 337}" for i in range(n)]
        if n == 0:
            want = 0.0
        elif n <= 500:
            want = len(set(tokens)) / n
        else:
            shares = [len(set(tokens[i : i + 500])) / 500 for i in range(0, n - 499, 100)]
            want = sum(shares) / len(shares)
        assert abs(one(spark, tokens, M.type_token_ratio(F.col("t")), "array<string>") - want) < 1e-12


def test_dialogue_and_body(spark):
    assert one(spark, '"a b" c', M.dialogue_ratio(F.col("t"), "en")) == 2 / 3
    assert one(spark, "「あい」う", M.dialogue_ratio(F.col("t"), "ja")) == 2 / 5
    assert one(spark, "plain", M.body_share(F.col("t"), "en")) == 0.35
    assert one(spark, "trembling hands", M.body_share(F.col("t"), "en")) == 1.0


def test_features_of_empty_and_null(spark):
    df = M.with_features(spark.createDataFrame([("",), (None,), ("One. Two!",)], "t string"), "t")
    rows = df.select("en_sentence_count", "ja_char_count").collect()
    assert [r[0] for r in rows] == [None, None, 2.0] and all(r[1] is None for r in rows)


def test_percentile(spark):
    p = lambda v, k="ttr": one(spark, v, percentile(k, F.col("t")), "double")
    assert p(None) == 0.5 and p(float("nan")) == 0.5 and p(0.3, "nothing") == 0.5
    assert p(0.0) == 0.05 and p(9.0) == 0.95 and p(0.48, "en_ttr") == 0.5


def test_percentile_at_a_half_as_in_sql(spark):
    values = [(round(k / n, 9),) for n in (23, 48, 72) for k in range(n + 1)]
    got = spark.createDataFrame(values, "x double").select("x", percentile("kanji_ratio", F.col("x"))).collect()
    sql = dict(duckdb.execute(f"SELECT x, {percentile_sql('kanji_ratio', 'x')} FROM (SELECT unnest(?) AS x)", [[v for v, in values]]).fetchall())
    assert {r[0]: r[1] for r in got} == sql and sql[0.319444444] == 0.4988


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<double>, z array<double>, b array<double>")
    r = df.select(unit(F.col("a")), unit(F.col("z")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("b")), pool([F.col("a"), F.col("b")], [0.5, 0.25]), match_percent(F.lit(0.3), 200)).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0.0 and abs(r[3] - 0.96) < 1e-12 and r[4] == [2.5, 2.75] and r[5] == 40


def test_sample_words(spark):
    assert one(spark, "word " * 500, T.sample_words(F.col("t"), 10)) == " ".join(["word"] * 10)
    long = "TOC Preface\n\n" * 100 + "\n\n" + "the story goes on and on and on here today\n\n" * 600
    got = one(spark, long, T.sample_words(F.col("t"), 30))
    assert "story" in got and "Preface" not in got.split("\n\n")[1]
