from pyspark.sql import functions as F

from fabula.llm.language import SEED, fit, label_cases, label_column, language_runs
from fabula.llm.sentences import segment_batch

PROFILE = fit()
HELD_OUT = {
    "en": "The children were playing in the garden while their mother read a letter. Nobody knew where the dog had gone.",
    "es": "Los niños jugaban en el jardín mientras su madre leía una carta. Nadie sabía adónde había ido el perro.",
    "pt": "As crianças brincavam no jardim enquanto a mãe lia uma carta. Ninguém sabia para onde o cão tinha ido.",
    "fr": "Les enfants jouaient dans le jardin pendant que leur mère lisait une lettre. Personne ne savait où était le chien.",
    "de": "Die Kinder spielten im Garten, während ihre Mutter einen Brief las. Niemand wusste, wohin der Hund gelaufen war.",
    "ja": "母が手紙を読む間、子供たちは庭で遊んでいた。犬がどこへ行ったのか誰も知らなかった。",
    "zh": "母亲读信的时候，孩子们在花园里玩耍。没有人知道狗去了哪里。",
    "ko": "어머니가 편지를 읽는 동안 아이들은 정원에서 놀고 있었다. 개가 어디로 갔는지 아무도 몰랐다.",
}


def runs(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [(r["lang"], r["seg"]) for r in language_runs(df, PROFILE).first()["runs"]]


def test_held_out_accuracy(spark):
    for lang, text in HELD_OUT.items():
        assert runs(spark, text) == [(lang, 1)], lang


def test_mixed(spark):
    text = HELD_OUT["en"] + " " + HELD_OUT["es"] + "\n\n" + HELD_OUT["ja"] + "\n" + HELD_OUT["en"]
    assert runs(spark, text) == [("en", 1), ("es", 2), ("ja", 3), ("en", 4)]


def test_headings_and_names_are_no_evidence(spark):
    assert runs(spark, "134 - NANEDO\n\n" + HELD_OUT["en"]) == [("en", 1)]
    assert runs(spark, HELD_OUT["de"] + "\n\nVANENEL SANELUL\n\n" + HELD_OUT["de"]) == [("de", 1)]
    assert runs(spark, HELD_OUT["es"].upper()) == [("es", 1)]


def test_edge_texts(spark):
    for text in (None, "", " ", "12 34", "***"):
        assert runs(spark, text) == []
    assert runs(spark, HELD_OUT["fr"] * 2000) == [("fr", 1)]


def test_labels(spark):
    want = {"en-US": "en", "English": "en", "jp": "ja", "zh-Hans": "zh", " PT-br ": "pt", "it": "it", "und": None, "": None, None: None, "unknown": None}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r[0]: r[1] for r in df.select("l", label_column(F.col("l"))).collect()} == want


def test_cases(spark):
    rows = [("d", 1, "en-GB", HELD_OUT["en"]), ("d", 2, None, HELD_OUT["en"]), ("d", 3, "fr", HELD_OUT["de"]), ("d", 4, "en", HELD_OUT["en"] + " " + HELD_OUT["de"]), ("d", 5, "xx", "")]
    got = sorted((r["rec_id"], r["seg"], r["lang"]) for r in label_cases(spark.createDataFrame(rows, "record_kind string, rec_id long, label string, text string"), PROFILE).collect())
    assert got == [(2, 1, "en"), (3, 1, "de"), (4, 1, "en"), (4, 2, "de")]


def test_fit_on_labels_ignores_wrong_ones(spark):
    rows = [(i, SEED["de"], "de" if i else "en") for i in range(5)]
    p = fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    text = next(t for _, t, _, _ in segment_batch([HELD_OUT["de"]], [False]))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r["lang"] for r in language_runs(df, p).first()["runs"]] == ["de"]


def test_segments_of_all_three_tables(spark):
    from fabula.llm.queries import p1_segments

    rows = p1_segments(spark, "/root/testdata/sf0.001").collect()
    assert {r["record_kind"] for r in rows} == {"documents", "arc_cache", "chapter"} and all(r["lang"] and r["confidence"] is not None for r in rows)
