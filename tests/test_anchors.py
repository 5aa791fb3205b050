from fabula.operators.anchors import with_boosts, with_genre_scores


def boosts(spark, text):
    return with_boosts(spark.createDataFrame([(text,)], "t string"), "t").first()["boosts"]


def test_boosts(spark):
    b = boosts(spark, "Inspector Holmes, the detective, solved the crime. A mystery of crime.")
    assert b["Mystery"] == 0.40 and b["Romance"] == -0.45 and b["Supernatural"] == -0.45 and b["Action / Adventure"] == 0.15
    b = boosts(spark, "Her husband and his wife spoke of marriage.")
    assert abs(b["Romance"] - 0.20) < 1e-9 and b["Horror"] == -0.45
    b = boosts(spark, "Dread and terror: the vampire rose in the gothic crypt.")
    assert b["Horror"] > 0.35 and b["Supernatural"] == 0.15 and b["Romance"] == -0.35
    b = boosts(spark, "Reincarnated as a wizard with a dragon, she was summoned.")
    assert b["Historical"] == -0.35 and b["Isekai"] > 0.30
    b = boosts(spark, "A sonnet and a ballad.")
    assert b["Poetry"] == 0.35 and b["Drama"] == 0.25
    assert boosts(spark, None) == {"Horror": -0.45} == boosts(spark, "")


def test_genre_scores(spark):
    profiles = [("Mystery", [1.0, 0.0, 0.0]), ("Cultivation", [0.0, 1.0, 0.0]), ("Historical", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([("nothing", [1.0, 0.1, 0.0]), ("The emperor, the general and their army laid siege.", [0.0, 1.0, 0.2]), ("The emperor, the general and their army; dantian breakthrough.", [0.0, 1.0, 0.2]), (None, None)], "t string, v array<double>")
    rows = with_genre_scores(df, "t", "v", profiles).collect()
    for r in rows:
        s = [x["score"] for x in r["genre_scores"]]
        assert s == sorted(s, reverse=True) and len(s) == 3 and all(0.01 <= x <= 0.99 for x in s)
    assert rows[0]["world"] == "Mystery" and "Military Epic" in rows[1]["label"] and rows[2]["plot"] == "Historical / Military" and rows[3]["world"] == "Mystery"
