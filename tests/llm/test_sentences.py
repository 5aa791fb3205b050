import pytest

from fabula.llm.sentences import SEED, segment_batch, sentence_spans


def cut(text, every=False):
    return [t[a:b] for _, t, spans, _ in segment_batch([text], [every]) for a, b in spans]


@pytest.mark.parametrize("text, parts", [
    ("He left. She stayed!", ["He left.", "She stayed!"]),
    ("Dr. Amun paid 12.5 crowns. K. S. Oba, i.e. the clerk, waited.", ["Dr. Amun paid 12.5 crowns.", "K. S. Oba, i.e. the clerk, waited."]),
    ("They came at 9 a.m. Neither spoke.", ["They came at 9 a.m.", "Neither spoke."]),
    ("At 4 p.m. on Monday he left... then came back. Lamps... Nobody.", ["At 4 p.m. on Monday he left... then came back.", "Lamps...", "Nobody."]),
    ('"Wait. Stop!" Oba shouted. "Run!" The end.', ['"Wait. Stop!" Oba shouted.', '"Run!"', "The end."]),
    ("library.\"Is it yours?\" asked Oba.K. M. Belo left.", ["library.", '"Is it yours?" asked Oba.', "K. M. Belo left."]),
    ("“Did he say ‘never again’ about it?” Oba wondered. Done.", ["“Did he say ‘never again’ about it?” Oba wondered.", "Done."]),
    ("—¿Dónde está? —preguntó Oba. Fin.", ["—¿Dónde está? —preguntó Oba.", "Fin."]),
    ("« Où est-il ? » demanda Oba. Fin.", ["« Où est-il ? » demanda Oba.", "Fin."]),
    ("„Wem gehört das?“, fragte Oba. Ende.", ["„Wem gehört das?”, fragte Oba.", "Ende."]),
    ("Chapter 3: The Lamp\nHe walked on\nand on. ***\n\n***\n\nNew part", ["Chapter 3: The Lamp", "He walked on\nand on.", "New part"]),
    ("(He never said it.) Next.", ["(He never said it.)", "Next."]),
    ("No. 4 on the list was Belo (the one who left). Yes.", ["No. 4 on the list was Belo (the one who left).", "Yes."]),
    (None, []), ("", []), (" \n\t", []), ("***\n◇", []),
])
def test_spaced(text, parts):
    assert cut(text) == parts


@pytest.mark.parametrize("text, parts", [
    ("雨だ。「待て。動くな。」と彼は言った。次。", ["雨だ。", "「待て。動くな。」と彼は言った。", "次。"]),
    ("彼はためらい……そして出た。見つめるしかなかった……。次", ["彼はためらい……そして出た。", "見つめるしかなかった……。", "次"]),
    ("第3話　題\n本文だ\n次", ["第3話　題", "本文だ", "次"]),
    ("“你的吗？”老人问。“等等。别动。”据说他走了。", ["“你的吗？”老人问。", "“等等。别动。”", "据说他走了。"]),
    ("名单上是他（就是那个人）。（他不认。）好！", ["名单上是他（就是那个人）。", "（他不认。）", "好！"]),
    ("「開いたまま。\n次。", ["「開いたまま。", "次。"]),
])
def test_unspaced(text, parts):
    assert cut(text, True) == parts


def test_seed_sentences_joined_in_pairs():
    lines = [x for x in SEED.split("\n") if x.isascii()]
    wrong = sum(cut(a + " " + b) != [a, b] for a in lines for b in lines)
    assert wrong <= 0.02 * len(lines) ** 2


def test_positions_of_stored_text(spark):
    df = spark.createDataFrame([(1, "​ あ​い。 う", "A b. C", 3), (1, "​ あ​い。 う", "A b. C", 3), (2, None, "", 4)], "id long, ja string, en string, start_pos int")
    rows = sorted(tuple(r) for r in sentence_spans(df, "id", {"ja": True, "en": False}).collect())
    assert rows == [(1, "en", 1, 4), (1, "en", 6, 6), (1, "ja", 3, 6), (1, "ja", 8, 8)]
    assert sentence_spans(df.limit(0), "id", {"ja": True}).count() == 0


def test_very_long_text():
    assert len(cut("It was a day. " * 30_000)) == 30_000


def test_stripped_text():
    import random

    from fabula.llm.sentences import StrippedModel

    rng = random.Random(1)
    who, what, how = ["老人", "船長", "番兵", "旅人"], ["灯籠", "手紙", "鏡", "地図"], ["を売った", "を買った", "を隠した", "を見つけた"]
    make = lambda: rng.choice(who) + "は" + rng.choice(["井戸のそば", "北門", "市場"]) + "で" + rng.choice(what) + rng.choice(how) + "。"
    model = StrippedModel(make() for _ in range(400))
    right = total = extra = 0
    for _ in range(60):
        lines = [model.strip(make()) for _ in range(5)]
        ends, at = set(), 0
        for s in lines:
            at += len(s)
            ends.add(at)
        got = {b for _, b in model.cut("".join(lines))}
        right, total, extra = right + len(got & ends), total + len(ends), extra + len(got - ends)
    assert right >= 0.98 * total and extra <= 0.02 * total
    assert model.cut("") == [] and model.cut(" ") == [] and StrippedModel([]).cut("ab") == [(0, 2)]


def test_unpunctuated_lines_are_cut_by_the_stripped_model(spark):
    import random

    from fabula.llm.sentences import fit_stripped

    rng = random.Random(2)
    make = lambda: rng.choice(["老人", "船長", "番兵", "旅人"]) + "は" + rng.choice(["北門", "市場"]) + "で" + rng.choice(["灯籠", "手紙", "鏡"]) + rng.choice(["を売った", "を買った", "を隠した"])
    rows = [(i, "。".join(make() for _ in range(8)) + "。") for i in range(100)]
    lines = [[make() for _ in range(6)] for _ in range(20)]
    rows += [(200 + i, "".join(x)) for i, x in enumerate(lines)] + [(300, make())]
    df = spark.createDataFrame(rows, "id long, ja string")
    got: dict = {}
    for r in sentence_spans(df, "id", {"ja": True}, fit_stripped(df, "id", ["ja"])).collect():
        got.setdefault(r["id"], []).append((r["start_pos"], r["end_pos"]))
    right = 0
    for i, x in enumerate(lines):
        ends, at = set(), 0
        for s in x:
            at += len(s)
            ends.add(at)
        right += len({b for _, b in got[200 + i]} & ends)
    assert right >= 0.95 * 120 and len(got[300]) == 1 and all(len(got[i]) == 8 for i in range(100))
    assert fit_stripped(df.limit(0), "id", ["ja"]) == {}
