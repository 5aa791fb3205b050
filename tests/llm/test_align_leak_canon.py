import random

import numpy as np

from pyspark.sql import functions as F

from fabula.llm.align import Reader, align, kana_sound, kanji_number, latin_sound, learn, pack
from fabula.llm.canon import canonical, former, reading_classes, same_reading
from fabula.llm.leak import Pattern, Shard, allowed, best_place, leaks, terms, tokens


def test_sounds_and_numbers():
    for kana, name in (("ロゼウィム", "Lozewimh"), ("ゼソシル", "Zesoshil"), ("ヴァロヨン", "Valoyon"), ("ジュベドン", "Jubedon"), ("カテ", "Kate"), ("タロン", "Talon")):
        assert kana_sound(kana) == latin_sound(name), (kana, name)
    assert [kanji_number(x) for x in ("三百二十九", "十三", "百五", "二千", "三", "〇八")] == ["329", "13", "105", "2000", "3", "08"]


def test_alignment(spark):
    ja = "第3話　灯籠\nロゼウィムは北門で灯籠を売った。\nピドテスは379歩の所で鏡を買った。\nタバスはヨヴァに42の恩を借りていた。残り17日。\n"
    en = "Chapter 3: The Lantern\n\nTabas owed Yova 42 favours. 17 days were left.\n[TL note: nothing.]\nロゼウィムは北門で灯籠を売った。\nLozewimh sold the lantern at the north gate. Pidotes bought the mirror 379 steps away.\n"
    df = spark.createDataFrame([(1, ja, en, "x"), (1, ja, en, "x"), (2, "", en, "y"), (3, None, None, "z"), (4, "***", "***", "w")], "id long, ja string, en string, score string")
    glossary = spark.createDataFrame([("lantern", "灯籠"), ("mirror", "鏡"), (None, "x"), ("y", None)], "en string, ja string")
    got = sorted({(r["id"], r["ja_line"], r["en_line"]) for r in align(df, "id", "ja", "en", glossary).collect()})
    assert got == [(1, 1, 1), (1, 2, 5), (1, 3, 5), (1, 4, 2)]
    assert align(df.limit(0), "id", "ja", "en", glossary).count() == 0


def test_loan_words_and_hiragana_are_pieces():
    (left, right), *_ = Reader([]).read(["Dランクのロゼウィムはためらった。"], ["The rank D adventurer Lozewimh hesitated."])
    assert {"ランク", "はためらった"} <= set(left[0][2]) and "ロゼウィム" not in left[0][2] and "rank" in right[0][2]


def test_every_word_of_a_piece_is_learned(spark):
    anchors = {"#11": 3.0, "Nrt": 1.5}
    words = [f"word{i}" for i in range(9)]
    read = spark.createDataFrame([(bytearray(pack([(1, anchors, ["灯籠"])], [(1, anchors, [w])])),) for w in words for _ in range(2)], "read binary")
    table = learn(read)
    assert sorted(table.of("灯籠")) == words and table.of("x") == {}


def test_one_form():
    form = former()
    same = [
        ("ガギ！？　Ａ１", "ｶﾞｷﾞ!? A1"), ("がき", "がき"), ("手​紙﻿", "⼿紙"), ("入口のロノハン", "入ロの口ノハン"), ("Lv.3", "Ⅼν.3"), ("kg", "кg"), ("a\r\nb", "a\nb"), ("了不︀", "了不"),
        ("一二八千", "ーニハチ"), ("a b", "a b"),
    ]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    for a, b in (("灯笼", "燈籠"), ("手紙。", "手紙"), ("ab", "a b"), ("がき", "かき")):
        assert form(a) != form(b), (a, b)
    assert former(False)("ﾊﾞｽ　ＡＢ") == "バス AB" and former(False)("Привет") == "Привет" and form("") == "" == form("​")
    rng = random.Random(1)
    for _ in range(300):  # splicing equals normalising the whole
        t = "".join(rng.choice("かきガｶﾞ゙゚！ａb​手⼿ é\n") for _ in range(30))
        assert form(form(t)) == form(t)


def test_same_reading(spark):
    rows = [(1, "Ａ手紙"), (2, "A⼿紙"), (3, "A手紙"), (3, "A手紙"), (4, "A手紙"), (5, "B"), (6, None), (7, ""), (8, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, t string, k1 int")
    got = sorted((r["id_a"], r["id_b"]) for r in same_reading(df, "id", ["t"]).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
    classes = {r["id"]: (r["class_id"], r["form_id"], r["forms"], r["members"], r["links"]) for r in reading_classes(df, "id", ["t"]).collect()}
    assert classes == {1: (1, 1, 3, 4, 3), 2: (1, 2, 3, 4, 3), 3: (1, 3, 3, 4, 2), 4: (1, 3, 3, 4, 2)}
    assert same_reading(df.limit(0), "id", ["t"]).count() == 0 == reading_classes(df.limit(0), "id", ["t"]).count()
    assert df.select(canonical(F.col("t"))).where("id = 1").first()[0] == "A手紙"


def test_edit_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(200):
        p, t = ([rng.choice("abcd") for _ in range(rng.randint(1, n))] for n in (70, 120))
        assert best_place(p, t) == plain(p, t)


def test_pieces_find_what_the_whole_comparison_finds():
    rng = random.Random(5)
    hits = 0
    for _ in range(400):
        p = [rng.choice("abcdefgh") for _ in range(rng.randint(6, 30))]
        t = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            q = list(p)
            for _ in range(rng.randint(0, 4)):
                q[rng.randrange(len(q))] = rng.choice("abcdefgh")
                if rng.random() < 0.4:
                    q.insert(rng.randrange(len(q)), "z")
            t = t[:20] + q + t[20:]
        limit = rng.randint(0, min(3, len(p) // 6))
        got = Pattern(p, limit).found(t, "\x1f" + "\x1f".join(t) + "\x1f")
        hits += got
        assert got == (best_place(p, t) <= limit)
    assert 50 < hits < 350


def test_candidates_are_all_above_the_threshold():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [{"item": i, "no": n, "toks": t, "bag": t, "question": []} for i in range(40) for n in range(3) for t in [[rng.choice(words) for _ in range(9)]]]
    shard = Shard(rows, {w: 1 + rng.random() for w in words}, 9.0)
    term = np.repeat(np.arange(len(shard.ids)), np.diff(shard.run[shard.term]))
    bags = [[rng.choice(words) for _ in range(20)] for _ in range(50)] + [[], ["unknown"]]
    got = set(zip(*(x.tolist() for x in shard.candidates(bags, 0.3))))
    want = set()
    for q, bag in enumerate(bags):
        own = [shard.ids[t] for t in set(bag) if t in shard.ids]
        score = np.bincount(shard.sent, shard.weight * np.isin(term, own), minlength=len(rows))
        want |= {(q, s) for s in np.flatnonzero(score >= 0.3 - 1e-6).tolist()}
    assert got == want and want
    assert terms(tokens("手紙を a", former())) == ["手紙", "紙を", "a"]


def test_leaks(spark):
    passage = ["Oba owed Tovo 12 favours and one quiet mirror.", "The golden lamp lay 30 steps from Belo, and nobody dared to move.", "Rana counted 9 soldiers while Ivo burned the letter.", "It was Rana who hid the kite in the library."]
    item = " ".join(passage) + "\nWhich of the following is true?"
    ja = "ラタバルは教室で水晶の瓶を静かに隠した。ウィレンがあと55日残っていたら、彼は呪文の巻物を手放さなかっただろう。\n本文によれば？"
    docs = [
        (1, "Nice. " + passage[0] + " " + passage[2].upper()), (2, passage[0] + " Nothing else."), (3, "Which of the following is true? Yes."), (4, passage[1].replace("golden", "silver").replace(".", "") + " " + passage[3].replace(",", "")),
        (5, "とても。ラタバルは教室で水晶の瓶を静かに隠した。"), (6, None), (7, ""), (8, "x " * 50_000 + item), (9, "Oba owed Kim 77 favours and one dusty drum. The golden lamp lay 30 steps away."),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(1, docs[0][1], 1)], "doc_id long, text string, held int")
    got = sorted({(r["doc_id"], r["item_id"]) for r in leaks(df, "doc_id", "text", spark.createDataFrame([(7, item), (8, ja), (9, None)], "item_id long, text string")).collect()})
    assert got == [(1, 7), (4, 7), (5, 8), (8, 7)]
    questions = {(r["doc_id"], r["question"]) for r in leaks(df, "doc_id", "text", spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert questions == {(1, False), (4, False), (8, True)}
    pieces = leaks(df, "doc_id", "text", spark.createDataFrame([(7, item), (8, ja), (9, None)], "item_id long, text string"), size=2, together=1)  # small pieces, each sent apart
    assert sorted({(r["doc_id"], r["item_id"]) for r in pieces.collect()}) == got
    assert allowed(["a"] * 13) == 2 and allowed(["字"] * 40) == 3 and allowed(["a"]) == 0
    assert leaks(df, "doc_id", "text", spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_firsts_of_sorted_numbers():
    from fabula.llm.align import _firsts

    for x in ([], [0], [3, 3], [0, 0, 1, 4, 4, 4, 9]):
        assert _firsts(np.array(x, np.int64)).tolist() == [i for i in range(len(x)) if i == 0 or x[i] != x[i - 1]]


def _documents(n):
    rng = random.Random(7)
    anchors = lambda: {a: 3.0 if a[0] == "#" else 1.5 for a in rng.sample(["#11", "#12", "Nrt", "Nkm", "T1", "T2"], rng.randint(0, 3))}
    side = lambda kind: [(k + 1, anchors(), rng.sample([f"{kind}{i}" for i in range(12)], rng.randint(0, 5))) for k in range(rng.randint(0, 7))]
    return [(side("p"), side("w")) for _ in range(n)]


def test_documents_of_a_lot_match_as_alone():
    import sys

    from fabula.llm.align import Lot, Table, align_lot

    table = Table([(f"p{i}", f"w{j}", 0.3 + 0.05 * i) for i in range(12) for j in (i, (i + 1) % 12)], {f"w{j}": 1.0 + j % 3 for j in range(11)})
    slot = np.full(len(table.word), -1, np.int64)
    blobs = [pack(*d) for d in _documents(300)]
    want = []
    for d, blob in enumerate(blobs):
        want += [(d, i, j, s) for i, j, s in sorted(zip(*(x.tolist() for x in align_lot(Lot([blob]), table, slot))))]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        lot = Lot(blobs)
        i, j, score = align_lot(lot, table, slot)
    finally:
        sys.setprofile(None)
    d = lot.doc[0][i]
    assert sorted(zip(d.tolist(), (i - lot.start[0][d]).tolist(), (j - lot.start[1][d]).tolist(), score.tolist())) == want and len(want) > 300
    assert calls < 30 * len(blobs)  # the work of a document is done in arrays of many


def test_mutual_best():
    from fabula.llm.align import Pairs

    rng = random.Random(8)
    for n in range(60):
        met = [(rng.randrange(5), rng.randrange(6), rng.choice([0.5, 1.0, 1.5])) for _ in range(n)]
        pairs = Pairs(5, 6, *(np.array([m[k] for m in met], np.int64) for k in (0, 1)))
        total = {}
        for i, j, w in met:
            total[i, j] = total.get((i, j), 0) + w
        score = pairs.total(np.array([m[2] for m in met], float))
        assert dict(zip(zip(pairs.i.tolist(), pairs.j.tolist()), score.tolist())) == total
        for lead in (0.0, 0.6):
            want = []
            for i, j in sorted(total):
                row, column = ([p for p in sorted(total) if p[side] == (i, j)[side]] for side in (0, 1))
                if all(max(s, key=lambda p: (total[p], -p[0], -p[1])) == (i, j) for s in (row, column)) and total[i, j] >= 1:
                    if not lead or sum(total[p] > total[i, j] - lead for p in row + column) == 2:
                        want.append((i, j))
            got = pairs.mutual(score, 1.0, lead)
            assert list(zip(pairs.i[got].tolist(), pairs.j[got].tolist())) == want


def test_a_long_document_is_counted_in_parts(spark):
    side = lambda kind, n: [(k, {f"#{100 + k}": 3.0}, [f"{kind}{x}" for x in range(n)]) for k in range(30)]
    read = spark.createDataFrame([(bytearray(pack(side("p", 200), side("w", 150))),)], "read binary")
    table = learn(read)
    assert len(table.piece) == 200 and len(table.word) == 150 and len(table.goes) == 200 * 150
