import numpy as np
from pyspark.sql import functions as F

from fabula.llm import abuse as B
from fabula.llm.mix import apportion, play, report, schedule, token_counts


def sized(spark, n=3000):
    rows = [(i, " Big " if i % 3 else ("small" if i % 2 else "MID"), 5 + i % 17) for i in range(n)]
    return spark.createDataFrame(rows + rows[:50] + [(n + 1, "big", 0), (n + 2, "other", 9), (n + 3, None, 9)], "doc_id long, source string, tokens long")


def test_shares_and_deviation(spark):
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("Mid ", 0.2, 3), ("none", 0.0, 3), ("ghost", None, 1)], "source string, weight double, max_repeat int")
    rep = {r["source"]: r for r in report(sized(spark), goal, block=64).collect()}
    assert set(rep) == {"big", "small", "mid"}
    for r in rep.values():
        assert abs(r["reached_share"] - r["target_share"]) < 0.005 and r["most_repeats"] <= r["max_repeat"] and r["worst_deviation_blocks"] < 1
    # one source uses all its passes, which ends the mixture
    assert any(abs(r["taken_tokens"] - r["source_tokens"] * r["max_repeat"]) < 64 for r in rep.values())


def test_play_is_earliest_deadline_first_within_windows():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.03}, {"a": 1.0}, {"a": 0.1, "b": 0.15, "c": 0.33, "d": 0.42}):
        n = 1000
        slots = apportion(weights, n)
        got = play(slots, n)
        assert sum(slots.values()) == n and sorted(t for own in got.values() for t in own) == list(range(n))
        owner = {t: s for s, own in got.items() for t in own}
        done = dict.fromkeys(slots, 0)
        for s, own in got.items():
            for i, t in enumerate(own):
                assert i * n // slots[s] <= t < -(-(i + 1) * n // slots[s])
        for t in range(n):
            done[owner[t]] += 1
            assert all(abs(done[s] - slots[s] * (t + 1) / n) < 1 for s in slots)


def test_schedule_against_a_plain_layout(spark):
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, weight double, max_repeat int")
    df = sized(spark, 600).withColumn("tokens", F.when(F.col("doc_id") == 7, 500).otherwise(F.col("tokens")))  # one document longer than several blocks
    rows = [r.asDict() for r in schedule(df, goal, block=32).collect()]
    size = {r["doc_id"]: r["tokens"] for r in df.collect()}
    assert len({(r["doc_id"], r["pass"], r["part"]) for r in rows}) == len(rows)
    whole: dict = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["pass"]), []).append(r)
        assert r["release"] <= r["slot"] < r["deadline"]
    for (doc, _), parts in whole.items():
        parts.sort(key=lambda r: r["part"])
        assert sum(r["tokens"] for r in parts) == size[doc] and [r["part"] for r in parts] == list(range(1, len(parts) + 1))
    blocks: dict = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["offset"])):
        filled = blocks.setdefault((r["slot"], r["source"]), [0])
        assert r["offset"] == filled[0]  # parts fill their block without gaps
        filled[0] += r["tokens"]
    assert len(blocks) == len({s for s, _ in blocks})  # a slot has one source
    last = {s: max(t for t, x in blocks if x == s) for s in ("big", "small")}
    assert all(v[0] == 32 for (t, s), v in blocks.items() if t != last[s])
    order = [s for _, s in sorted(blocks)]
    for k in range(1, min(last.values())):
        assert abs(order[:k].count("big") - 0.6 * k) < 1


def test_pieces_of_a_source_add_up(spark):
    from fabula.llm import mix

    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, weight double, max_repeat int")
    want = sorted(map(tuple, schedule(sized(spark, 900), goal, block=32).collect()))
    kept, mix.PIECE = mix.PIECE, 20
    try:
        assert sorted(map(tuple, schedule(sized(spark, 900), goal, block=32).collect())) == want
    finally:
        mix.PIECE = kept
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    assert schedule(none, goal).count() == 0 and report(none, goal).count() == 0


def test_tokens(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 100_000)], "id long, t string")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "t", str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    trees = B.boost(x, y, np.ones(len(x)), rounds=30)
    assert ((B.predict(trees, x) > 0) == y).mean() > 0.99
    s, p = B.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert list(p) == sorted(p) and p[0] == 0 and abs(p[-1] - 2 / 3) < 1e-9 and s[-1] == 4.0


def test_words():
    w = B.Words({"fucking", "worthless", "between"})
    assert w.of("f*cking W O R T H L E S S betweeeeen sh1t 12th") == (["fucking", "worthless", "between", "shit", "0"], 4)
    w = B.Words({"bacedifoguha" * 3})
    assert w.of("b*c*d*f*g*h*" * 2 + "b*c*d*f*g*ha")[0] == ["bacedifoguha" * 3]  # any number of masks


CALM = ["The lamp was sold at the gate by {n}.", "{n} counted twelve soldiers on the road.", "{n} hid the letter in the library.", "{n} drew the naked blade.", "The pacing drags after chapter three, {n}."]
BAD = {"abuse": "{n}, you worthless idiot, crawl away and rot.", "hate": "The marshfolk are vermin and should be driven into the sea, said {n}.", "sexual": "Naked and panting, {n} spread those bare thighs."}


def test_fitted_scores(spark):
    rng = np.random.default_rng(1)
    name = lambda: "N" + "".join(rng.choice(list("abcdeiouklmn"), 6))
    docs, labels = [], []
    for i in range(600):
        kinds = [k for k in BAD if rng.random() < 0.15]
        lines = [rng.choice(CALM).format(n=name()) for _ in range(6)] + [BAD[k].format(n=name()) for k in kinds]
        docs.append((i, " ".join(lines)))
        labels += [(i, k) for k in (kinds or ["none"])] if rng.random() > 0.05 else [(i, "none")]
    d = spark.createDataFrame(docs + [(1000, None), (1001, ""), (1002, "***")], "doc_id long, text string")
    model = B.fit(d, spark.createDataFrame(labels, "doc_id long, kind string"))
    got = {r["doc_id"]: r for r in B.scores(d, model, ["doc_id"]).collect()}
    assert all(got[i][k] == 0 for i in (1000, 1001, 1002) for k in B.KINDS)
    hits = {k: [0, 0, 0] for k in B.KINDS}
    for i, t in docs:
        for k, needle in (("abuse", "worthless idiot"), ("hate", "marshfolk"), ("sexual", "thighs")):
            hits[k][0] += needle in t
            hits[k][1] += (needle in t) and got[i][k] >= 0.5
            hits[k][2] += (needle not in t) and got[i][k] >= 0.5
    for k, (n, found, extra) in hits.items():
        assert found >= 0.95 * n and extra <= 0.05 * n, (k, n, found, extra)


def test_without_ratings(spark):
    d = spark.createDataFrame([(1, "You worthless idiot."), (2, "A calm day.")], "doc_id long, text string")
    model = B.fit(d, spark.createDataFrame([], "doc_id long, kind string"))
    got = {r["doc_id"]: r["abuse"] for r in B.scores(d, model, ["doc_id"]).collect()}
    assert got[1] > got[2] == 0


def test_wide_terms_after_sixty_tokens_count():
    kind, word = next((k, w) for k, v in B.LEXICON.items() for w in v.split() if ord(w[0]) >= 0x3000)
    _, _, dense = B.Sentences(set()).read(["word " * 70 + word, "a calm day"])
    assert dense[0, 6 + 3 * B.KINDS.index(kind)] >= 1 and dense[1, 6:].sum() == 0


def test_terms_are_those_of_each_sentence_alone():
    reader = B.Sentences(set())
    texts = ["You are a stupid pig, you!", "", "One two three four.", "你是猪。", "x"]
    flat, sizes, dense = reader.read(texts)
    at = 0
    for t, n, f in zip(texts, sizes, dense):
        own, m, g = reader.read([t])
        assert m[0] == n and (own == flat[at : at + n]).all() and (g[0] == f).all()
        at += n
    assert at == len(flat) and sizes[1] == 0 and dense[0][6] == 2 and dense[0][8] == 0.5 and dense[3][6] == 1


def test_sample_of_ratings():
    assert B.fit.__defaults__[-1] == 12_000
