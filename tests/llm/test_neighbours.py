import numpy as np

from fabula.llm.neighbours import exact_neighbours, neighbours


def make(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    return centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dim))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def found(df, **kw):
    return {(r["id"], r["match"]) for r in neighbours(df, "id", "v", **kw).collect()}


def test_recall_against_brute_force(spark):
    x = make(1200)
    truth = exact_neighbours(x, np.arange(len(x)), np.arange(len(x)), 5, 0.85)
    got = found(frame(spark, x))
    assert len(truth & got) >= 0.98 * len(truth) and len(got - truth) <= 0.02 * len(truth)


def test_exact_with_all_cells_and_small_blocks(spark):
    x = make(400, 1)
    truth = exact_neighbours(x, np.arange(len(x)), np.arange(len(x)), 5, 0.85)
    assert found(frame(spark, x), probes=10_000, spread=1e9, block=37, part=9) == truth


def test_copies_ties_and_bad_vectors(spark):
    x = make(60, 2)
    x[10:30] = x[5]  # a class of equal vectors
    x[40] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (100, None), (101, [float("nan")] * 16), (102, [1.0]), (103, []), (None, x[1].tolist())]
    got = found(spark.createDataFrame(rows, "id long, v array<double>"), probes=10_000, spread=1e9)
    good = [i for i in range(60) if i != 40]
    truth = {(good[a], good[b]) for a, b in exact_neighbours(x[good], np.arange(len(good)), np.arange(len(good)), 5, 0.85)}
    assert got == truth


def test_asking_ids_and_empty(spark):
    x = make(200, 3)
    df = frame(spark, x)
    some = found(df, queries=df.where("id % 20 = 0").select("id"), probes=10_000, spread=1e9)
    assert some == {p for p in found(df, probes=10_000, spread=1e9) if p[0] % 20 == 0}
    assert found(df.limit(0)) == set()


def test_centroids_in_two_levels(monkeypatch):
    from fabula.llm import neighbours as N

    x = make(900, 4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(N, "FLAT", 50)
    c = N.centroids(x, 80)
    assert 60 <= len(c) <= 100 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    assert (x @ c.T).max(1).mean() > (x @ N.kmeans(x, 8).T).max(1).mean()
