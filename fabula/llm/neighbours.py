"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

The coarse centroids (two per root of the number of vectors, by k-means, beyond
``FLAT`` in two levels) and the codebooks are fitted on at most ``sample`` vectors,
or eight per centroid where that is more (smallest hash of the id); every vector is
indexed.  A vector lies in the cell of its nearest centroid, as the code of its
residual and with the length of what the code loses.  A query looks into its
``probes`` nearest cells; asymmetric distance tables score their codes, and all
those are reranked exactly (in double precision) whose score could, by that loss,
still reach the threshold and the k-th best of all probed cells (``spread``
standard deviations of the error of a dot product).

Queries of neighbouring cells are searched together, in blocks of about ``block``;
to a block go its queries' vectors and the codes of the cells that they probe,
sixteen bytes a vector, each code once a block.  Vectors travel once more, to the
blocks where they must be compared exactly.

Equal vectors (by 128-bit prints) are one class: one of them asks, and of each
class only the k + 1 smallest ids are indexed, which is exact because ties go to
the smaller id.  A cell larger than ``part`` is searched in parts, so no task gets
an unbounded group, and nothing but counts per group of cells reaches the driver.

Defined results: null, empty, NaN, infinite and all-zero vectors, and those whose
length isn't that of most, match nothing; repeated rows of an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3, cosine: bool = True) -> np.ndarray:
    """Centroids by Lloyd's rounds; empty ones restart at the worst-served vectors."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, best = [], []
        for lo in range(0, len(x), 8192):
            s = x[lo : lo + 8192] @ c.T
            if not cosine:
                s = 2 * s - (c * c).sum(1)
            near.append(s.argmax(1))
            best.append(s.max(1))
        near, best = np.concatenate(near), np.concatenate(best)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        live = n > 0
        c[live] = np.add.reduceat(x[order], starts[live], axis=0) / n[live, None]
        if (~live).any():
            c[~live] = x[np.argsort(best)[: int((~live).sum())]]
        if cosine:
            c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return c


#: Centroids up to which they are fitted at once.
FLAT = 2048


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids of unit vectors; many are fitted in two levels, each first-level cluster getting its share of them."""
    if k <= FLAT:
        return kmeans(x, k)
    top = kmeans(x, int(k**0.5))
    near = np.concatenate([(x[lo : lo + 8192] @ top.T).argmax(1) for lo in range(0, len(x), 8192)])
    out = [kmeans(x[near == t], max(1, round(k * float((near == t).mean()))), 8) for t in range(len(top)) if (near == t).any()]
    return np.concatenate(out)


class Index:
    """Coarse centroids with the group of neighbouring cells that each belongs to, and codebooks."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = 16, words: int = 256, together: int = 32):
        x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
        self.coarse = centroids(x, cells)
        unit = self.coarse / (np.linalg.norm(self.coarse, axis=1, keepdims=True) + 1e-12)
        self.group = (unit @ kmeans(unit, -(-len(unit) // together)).T).argmax(1).astype(np.int32)
        rest = x - self.coarse[self.nearest(x, 1)[:, 0]]
        while x.shape[1] % parts:
            parts -= 1
        self.books = np.stack([kmeans(np.ascontiguousarray(p, np.float32), words, 8, cosine=False) if len(p) > words else np.resize(p, (words, p.shape[1])).astype(np.float32) for p in np.split(rest, parts, axis=1)])

    def nearest(self, u: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of unit vectors, the nearest one first."""
        out = []
        for lo in range(0, len(u), 4096):
            s = u[lo : lo + 4096] @ self.coarse.T
            first = s.argmax(1)[:, None]
            if count > 1:
                near = np.argpartition(-s, count - 1, axis=1)[:, :count] if count < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
                at = (near == first).argmax(1)
                near[np.arange(len(s)), at] = near[:, 0]
                near[:, 0] = first[:, 0]
                first = near
            out.append(first)
        return np.concatenate(out) if out else np.zeros((0, count), np.int64)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors in their cells, and the lengths of what the codes lose."""
        rest = x - self.coarse[cell]
        m, _, w = self.books.shape
        codes, made = np.empty((len(x), m), np.uint8), np.empty_like(rest)
        for j in range(m):
            b = self.books[j]
            codes[:, j] = (2 * rest[:, j * w : (j + 1) * w] @ b.T - (b * b).sum(1)).argmax(1)
            made[:, j * w : (j + 1) * w] = b[codes[:, j]]
        return codes, np.linalg.norm(rest - made, axis=1)

    def candidates(self, u: np.ndarray, qid: np.ndarray, near: np.ndarray, cell: np.ndarray, codes: np.ndarray, lost: np.ndarray, xid: np.ndarray, k: int, least: float, spread: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) numbers of the pairs that may be among the ``k`` best of a query (unit vector, its cells) in its cells, self left out."""
        m, _, w = self.books.shape
        tables = [u[:, j * w : (j + 1) * w] @ self.books[j].T for j in range(m)]
        order = np.argsort(cell, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order))
        who = np.repeat(np.arange(len(u)), near.shape[1])
        by_cell = np.argsort(near.ravel(), kind="stable")
        sorted_near = near.ravel()[by_cell]
        floor = np.full((len(u), k), -2, np.float32)
        held = []
        for lo, hi in zip(edges, edges[1:]):
            at = order[lo:hi]
            c = cell[at[0]]
            own = who[by_cell[np.searchsorted(sorted_near, c) : np.searchsorted(sorted_near, c, side="right")]]
            if not len(own):
                continue
            score = np.repeat((u[own] @ self.coarse[c])[:, None], len(at), 1)
            for j in range(m):
                score += tables[j][own][:, codes[at, j]]
            slack = np.minimum(lost[at], spread * lost[at] / np.sqrt(u.shape[1])).astype(np.float32) + 1e-5
            score[qid[own][:, None] == xid[at][None, :]] = -4
            low = score - slack
            best = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            floor[own] = np.partition(np.concatenate([floor[own], best], axis=1), best.shape[1], axis=1)[:, best.shape[1] :]
            held.append((own, at, score + slack))
        bound = np.maximum(floor.min(1), np.float32(least - 1e-5)) if len(u) else floor[:, 0]
        for own, at, high in held:
            a, b = np.nonzero(high >= bound[own][:, None])
            if len(a):
                yield own[a], at[b]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a meeting with a table of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the usable vectors, one row per id; v as it is stored if in single precision, which halves what is shuffled, else in double."""
    kind = df.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector).cast("array<float>" if kind == "float" else "array<double>")
    size = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v")).where(~bad).where(size > 0).dropDuplicates(["id"])


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.85, probes: int = 16, sample: int = 32768, cells: int | None = None, block: int = 4096, part: int = 65536, spread: float = 5.0, queries: DataFrame | None = None) -> DataFrame:
    """(id, match, similarity, rank) of the at most ``k`` most similar other vectors with a cosine, rounded to 6 places, of at least ``least``.

    ``queries``: a table with the ids that ask (column ``key``); all by default.
    """
    spark = df.sparkSession
    rows = cut(clean(df, key, vector))
    kind = rows.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"id {kind}, match {kind}, similarity double, rank int")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim, total = common["dim"], common["count"]
    rows = rows.where(F.size("v") == dim)
    wanted_cells = cells or max(1, int(2 * total**0.5))
    picked = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max(sample, 8 * wanted_cells))
    train = np.array([r[0] for r in rows.join(F.broadcast(picked), "id", "left_semi").select("v").collect()], np.float32)
    index = spark.sparkContext.broadcast(Index(train, wanted_cells))
    n_cells = len(index.value.coarse)
    probes, take = min(probes, n_cells), k + 1

    # Classes of equal vectors, by prints: only ids and prints are shuffled.
    prints = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    classes = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    few = prints.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("rn") <= take).select("id")
    members = cut(prints.join(classes.where("n > 1"), ["h1", "h2"]).select("id", "rep"))
    askers = classes.select(F.col("rep").alias("id"))
    if queries is not None:
        wanted = queries.select(F.col(key).alias("id")).distinct()
        shared = members.join(wanted, "id", "left_semi").select(F.col("rep").alias("id"))
        askers = askers.join(wanted.unionByName(shared).distinct(), "id", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            x = _unit(_matrix(batch.column(1), dim))
            cell = own.nearest(x, 1)[:, 0]
            codes, lost = own.encode(x, cell)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(own.group[cell] if len(x) else [], pa.int32()), packed, pa.array(lost.astype(np.float32))], ["id", "cell", "grp", "code", "lost"])

    coded = cut(rows.mapInArrow(encode, f"id {kind}, cell int, grp int, code binary, lost float"))
    stored = coded.join(few, "id", "left_semi").select("id", "cell", "code", "lost")
    asking = coded.join(askers, "id", "left_semi").select("id", "grp")
    # A group of cells has one block of queries per ``block`` of them.
    counts = {r["grp"]: r["n"] for r in asking.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    sizes = {r["cell"]: r["n"] for r in stored.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > part).collect()}

    def lookup(many: dict[int, int], column: str) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in many.items() for x in p]), F.col(column)), F.lit(1)) if many else F.lit(1)

    blocks = lookup({g: -(-n // block) for g, n in counts.items() if n > block}, "grp")
    placed = cut(asking.withColumn("piece", F.pmod(F.xxhash64("id"), blocks).cast("int")).join(rows, "id"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = index.value.nearest(_unit(_matrix(batch.column(2), dim)), probes)
            seen = np.unique(np.stack([np.repeat(np.asarray(batch.column(i)), probes) for i in (0, 1)] + [near.ravel()], 1), axis=0) if batch.num_rows else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in seen.T], ["grp", "piece", "cell"])

    reached = placed.select("grp", "piece", "v").mapInArrow(probe, "grp int, piece int, cell int").distinct()
    parts = lookup({c: -(-n // part) for c, n in sizes.items()}, "cell")
    left = stored.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int")).join(reached, "cell")
    most = max([-(-n // part) for n in sizes.values()], default=1)
    right = _renewed(placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))))
    where = ["grp", "piece", "part"]

    def meet(key_values: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list = [[], []]
        if a.num_rows and b.num_rows:
            u = _unit(_matrix(b.column("v").combine_chunks(), dim))
            codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1)
            ids, own = np.asarray(b.column("id")), index.value
            x = [np.asarray(a.column(n)) for n in ("cell", "lost", "id")]
            for q, f in own.candidates(u, ids, own.nearest(u, probes), x[0], codes, x[1], x[2], take, least, spread):
                out[0].append(ids[q])
                out[1].append(x[2][f])
        one, two = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        order = np.argsort(one, kind="stable")
        first = np.flatnonzero(np.diff(one[order], prepend=one[order][:1] - 1)) if len(one) else np.zeros(0, np.int64)
        # A row per query, and one without a query of all vectors that the block must compare.
        every = np.unique(np.concatenate([one, two]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.append(first, len(one)), len(one) + len(every)).astype(np.int32)), pa.array(np.concatenate([two[order], every])))
        made = {c: pa.array(np.full(len(first) + 1, v.as_py(), np.int32)) for c, v in zip(("grp", "piece"), key_values)}
        return pa.table(made | {"id": pa.concat_arrays([pa.array(one[order][first], pa.int64()), pa.nulls(1, pa.int64())]), "matches": lists})

    pairs = cut(left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(meet, f"grp int, piece int, id {kind}, matches array<{kind}>"))
    needed = _renewed(pairs.where("id IS NULL").select("grp", "piece", F.explode("matches").alias("id")).distinct().join(rows, "id"))

    def rerank(key_values: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.asarray(b.column("id"))
        order = np.argsort(ids, kind="stable")
        x = _matrix(b.column("v").combine_chunks(), dim)
        size = np.linalg.norm(x, axis=1)
        lists = a.column("matches").combine_chunks()
        one, two = np.repeat(np.asarray(a.column("id")), np.asarray(lists.value_lengths())) if a.num_rows else np.zeros(0, np.int64), np.asarray(lists.flatten())
        p, q = (order[np.searchsorted(ids[order], side)] for side in (one, two))
        dots = [np.einsum("ij,ij->i", x[p[i : i + 200_000]], x[q[i : i + 200_000]]) for i in range(0, len(p), 200_000)]
        sims = np.round(np.concatenate(dots) / (size[p] * size[q]), 6) if dots else np.zeros(0)
        good = np.flatnonzero(sims >= least)
        good = good[np.lexsort((two[good], -sims[good], one[good]))]
        rank = np.arange(len(good)) - np.searchsorted(one[good], one[good])
        good = good[rank < take]
        return pa.table({"id": one[good], "match": two[good], "similarity": sims[good]})

    by = ["grp", "piece"]
    reps = pairs.where("id IS NOT NULL").groupBy(*by).cogroup(needed.groupBy(*by)).applyInArrow(rerank, f"id {kind}, match {kind}, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "match")
    # A class shares the matches of the one that asked, which has the class's other members among its matches and is a match of the others.
    twin = members.where("id <> rep").join(reps.select(F.col("id").alias("rep"), "match", "similarity"), "rep").select("id", "match", "similarity")
    twin = twin.unionByName(members.where("id <> rep").select("id", F.col("rep").alias("match"), F.lit(1.0).alias("similarity")))
    both = reps.unionByName(twin.where("id <> match"))
    if queries is not None:
        both = both.join(queries.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_neighbours(vectors: np.ndarray, ids: np.ndarray, ask: np.ndarray, k: int, least: float) -> set[tuple[int, int]]:
    """Brute force over all vectors, in blocks, for measuring recall: (asking id, match)."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = set()
    for lo in range(0, len(ask), 500):
        s = np.round(u[ask[lo : lo + 500]] @ u.T, 6)
        for row, i in zip(s, ask[lo : lo + 500]):
            near = np.flatnonzero(row >= least)
            near = near[near != i]
            for j in near[np.lexsort((ids[near], -row[near]))][:k]:
                out.add((int(ids[i]), int(ids[j])))
    return out
