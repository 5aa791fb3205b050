"""Most similar works by a weighted score of story and style, for a set of asking works against all works, in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_list


def work_rows(novels: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per work with what the score needs: lower-case genres (the first is the primary one), tags, territory, 8 style values, concept."""
    lower = lambda c: F.transform(split_list(F.lower(F.col(c))), lambda x: x)
    own = novels.dropDuplicates(["id"]).select("id", (F.col("title") if "title" in novels.columns else F.lit(None).cast("string")).alias("title"), lower("genre").alias("genres"), F.array_distinct(lower("tags")).alias("tags"), F.coalesce(F.lower("territory"), F.lit("unknown")).alias("territory"))
    vec = vectors.dropDuplicates(["id"]).select("id", F.col("vector").cast("array<double>").alias("style"), F.col("concept").cast("array<double>").alias("concept"))
    middle = F.array_repeat(F.lit(0.5), 8)
    bad = F.exists(F.coalesce("concept", F.array(F.lit(float("nan")))), lambda x: F.isnan(x) | x.isNull())
    return own.join(vec, "id", "left").withColumn("style", F.coalesce("style", middle)).withColumn("concept", F.when(~bad, F.col("concept")))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    if len(column) and not column.null_count and (pc.list_value_length(column).to_numpy(zero_copy_only=False) == dim).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def _sets(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    names = {t: i for i, t in enumerate(sorted({x for v in (*a, *b) for x in v}))}
    out = []
    for side in (a, b):
        m = np.zeros((len(side), max(1, len(names))))
        for i, v in enumerate(side):
            m[i, [names[x] for x in v]] = 1
        out.append(m)
    return out[0], out[1]


_COMMON_TITLE = {"with", "from", "that", "this", "into", "over", "about", "world"}


def _title_overlap(q: pa.Table, x: pa.Table) -> np.ndarray:
    """0.15 per distinct word of four letters or more of a work's title that the asking title holds, at most 0.30."""
    words = [set(re.findall(r"\b[a-z]{4,}\b", (t or "").lower())) - _COMMON_TITLE for t in x.column("title").to_pylist()]
    every = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    held = np.array([[w in t for w in every] for t in ((t or "").lower() for t in q.column("title").to_pylist())], float).reshape(q.num_rows, len(every))
    has = np.zeros((len(every), x.num_rows))
    for j, own in enumerate(words):
        has[[every[w] for w in own], j] = 1
    return np.minimum(0.30, 0.15 * (held @ has))


def block_scores(q: pa.Table, x: pa.Table, titles: bool = False) -> dict[str, np.ndarray]:
    """All factors of a block of asking works against a block of works by the batch score."""
    qs, xs = (_dense(t.column("style").combine_chunks(), 8) for t in (q, x))
    cos8 = (qs @ xs.T) / (np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(xs, axis=1)[None, :] + 1e-9)
    l1 = np.abs(qs[:, None, :] - xs[None, :, :]).mean(2)
    style = np.clip(0.5 * cos8 + 0.5 * np.maximum(0.0, 1.0 - 4.0 * l1), 0, 1)
    dim = max([len(v) for t in (q, x) for v in t.column("concept").to_pylist() if v] or [1])
    qc, xc = (_dense(t.column("concept").combine_chunks(), dim) for t in (q, x))
    nq, nx = np.linalg.norm(qc, axis=1), np.linalg.norm(xc, axis=1)
    known = (nq > 1e-9)[:, None] & (nx > 1e-9)[None, :]
    semantic = np.where(known, np.clip((qc @ xc.T) / np.where(known, nq[:, None] * nx[None, :], 1), 0, 1), 0.40)
    if titles:
        asked = np.array([bool(t) for t in q.column("title").to_pylist()])[:, None]
        semantic = np.where(asked, np.clip(0.70 * semantic + _title_overlap(q, x), 0, 1), semantic)
    qg, xg = q.column("genres").to_pylist(), x.column("genres").to_pylist()
    first = [np.array([g[0] if g else "" for g in side]) for side in (qg, xg)]
    same = (first[0][:, None] == first[1][None, :]) & (first[0] != "")[:, None]
    genre = np.where(same, 0.90, 0.40)
    tag = 0.8 * genre
    tq, tx = (np.array(t.column("territory").to_pylist()) for t in (q, x))
    named = (tq != "unknown")[:, None] & (tx != "unknown")[None, :]
    territory = np.where(named & (tq[:, None] == tx[None, :]), 1.0, 0.50)
    story = np.clip(0.45 * semantic + 0.35 * genre + 0.15 * tag + 0.05 * territory, 0, 1)
    return {"score": np.round(np.clip(0.85 * story + 0.15 * style, 0.01, 0.99), 4), "story": story, "style": style, "semantic": semantic, "genre": genre, "tag": tag, "territory": territory}


FACTORS = ["score", "story", "style", "semantic", "genre", "tag", "territory"]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in order, so that equal rows give equal bits wherever they stand."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x * y
    return out


def _half_up(v: np.ndarray, places: int) -> np.ndarray:
    return np.floor(v * 10.0**places + 0.5) / 10.0**places


def _numbered(lists: list) -> tuple[np.ndarray, list[tuple]]:
    """The number of each list among the different ones, and these."""
    number: dict[tuple, int] = {}
    return np.array([number.setdefault(tuple(v or ()), len(number)) for v in lists], np.int64), list(number)


def _bonus(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Genre part of the rough score of different lists of genres: the primary genre of the asking work is among the other's, or any genre is."""
    holding: dict[str, list[int]] = {}
    for j, other in enumerate(b):
        for g in set(other):
            holding.setdefault(g, []).append(j)
    out = np.zeros((len(a), len(b)))
    for i, own in enumerate(a):
        for g in own:
            out[i, holding.get(g, [])] = 0.6 * 0.25
        if own and own[0]:
            out[i, holding.get(own[0], [])] = 0.6 * 0.5
    return out


def _best(r: np.ndarray, by: list[np.ndarray], most: int) -> np.ndarray:
    """Positions of the first ``most`` of every r, in the order of ``by``."""
    order = np.lexsort((*reversed(by), r))
    first = np.flatnonzero(np.diff(r[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]


def rough_pool(q: pa.Table, x: pa.Table, most: int, part: int = 128, tile: int = 512) -> pa.Table:
    """(id, match, rough): the ``most`` works of ``x`` with the best rough score for every work of ``q``; ties at twelve places go to the smaller id.

    Works of ``x`` with equal style and genres are one class, whose scores are made once.  All classes are scored in tiles, in single precision
    unless some style is almost zero; what reaches the least score that can still be among the best, less a margin for twice the error, is scored
    again exactly and in fixed order.
    """
    if not (q.num_rows and x.num_rows):
        return pa.table({"id": np.zeros(0, np.int64), "match": np.zeros(0, np.int64), "rough": np.zeros(0)})
    qi, xi = np.asarray(q.column("id")), np.asarray(x.column("id"))
    qs, xs = (_dense(t.column("style").combine_chunks(), 8) for t in (q, x))
    (qg, q_lists), (xg, x_lists) = (_numbered(t.column("genres").to_pylist()) for t in (q, x))
    bonus = _bonus(q_lists, x_lists)
    order = np.lexsort((xi, *xs.T, xg))
    xi, xs, xg = xi[order], xs[order], xg[order]
    start = np.flatnonzero(np.append(True, (xs[1:] != xs[:-1]).any(1) | (xg[1:] != xg[:-1])))
    size, cs, cg = np.diff(np.append(start, len(xi))), xs[start], xg[start]
    nq, nc = np.sqrt(_dots(qs, qs)), np.sqrt(_dots(cs, cs))
    plain = nq[nq > 0].min(initial=1) * nc[nc > 0].min(initial=1) < 1e-3  # else the billionth in the divisor is below 1e-6
    kind, margin = np.float64 if plain else np.float32, 2e-6
    unit = lambda v, length: v if plain else v / np.where(length > 0, length, 1)[:, None]
    asked, held, rise = (0.4 * unit(qs, nq)).astype(kind), np.ascontiguousarray(unit(cs, nc).T, kind), bonus.astype(kind)
    # The bounds double, so that few candidates are kept and few times put in order.
    bounds, at = [0], 4 * tile
    while bounds[-1] < len(cs):
        bounds.append(min(at, len(cs)))
        at *= 2
    space, out = (np.empty(part * tile, kind), np.empty(part * tile, kind), np.empty(part * tile, bool)), []
    for lo in range(0, len(qi), part):
        s, n, b = asked[lo : lo + part], nq[lo : lo + part], rise[qg[lo : lo + part]]
        low = np.full(len(n), -np.inf, kind)
        r, c, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for begin, end in zip(bounds, bounds[1:]):
            rs, cc, vs = [r], [c], [v]
            for k in range(begin, end, tile):
                to = min(k + tile, end)
                score, other, out_of = (one[: len(n) * (to - k)].reshape(len(n), to - k) for one in space)
                np.matmul(s, held[:, k:to], out=score)
                if plain:
                    score /= np.multiply.outer(n, nc[k:to]) + 1e-9
                score += np.take(b, cg[k:to], axis=1, out=other, mode="clip")
                if k == 0 and to > most + 1:
                    low = np.partition(score, to - most - 1, axis=1)[:, to - most - 1] - margin
                    low[np.isnan(low)] = -np.inf
                np.less(score, low[:, None], out=out_of)
                rows, cols = np.divmod(np.flatnonzero(~out_of.ravel()), to - k)
                rs.append(rows)
                cc.append(cols + k)
                vs.append(score[rows, cols])
            r, c, v = np.concatenate(rs), np.concatenate(cc), np.concatenate(vs)
            # A work's own class may hold nothing else, so one class more than ``most`` is needed.
            best = _best(r, [-v], most + 1)
            full = np.bincount(r[best], minlength=len(n)) > most
            last = best[np.cumsum(np.bincount(r[best], minlength=len(n))) - 1]
            low = np.where(full, v[last] - margin, -np.inf).astype(kind)
            keep = ~(v < low[r])
            r, c, v = r[keep], c[keep], v[keep]
        rough = _half_up(bonus[qg[lo + r], cg[c]] + 0.4 * (_dots(qs[lo + r], cs[c]) / (nq[lo + r] * nc[c] + 1e-9)), 12)
        many = np.minimum(size[c], most + 1)
        r, rough, first = np.repeat(r, many), np.repeat(rough, many), np.repeat(start[c], many)
        match = xi[first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)]
        other = match != qi[lo + r]
        r, rough, match = r[other], rough[other], match[other]
        best = _best(r, [-rough, match], most)
        out.append(pa.table({"id": qi[lo + r[best]], "match": match[best], "rough": rough[best]}))
    return pa.concat_tables(out)


def pair_scores(t: pa.Table, titles: bool = False) -> dict[str, np.ndarray]:
    """All factors of pairs of works by the online score; the columns of the asking work begin with a_, those of the other with b_."""
    col = lambda c: [t.column(p + c) for p in ("a_", "b_")]
    (qs, xs), n = [_dense(c.combine_chunks(), 8) for c in col("style")], t.num_rows
    cos8 = _dots(qs, xs) / (np.sqrt(_dots(qs, qs)) * np.sqrt(_dots(xs, xs)) + 1e-9)
    style = np.clip(0.5 * cos8 + 0.5 * np.maximum(0.0, 1.0 - 4.0 * (_dots(np.abs(qs - xs), np.ones((n, 8))) / 8)), 0, 1)
    long = [pc.fill_null(pc.list_value_length(c.combine_chunks()), 0).to_numpy(zero_copy_only=False) for c in col("concept")]
    known, semantic = (long[0] == long[1]) & (long[0] > 0), np.full(n, 0.40)
    for dim in np.unique(long[0][known]).tolist():
        at = np.flatnonzero(known & (long[0] == dim))
        qc, xc = (_dense(c.combine_chunks().take(pa.array(at)), dim) for c in col("concept"))
        nq, nx = np.sqrt(_dots(qc, qc)), np.sqrt(_dots(xc, xc))
        some = (nq > 1e-9) & (nx > 1e-9)
        semantic[at] = np.where(some, np.clip(_dots(qc, xc) / np.where(some, nq * nx, 1), 0, 1), 0.40)
    if titles:
        asked, own = ([v or "" for v in c.to_pylist()] for c in col("title"))
        held = np.array([sum(w in a for w in set(re.findall(r"\b[a-z]{4,}\b", b.lower())) - _COMMON_TITLE) for a, b in zip((a.lower() for a in asked), own)], float)
        semantic = np.where(np.array([a != "" for a in asked], bool), np.clip(0.70 * semantic + np.minimum(0.30, 0.15 * held), 0, 1), semantic)
    genre, tag, territory = np.empty(n), np.empty(n), np.empty(n)
    share = lambda a, b: len(a & b) / max(1, len(a | b))
    lists = ([v or [] for v in c.to_pylist()] for c in (*col("genres"), *col("tags")))
    for i, (g, h, v, w, ta, tb) in enumerate(zip(*lists, *(c.to_pylist() for c in col("territory")))):
        first, j = g[0] if g else "", share(set(g), set(h))
        genre[i] = 0.85 + 0.15 * j if first and h and first == h[0] else 0.60 + 0.25 * j if first and first in h else 0.20 * j if g and h else 0.40
        tag[i] = share(set(v), set(w)) if v and w else 0.80 * genre[i]
        territory[i] = 0.50 if "unknown" in (ta, tb) else 1.0 if ta == tb else 0.60 if ta in tb or tb in ta else 0.20
    story = np.clip(0.45 * semantic + 0.35 * genre + 0.15 * tag + np.round(0.05 * territory, 3), 0, 1)
    return {"score": _half_up(np.clip(0.85 * story + 0.15 * style, 0.01, 0.99), 4), "story": story, "style": style, "semantic": semantic, "genre": genre, "tag": tag, "territory": territory}


def _online(works: DataFrame, asking: Column, k: int, pool: int, q_blocks: int, n_blocks: int, titles: bool) -> DataFrame:
    """Candidates by the rough score, which needs genres and style only, then the scores of these pairs alone."""
    x = works.select("id", "style", "genres").withColumn("xb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = works.where(asking).select("id", "style", "genres").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    x = x.toDF(*x.columns)  # columns of their own, as both sides come from one table
    found = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInArrow(lambda a, b: rough_pool(a, b, pool), "id long, match long, rough double")
    found = found.withColumn("_p", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rough"), "match"))).where(F.col("_p") <= pool).select("id", "match")
    need = ["title", "genres", "tags", "territory", "style", "concept"] if titles else ["genres", "tags", "territory", "style", "concept"]
    side = lambda p, df: df.select(*[F.col(c).alias(p + c) for c in ("id", *need)])
    pairs = found.join(side("b_", works), F.col("match") == F.col("b_id")).join(side("a_", works.where(asking)), F.col("id") == F.col("a_id")).drop("a_id", "b_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            s = pair_scores(t, titles)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("match"), *(pa.array(s[f]) for f in FACTORS), pa.array(_half_up(s["story"], 12))], ["id", "match", *FACTORS, "_story"])

    scored = pairs.mapInArrow(score, "id long, match long, " + ", ".join(f"{f} double" for f in FACTORS) + ", _story double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("_story"), "match")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_story")


def top_matches(works: DataFrame, asking: Column, k: int = 5, mode: str = "online", pool: int = 40, block: int | None = None, ask_block: int | None = None, titles: bool = False) -> DataFrame:
    """(id, match, rank, score, …): the k best works for every work where ``asking`` holds.

    ``online`` first keeps, of more than 50 candidates, the ``pool`` of the best rough score (genre bonus and style) and scores those; ``batch``
    scores all.  With ``titles`` (a column of both sides) words of the candidate's title that the asking title holds count towards the
    semantic factor.  Works are split into blocks of about ``block``, asking works into blocks of about ``ask_block`` that are worked off in
    slices; every pair of blocks is one group, of which at most ``pool`` (or k) rows a query leave the task.  Ties go to the higher story
    score, then to the smaller id.
    """
    block, ask_block = block or (65_536 if mode == "online" else 2048), ask_block or (4096 if mode == "online" else 8192)
    counts = works.agg(F.count("*").alias("n"), F.coalesce(F.sum(asking.cast("long")), F.lit(0)).alias("q")).first()
    n_blocks, q_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // ask_block))
    if mode == "online":
        return _online(works, asking, k, pool if counts["n"] > 51 else max(k, 50), q_blocks, n_blocks, titles)  # all candidates up to 50
    q = works.where(asking).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    x = works.withColumn("xb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    schema = "id long, match long, " + ", ".join(f"{f} double" for f in FACTORS)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["id", "match", *FACTORS]
        if not (a.num_rows and b.num_rows):
            return pa.table({n: np.zeros(0, np.int64 if n in ("id", "match") else np.float64) for n in names})
        xi, parts = np.asarray(b.column("id")), []
        for lo in range(0, a.num_rows, 256):
            part = a.slice(lo, 256)
            s = block_scores(part, b, titles)
            qi = np.asarray(part.column("id"))
            rows, cols = [], []
            for r in range(len(qi)):
                order = np.lexsort((xi, -s["story"][r], -s["score"][r]))
                order = order[xi[order] != qi[r]][:k]
                rows.append(np.full(len(order), r))
                cols.append(order)
            r, c = np.concatenate(rows), np.concatenate(cols)
            parts.append(pa.table({"id": qi[r], "match": xi[c]} | {f: s[f][r, c] for f in FACTORS}))
        return pa.concat_tables(parts)

    x = x.toDF(*x.columns)  # columns of their own, as both sides come from one table
    found = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInArrow(meet, schema)
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("story"), "match")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reasons(factors: dict[str, Column], mine: Column, primary: Column, genres: Column, territory: Column, shown: Column | None = None) -> Column:
    """Why a work matches, story before style; at least one reason.

    ``factors`` has genre, semantic, tag, territory and style; ``mine`` is the asking work's primary genre, the others are the candidate's
    primary genre (``shown``: as it is to be written), genres and territory, all in lower case.
    """
    has = (F.coalesce(mine, F.lit("")) != "") & (F.coalesce(primary, F.lit("")) != "")
    out = F.array_compact(F.array(
        F.when(has & (mine == primary), F.concat(F.lit("Matching primary archetype: "), shown if shown is not None else primary))
        .when((F.coalesce(mine, F.lit("")) != "") & F.array_contains(genres, mine), F.concat(F.lit("Shared genre: "), mine)).when(factors["genre"] >= 0.60, "Strong genre overlap"),
        F.when(factors["semantic"] >= 0.80, "Closely aligned plot premise & themes").when(factors["semantic"] >= 0.65, "Thematic narrative overlap"),
        F.when(factors["tag"] >= 0.60, "Overlapping narrative tropes"),
        F.when(factors["territory"] >= 0.85, F.when(territory.contains("classic"), "Shared Classic Literature tradition").when(territory.contains("web"), "Shared Web Novel territory")),
        F.when(factors["style"] >= 0.88, "Similar prose style & sentence structure").when(factors["style"] >= 0.75, "Comparable sentence cadence"),
    ))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("Overall thematic and stylistic affinity")))
