"""Evaluation texts leaking into training text.

An inverted index holds the sentences of the test passages with their BM25 term
weights, each sentence's weights scaled so that a full match scores 1, in blocks
of ``BLOCK`` sentences with the largest weight of every term per block.  Every
training document asks with its terms.  Block-max WAND with a fixed threshold:
blocks whose summed maxima cannot reach it are skipped with their postings, the
postings of the others are added up, and all sentences above the threshold are
verified by the edit distance of the sentence to its best place anywhere in the
document.  A document exposes an item if it holds at least ``share`` of the
sentences of the item's passage; whether it holds the question too is told.

Terms are words; in scripts without spaces, pairs of characters.  Both sides are
brought to one form of characters first, without case and punctuation.

The index is cut into pieces of a bounded number of sentences by a hash of the
item; as many pieces as a bounded number of bytes holds are sent to the tasks at
once, and the documents are passed over once for each such lot.
Defined results: null and empty texts hold nothing; an item without a sentence is
exposed by none; of an item with several texts the least counts; documents of any
length are searched whole; repeated rows count once in the distinct result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .canon import former
from .sentences import segment_batch

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ가-힣]|[^\W_぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ가-힣]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ가-힣]")
BLOCK = 32


def tokens(text: str, form) -> list[str]:
    return _TOKEN.findall(form(text).lower().replace("’", "").replace("'", ""))


def terms(toks: list[str]) -> list[str]:
    wide = [t >= "ぁ" and bool(_WIDE.match(t)) for t in toks]
    if not any(wide):
        return toks
    out = [a + b for a, b, x, y in zip(toks, toks[1:], wide, wide[1:]) if x and y]
    return out + [t for t, x in zip(toks, wide) if not x]


def best_place(pattern: list[str], text: list[str]) -> int:
    """Least number of token edits that turn ``pattern`` into some part of ``text`` (bit-parallel)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, t in enumerate(pattern):
        peq[t] = peq.get(t, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for t in text:
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return best


class Pattern:
    """A token sequence to be found with at most ``limit`` edits: one of ``limit`` + 1 pieces of it then stands in the text as it is."""

    def __init__(self, toks: list[str], limit: int):
        self.toks, self.limit = toks, limit
        cuts = [len(toks) * k // (limit + 1) for k in range(limit + 2)]
        self.pieces = [(a, _joined(toks[a:b])) for a, b in zip(cuts, cuts[1:])]

    def found(self, text: list[str], joined: str) -> bool:
        """Whether some part of ``text`` (``joined``: the same joined) is within the limit; only the places of exact pieces are compared."""
        m, slack = len(self.toks), self.limit
        for start, piece in self.pieces:
            at = joined.find(piece)
            while at >= 0:
                p = joined.count(_SEP, 0, at)
                if not slack and len(self.pieces) == 1 or best_place(self.toks, text[max(0, p - start - slack) : p - start + m + slack]) <= slack:
                    return True
                at = joined.find(piece, at + 1)
        return False


_SEP = "\x1f"


def _joined(toks: list[str]) -> str:
    return _SEP + _SEP.join(toks) + _SEP


def item_sentences(items: DataFrame) -> DataFrame:
    """(item, no, toks, bag, question) of ``items`` (id, text): tokens and terms of every sentence of the passage, the first line, and the
    tokens of the question."""
    one = items.select(F.col(items.columns[0]).alias("item"), F.col(items.columns[1]).alias("text")).where("item IS NOT NULL").groupBy("item").agg(F.min("text").alias("text"))
    kind = one.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = former(True)
        for batch in batches:
            at, no, toks, question = [], [], [], []
            lines = [(t or "").split("\n", 1) for t in batch.column(1).to_pylist()]
            for k, text, spans, _ in segment_batch([x[0] for x in lines], [bool(_WIDE.search(x[0])) for x in lines]):
                own = [x for x in (tokens(text[a:e], form) for a, e in spans) if x]
                at += [k] * len(own)
                no += range(len(own))
                toks += own
                question += [tokens(lines[k][1], form) if len(lines[k]) > 1 else []] * len(own)
            strings = pa.list_(pa.string())
            columns = [pa.array(no, pa.int32()), pa.array(toks, strings), pa.array([terms(t) or t for t in toks], strings), pa.array(question, strings)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["item", "no", "toks", "bag", "question"])

    return one.mapInArrow(run, f"item {kind}, no int, toks array<string>, bag array<string>, question array<string>")


class Shard:
    """Inverted index of the sentences of some test items, in blocks with the largest weight of every term per block (kept sparse)."""

    def __init__(self, rows: list[dict], idf: dict[str, float], mean: float, k1: float = 1.2, b: float = 0.75):
        bags = [Counter(r["bag"]) for r in rows]
        # Like sentences share blocks, so that few blocks reach the threshold.
        order = sorted(range(len(rows)), key=lambda i: sorted(bags[i], key=lambda t: (-idf[t], t))[:3])
        self.items: list = []
        self.item, numbers = np.zeros(len(rows), np.int64), {}
        self.patterns: list[Pattern] = []
        self.questions: dict[int, Pattern] = {}
        self.ids: dict[str, int] = {}
        posts: list[tuple[int, int, float]] = []
        for s, i in enumerate(order):
            r, bag = rows[i], bags[i]
            if r["item"] not in numbers:
                numbers[r["item"]] = len(self.items)
                self.items.append(r["item"])
                self.questions[numbers[r["item"]]] = Pattern(list(r["question"]), allowed(r["question"]))
            self.item[s] = numbers[r["item"]]
            self.patterns.append(Pattern(list(r["toks"]), allowed(r["toks"])))
            n = sum(bag.values())
            w = {t: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean)) for t, tf in bag.items()}
            full = sum(w.values())
            posts += [(self.ids.setdefault(t, len(self.ids)), s, x / full) for t, x in w.items()]  # a full match scores 1
        self.need = np.bincount(self.item, minlength=len(self.items)) if len(rows) else np.zeros(0, np.int64)
        self.blocks = max(1, -(-len(rows) // BLOCK))
        posts.sort()
        term, sent = np.array([p[0] for p in posts], np.int64), np.array([p[1] for p in posts], np.int64)
        self.sent, self.weight = sent.astype(np.int32), np.array([p[2] for p in posts], np.float32)
        run = term * self.blocks + sent // BLOCK
        self.run = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))  # postings of one term in one block
        at = self.run[:-1]
        self.block = (run[at] % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, at) if len(at) else self.weight
        self.term = np.searchsorted(run[at] // self.blocks, np.arange(len(self.ids) + 1))

    def candidates(self, queries: list[list[str]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, sentence) of all sentences whose score against the terms of a query reaches the threshold.

        Blocks are the pivots: a block whose summed maxima stay below the threshold is skipped with all its postings, and only the postings of
        the others are read and added up.  Many queries are worked off at once."""
        get = self.ids.get
        known = [[t for t in map(get, set(q)) if t is not None] for q in queries]
        who = np.repeat(np.arange(len(queries)), [len(k) for k in known])
        term = np.fromiter((t for k in known for t in k), np.int64, len(who))
        pair, spread = _ranges(self.term[term], self.term[term + 1])
        key = who[spread] * self.blocks + self.block[pair]
        alive = np.bincount(key, self.top[pair], minlength=len(queries) * self.blocks) >= threshold - 1e-4
        rank = np.cumsum(alive) - 1
        go = alive[key]
        pair, key = pair[go], key[go]
        post, spread = _ranges(self.run[pair], self.run[pair + 1])
        score = np.bincount(rank[key[spread]] * BLOCK + self.sent[post] % BLOCK, self.weight[post], minlength=1)
        hit = np.flatnonzero(score >= threshold - 1e-6)
        place = np.flatnonzero(alive)[hit // BLOCK]
        return place // self.blocks, place % self.blocks * BLOCK + hit % BLOCK


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, hi), and of each the number of its range."""
    n = hi - lo
    spread = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n) + lo[spread], spread


def allowed(toks: list[str]) -> int:
    """Edits that still are slight changes: one word of a short sentence, two from ten words on, up to three characters where there are no spaces."""
    wide = sum(1 for t in toks if _WIDE.match(t))
    if 2 * wide > len(toks):
        return min(3, len(toks) // 6)
    return min(2, len(toks) // 5 if len(toks) >= 5 else len(toks) // 4)


def shards(items: DataFrame, size: int = 20_000) -> DataFrame:
    """(blob): the index of the test items in pieces of about ``size`` sentences, each made in a task of its own; the statistics are of all items."""
    rows = cut(item_sentences(items))
    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg(F.size("bag")), F.lit(1.0))).first()
    held = rows.select("item", "no", F.explode(F.array_distinct("bag")).alias("t"))
    held = held.join(held.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("item", "no").agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("df"))
    count = max(1, -(-n // size))

    def build(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        df = {t: c for r in own for t, c in r["df"]}
        idf = {t: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
        return pa.table({"blob": pa.array([pickle.dumps(Shard(sorted(own, key=lambda r: (r["item"], r["no"])), idf, mean))], pa.binary())})

    return rows.join(held, ["item", "no"]).withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(count))).groupBy("shard").applyInArrow(build, "blob binary")


def _search(docs: DataFrame, key: str, text: str, item_kind: str, blobs: list[bytes], share: float, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(blobs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, form = [pickle.loads(b) for b in sent.value], former(True)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                toks = [tokens(t, form) if t else [] for t in part.column(1).to_pylist()]
                queries = [terms(t) or t for t in toks]
                joined: list = [None] * len(toks)
                at, item, held, of, asked = [], [], [], [], []
                for shard in own:
                    doc, near = shard.candidates(queries, threshold)
                    if not len(doc):
                        continue
                    # An item needs enough candidates before any sentence is verified.
                    group = doc * len(shard.items) + shard.item[near]
                    _, back, hopes = np.unique(group, return_inverse=True, return_counts=True)
                    go = hopes[back] >= share * shard.need[shard.item[near]]
                    counts: dict[tuple[int, int], int] = {}
                    for d, s in zip(doc[go].tolist(), near[go].tolist()):
                        if joined[d] is None:
                            joined[d] = _joined(toks[d])
                        if shard.patterns[s].found(toks[d], joined[d]):
                            k = (d, int(shard.item[s]))
                            counts[k] = counts.get(k, 0) + 1
                    for (d, k), c in counts.items():
                        if c >= share * shard.need[k]:
                            question = shard.questions[k]
                            at.append(d)
                            item.append(shard.items[k])
                            held.append(c)
                            of.append(int(shard.need[k]))
                            asked.append(bool(question.toks) and question.found(toks[d], joined[d]))
                columns = [pa.array(item, pa.int64()), pa.array(held, pa.int32()), pa.array(of, pa.int32()), pa.array(asked, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], [key, "item_id", "held", "of", "question"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id {item_kind}, held int, of int, question boolean")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, share: float = 0.5, threshold: float = 0.55, size: int = 20_000, together: int = 64 << 20) -> DataFrame:
    """(key, item_id, held, of, question): documents and the items whose passage they hold by at least ``share``, and whether they hold the question
    too; ``items`` has the columns (id, text), the ids whole numbers.  Pieces of the index are sent ``together`` bytes at a time, each with a pass
    over the documents."""
    item_kind = items.schema[items.columns[0]].dataType.simpleString()
    out, held, load = None, [], 0
    for row in shards(items, size).toLocalIterator():
        if held and load + len(row["blob"]) > together:
            found = _search(docs, key, text, item_kind, held, share, threshold)
            out, held, load = found if out is None else out.unionByName(found), [], 0
        held.append(bytes(row["blob"]))
        load += len(row["blob"])
    found = _search(docs, key, text, item_kind, held, share, threshold)
    return found if out is None else out.unionByName(found)
