"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are laid out in a fixed random order, once per allowed
pass, and cut into blocks of ``block`` tokens (a document longer than what is left
of a block goes on in the next).  The mixture is a row of slots of one block each.
Block i of a source of weight w is released at floor(i / w) and due at
ceil((i + 1) / w); each slot takes, of the released blocks, the one with the
earliest deadline, which keeps every source within one block of its share at any
point of the mixture.  Weights are rounded to 1 / ``PERIOD``, so this schedule
repeats itself after ``PERIOD`` slots: one period is played on the driver and sent
to the tasks, a table of fixed size from which the slot of any block follows.

The mixture ends where the first source has used all its passes, so that all
shares are reached without a document being taken more often than allowed; the
report says what each source reached.

Running sums are made in two steps (inside pieces of a source, then over the
pieces), so no task gets a whole source.

Defined results: a source without documents or with a weight of 0 or null takes no
part, and the weights of the others are scaled to sum 1; null and empty texts have
0 tokens and are left out; repeated documents count once; source names are
compared without case and outer spaces; documents of unlisted sources are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Slots after which the schedule repeats itself; weights are rounded to its inverse.
PERIOD = 100_000
#: Documents of a piece of a source whose running sums are made apart.
PIECE = 200_000


def token_counts(df: DataFrame, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``df`` without ``text`` but with ``tokens``, counted by the byte-level vocabulary file ``vocabulary`` (ranks) of a public tokenizer."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(sizes, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


def _running(df: DataFrame, pieces: int) -> DataFrame:
    """Adds ``before``, the tokens of the source's documents before this one in the fixed order.  ``df`` is read twice."""
    # Pieces are ranges of the order, so that their sums can be added up.
    df = df.withColumn("order", F.xxhash64("doc_id", F.lit(8))).withColumn("piece", F.floor((F.shiftright("order", 1).cast("double") / F.lit(2.0**62) + 1) / 2 * pieces).cast("int"))
    sums = df.groupBy("source", "piece").agg(F.sum("tokens").alias("piece_tokens"))
    start = F.coalesce(F.sum("piece_tokens").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "piece").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sums.withColumn("start", start).drop("piece_tokens"), ["source", "piece"]).withColumn("before", F.col("start") + own).drop("start", "order", "piece")


def apportion(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period that each source gets: its scaled weight times ``period``, rounded to sum ``period`` by the largest remainders, at least 1."""
    whole = sum(weights.values())
    exact = {s: w / whole * period for s, w in weights.items()}
    out = {s: max(1, int(x + 1e-9)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for k in range(period - sum(out.values())):
        out[order[k % len(order)]] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s], out[s] > 1, s))] -= 1
    return out


def play(slots: dict[str, int], period: int = PERIOD) -> dict[str, list[int]]:
    """The slot of every block of one period, by source: each slot takes the released block with the earliest deadline (then by name)."""
    waiting = [(0, s, 0) for s in sorted(slots)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in slots}
    for t in range(period if slots else 0):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(t)
        if i + 1 < slots[s]:
            heapq.heappush(waiting, ((i + 1) * period // slots[s], s, i + 1))
    return out


def plan(sized: DataFrame, targets: DataFrame, block: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes and goals per source, all documents with their running sums, slot of every block of one period).

    ``sized`` has (doc_id, source, tokens) and is read once, ``targets`` (source, weight, max_repeat) is small.
    """
    spark = sized.sparkSession
    name = lambda c: F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))
    goals = targets.select(name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), "max_repeat").where("source <> '' AND weight > 0 AND max_repeat > 0").dropDuplicates(["source"])
    docs = cut(sized.select("doc_id", name(F.col("source")).alias("source"), "tokens").where("tokens > 0").join(F.broadcast(goals), "source").dropDuplicates(["doc_id"]))
    have = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.first("weight").alias("weight"), F.first("max_repeat").alias("max_repeat"))
    found = have.collect()  # a row per source of the small table of targets
    if len(found) > PERIOD:
        raise ValueError(f"more than {PERIOD} sources")
    slots = apportion({r["source"]: r["weight"] for r in found}) if found else {}
    # The most tokens that a mixture with exact shares can hold; each source then gives that many by its share.
    total = min((r["tokens"] * r["max_repeat"] * PERIOD / slots[r["source"]] for r in found), default=0)
    rows = [(r["source"], r["weight"], r["max_repeat"], r["documents"], r["tokens"], slots[r["source"]], int(total * slots[r["source"]] / PERIOD + 1e-6), block) for r in found]
    rates = spark.createDataFrame(rows, "source string, weight double, max_repeat int, documents long, source_tokens long, slots int, wanted long, block int")
    period = spark.createDataFrame([(s, i, t) for s, own in play(slots).items() for i, t in enumerate(own)], "source string, turn int, at_slot int")
    most = max((r["documents"] for r in found), default=1)
    return rates, _running(docs.drop("weight", "max_repeat"), max(1, -(-most // PIECE) * 4)), period


def schedule(sized: DataFrame, targets: DataFrame, block: int = 2048, plans: tuple | None = None) -> DataFrame:
    """The mixture: one row per taken document and block that holds a part of it.

    Sorting by (slot, offset) gives the order; ``slot`` is the block's place in the mixture, ``offset`` the part's first token within it,
    ``tokens`` the part's, ``part`` its number within the document; ``release`` and ``deadline`` are in slots.
    """
    rates, docs, period = plans or plan(sized, targets, block)
    taken = docs.join(F.broadcast(rates.select("source", "slots", "max_repeat", "wanted", "source_tokens")), "source")
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("max_repeat"))))
    taken = taken.withColumn("at", (F.col("pass") - 1) * F.col("source_tokens") + F.col("before")).where(F.col("at") < F.col("wanted"))
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + tokens - 1) div {block}")
    parts = taken.withColumn("block_no", F.explode(F.sequence(first, last))).withColumn("first", first)
    begin, end = F.greatest("at", F.col("block_no") * block), F.least(F.col("at") + F.col("tokens"), (F.col("block_no") + 1) * block)
    parts = parts.withColumn("turn", F.expr("cast(block_no % slots AS int)")).join(F.broadcast(period), ["source", "turn"])
    return parts.select(
        "doc_id", "source", F.col("pass"), (F.col("block_no") - F.col("first") + 1).cast("int").alias("part"), "block_no",
        F.expr(f"block_no * {PERIOD} div slots").alias("release"), F.expr(f"((block_no + 1) * {PERIOD} + slots - 1) div slots").alias("deadline"),
        F.expr(f"block_no div slots * {PERIOD} + at_slot").alias("slot"), (begin - F.col("block_no") * block).cast("int").alias("offset"), (end - begin).cast("long").alias("tokens"),
    )


def report(sized: DataFrame, targets: DataFrame, block: int = 2048) -> DataFrame:
    """Per source: target and reached share, documents and tokens taken, passes used and allowed, and how far its blocks were from its share at worst.

    A source's blocks so far less its share of the slots so far is greatest just before or just after a slot of its own."""
    plans = plan(sized, targets, block)
    rows = schedule(sized, targets, block, plans)
    ends = rows.join(F.broadcast(plans[0].select("source", "slots")), "source")
    share = F.col("slots") / PERIOD
    off = F.greatest(F.abs(F.col("block_no") - share * F.col("slot")), F.abs(F.col("block_no") + 1 - share * (F.col("slot") + 1)))
    used = ends.groupBy("source").agg(F.sum("tokens").alias("taken_tokens"), F.count(F.when(F.col("part") == 1, 1)).alias("taken_documents"), F.max("pass").alias("most_repeats"), F.max(off).alias("worst"))
    whole = Window.partitionBy()  # a row per source
    out = plans[0].join(F.broadcast(used), "source")
    return out.select(
        "source", (F.col("weight") / F.sum("weight").over(whole)).alias("target_share"), (F.col("taken_tokens") / F.sum("taken_tokens").over(whole)).alias("reached_share"), "source_tokens", "taken_tokens",
        F.col("documents").alias("source_documents"), "taken_documents", "most_repeats", "max_repeat", F.round("worst", 3).alias("worst_deviation_blocks"),
    )
