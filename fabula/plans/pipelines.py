"""Pipelines that wire the operators: one text to a full report, records to tables, profiles of genres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.embed import with_prose_vector
from ..functions.text import language
from ..functions.vectors import percentile
from ..operators import arc as A
from ..operators import classify as C
from ..operators.archetype import match_archetype
from ..operators.explain import radar
from ..operators.lineage import cut
from ..operators.relational import quota, upsert
from ..operators.similarity import top_matches
from ..sources import parsers


def check_text(text: str | None, lang: str) -> None:
    """Raises for a blank text and for an unknown language."""
    if not text or not text.strip():
        raise ValueError("the text is empty")
    if lang not in ("auto", "en", "ja", "zh"):
        raise ValueError(f"unknown language {lang!r}")


def analyze(spark: SparkSession, text: str, lang: str = "auto", works: DataFrame | None = None) -> DataFrame:
    """One row: metrics, percentiles, archetype, radar, arc, pacing and guardrail of one text, by the same columns as the tables.

    With ``works`` (rows of ``similarity.work_rows``) also ``top_matches``: the five most similar works (id, score) by the text's archetype,
    territory and radar; words of a work's title that stand in the text count.
    """
    check_text(text, lang)
    df = spark.createDataFrame([(text,)], "text string")
    own = lang if lang != "auto" else df.select(language(F.col("text"))).first()[0]
    f = M.features(F.col("text"), own)
    df = A.with_arc(df, "text", own).withColumns({f"{own}_{k}": v for k, v in f.items()})
    df = df.withColumns({f"{own}_{k}_percentile": percentile(k, F.col(f"{own}_{k}")) for k in f})
    df = cut(df)  # the metrics once, whatever reads them
    df = df.withColumn("archetype", match_archetype({k: F.col(f"{own}_{k}") for k in f})).withColumn("radar", radar(df))
    df = df.withColumn("pacing", A.pacing(F.col("text"), own)).withColumn("guardrail", C.guardrail(F.col("text"))).withColumn("lang", F.lit(own))
    if works is not None:
        me = df.select(
            F.lit(-1).cast("long").alias("id"), F.col("text").alias("title"), F.array(F.lower("archetype.closest_trope")).alias("genres"), F.array().cast("array<string>").alias("tags"),
            F.lower("archetype.territory").alias("territory"), F.col("radar").alias("style"), F.lit(None).cast("array<double>").alias("concept"),
        )
        found = top_matches(works.unionByName(me), F.col("id") == -1, titles=True).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("match").alias("id"), "score"))).alias("m"))
        df = df.crossJoin(found.select(F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("top_matches")))  # a row by a row
    return df.drop("text")


def ingest_records(raw: DataFrame, kind: str, novels: DataFrame, most: int = 12, only_existing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(novels, chapter records) after raw records of a kind: unknown works are added or left out, chapters are limited per work.

    ``raw`` needs a column ``arrival`` that orders the records.
    """
    records = parsers.parse(raw, kind).withColumn("arrival", F.monotonically_increasing_id()) if "arrival" not in raw.columns else _with_arrival(raw, kind)
    key = [F.lower(F.trim("series_title")), F.lower(F.trim("author"))]
    known = novels.select(F.lower(F.trim("title")).alias("_k0"), F.lower(F.trim("author")).alias("_k1"))
    records = records.withColumn("_k0", key[0]).withColumn("_k1", key[1])
    if only_existing:
        records = records.join(known, ["_k0", "_k1"], "left_semi")
    kept = quota(records, ["_k0", "_k1"], [F.col("arrival")], most)
    fresh = kept.select(F.col("series_title").alias("title"), "author", F.lit(None).cast("string").alias("genre"), C.default_territory(F.col("source")).alias("territory"))
    return upsert(novels, fresh, ["title", "author"], ["genre", "territory"]), kept.drop("_k0", "_k1")


def _with_arrival(raw: DataFrame, kind: str) -> DataFrame:
    parsed = parsers.parse(raw.withColumn("_a", F.col("arrival")), kind)
    return parsed.withColumn("arrival", F.monotonically_increasing_id())


def profiles(texts: DataFrame, label: str, text: str, most: int | None = 200, labels: list[str] | None = None, ident: str = "id") -> DataFrame:
    """(label, centroid, samples_used): mean prose vector of at most ``most`` texts per label (by the hash of ``ident``, of the text without one; None: of all); labels without
    a text have a zero vector.  The texts to take are picked by their keys; rows repeated under one key count once where ``most`` is given."""
    dim = 384
    if ident not in texts.columns:
        texts = texts.withColumn(ident, F.xxhash64(text))
    if most is not None:
        keys = texts.select(ident, label).distinct()
        picked = keys.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(ident), ident))).where(F.col("_r") <= most)
        texts = texts.join(picked.select(ident, label), [ident, label], "left_semi").dropDuplicates([ident, label])
    e = with_prose_vector(texts, text, "_v").select(label, F.posexplode("_v").alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    out = e.groupBy(F.col(label).alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"), F.max("n").alias("samples_used"))
    if labels is None:
        return out
    every = texts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(out, "label", "left").select("label", F.coalesce("centroid", F.array_repeat(F.lit(0.0), dim)).alias("centroid"), F.coalesce("samples_used", F.lit(0)).alias("samples_used"))


def job_status(query) -> dict:
    """State of a streaming query: running, done or failed, with the rows of its last batch."""
    last = query.lastProgress
    state = "running" if query.isActive else ("failed" if query.exception() else "done")
    return {"status": state, "error": str(query.exception())[:500] if query.exception() else None, "rows": last["numInputRows"] if last else 0}
