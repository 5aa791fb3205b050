"""Queries of sources, sinks and streams; with the same results in SQL where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import books, parsers, readers, sinks
from ..streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A fresh folder beneath the folder that all executors share."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""SELECT DISTINCT id, CASE WHEN regexp_matches(t, '(?i)ch(?:apter)?\\s*\\d|^\\d') THEN 'x' ELSE 'y' END AS kind FROM (SELECT id, title AS t FROM chapter)""")
def s_titles(spark, d):
    """Titles that hold a chapter number."""
    return _t(spark, d, "chapter").select("id", F.when(F.col("title").rlike("(?i)ch(?:apter)?\\s*\\d|^\\d"), "x").otherwise("y").alias("kind")).distinct()


@query()
def s_parallel(spark, d):
    """Chapters with two languages as raw parallel records, parsed back to chapter records."""
    raw = _t(spark, d, "chapter").where("text_ja <> '' AND text_en <> ''").dropDuplicates(["id"]).select(
        "id", F.expr("named_struct('general', named_struct('series_title_eng', title), 'syosetu', named_struct('writer', CAST(NULL AS STRING)), 'novelupdates', named_struct('genres', array('Fantasy'), 'tags', array('magic', 'Fantasy')))").alias("meta"),
        F.col("text_ja").alias("src"), F.col("text_en").alias("trg"),
    )
    return parsers.parse(raw, "syosetu").select("series_title", "author", "chapter_number", "chapter_title", F.md5("text_ja").alias("ja"), F.md5("text_en").alias("en"), "tags")


@query("""WITH d AS (SELECT doc_id, source, kind, text FROM documents) SELECT doc_id, CASE WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1)) ELSE t END AS series_title,
    CASE WHEN contains(t, ' - ') THEN trim(substr(t, strpos(t, ' - ') + 3)) ELSE t END AS chapter_title FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN kind ELSE kind || ' - Part ' || doc_id || ' - x' END AS t FROM d)""")
def s_titled(spark, d):
    """Titles of the form series - chapter, split at the first hyphen."""
    t = F.when(F.col("doc_id") % 3 == 0, F.col("kind")).otherwise(F.concat("kind", F.lit(" - Part "), F.col("doc_id").cast("string"), F.lit(" - x")))
    raw = _t(spark, d, "documents").select("doc_id", F.struct(t.alias("title"), F.col("doc_id").cast("string").alias("author")).alias("meta"), "text")
    out = parsers.parse(raw, "titled")
    return out.select(F.col("author").cast("long").alias("doc_id"), "series_title", "chapter_title")


_BOOK = "'Title: ' || title || chr(10) || 'Author: ' || author || chr(10) || '*** START OF THIS BOOK ***' || chr(10) || string_agg('CHAPTER ' || i || chr(10) || chr(10) || t || chr(10), '' ORDER BY i) || '*** END OF THIS BOOK ***'"


@query("""WITH c AS (SELECT DISTINCT id, novel_id, chapter_number, text_en AS t FROM chapter WHERE text_en <> '' AND length(text_en) >= 250 AND NOT regexp_matches(text_en, '(?m)^[ \\t]*(?:CHAPTER|Chapter|BOOK|Book|PART|Part|LETTER|Letter|STAVE|Stave)[ \\t]')),
    r AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_number, id) AS i FROM c) SELECT novel_id, i AS chapter_number, 'CHAPTER ' || i AS chapter_title,
    length(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')) AS chars FROM r WHERE i <= 5""")
def s_books(spark, d):
    """Up to five English chapters of every novel bound into a book and taken apart again by the table function."""
    head = "(?m)^[ \\t]*(?:CHAPTER|Chapter|BOOK|Book|PART|Part|LETTER|Letter|STAVE|Stave)[ \\t]"
    own = _t(spark, d, "chapter").where("text_en <> ''").select("id", "novel_id", "chapter_number", F.col("text_en").alias("t")).where((F.length("t") >= 250) & ~F.col("t").rlike(head)).dropDuplicates(["id"])
    from ..operators.relational import quota

    few = quota(own, ["novel_id"], [F.col("chapter_number"), F.col("id")], 5)
    parts = F.sort_array(F.collect_list(F.struct("chapter_number", "id", "t")))
    body = F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("CHAPTER "), (i + 1).cast("string"), F.lit("\n\n"), x["t"], F.lit("\n"))), "")
    bound = few.groupBy("novel_id").agg(F.concat(F.lit("Title: Book\nAuthor: Someone\n*** START OF THIS BOOK ***\n"), body, F.lit("*** END OF THIS BOOK ***")).alias("book"))
    return books.chapters(bound, "novel_id", "book").select("novel_id", "chapter_number", "chapter_title", F.length("body").alias("chars"))


@query("SELECT DISTINCT novel_id AS id, title, quantiles[1] AS q1 FROM arc_cache")
def s_blobs(spark, d):
    """Arcs packed as compressed JSON blobs and read back."""
    packed = _t(spark, d, "arc_cache").select("novel_id", readers.zip_json(F.struct("title", "quantiles")).alias("data"))
    return packed.select(F.col("novel_id").alias("id"), readers.unzip("data", "title string, quantiles array<double>").alias("v")).select("id", "v.title", F.col("v.quantiles")[0].alias("q1")).distinct()


@query("SELECT DISTINCT novel_id AS id, title FROM arc_cache")
def s_json_cache(spark, d):
    """A cache written as one JSON object per id, published by renaming, and scanned again."""
    place = scratch(spark)
    arcs = _t(spark, d, "arc_cache").select("novel_id", "title").distinct()
    sinks.publish(arcs, f"{place}/arcs.parquet")
    rows = spark.read.parquet(f"{place}/arcs.parquet").select(F.to_json(F.map_from_arrays(F.array(F.col("novel_id").cast("string")), F.array(F.struct("title")))).alias("value"))
    rows.write.text(f"{place}/json")
    lines = spark.read.text(f"{place}/json").select(F.from_json("value", "map<string, struct<title: string>>").alias("m")).select(F.explode("m").alias("id", "v"))
    return lines.select(F.col("id").cast("long").alias("id"), "v.title")


@query("""WITH s AS (SELECT DISTINCT id, title, updated_at FROM stats_cache), h AS (SELECT id, title FROM s WHERE id % 2 = 0) SELECT DISTINCT id, coalesce(CASE WHEN id % 3 = 0 THEN 'new' END, title) AS title FROM s WHERE id % 2 = 0 OR id % 3 = 0""")
def s_merged_cache(spark, d):
    """K5: a cache merged with new rows; rows of the same key are replaced, an empty merge changes nothing."""
    path = f"{scratch(spark)}/cache.parquet"
    s = _t(spark, d, "stats_cache").select("id", "title").distinct()
    sinks.merge_cache(s.where("id % 2 = 0"), path, "id")
    sinks.merge_cache(s.where("id % 3 = 0").select("id", F.lit("new").alias("title")), path, "id")
    sinks.merge_cache(s.where("id < 0"), path, "id")
    return spark.read.parquet(path)


@query("SELECT DISTINCT id, upper(title) AS title FROM stats_cache")
def s_merged_whole(spark, d):
    """K5: the whole cache, merged with changed titles for all of its rows."""
    path = f"{scratch(spark)}/cache.parquet"
    s = _t(spark, d, "stats_cache").select("id", "title").distinct()
    sinks.merge_cache(s, path, "id")
    sinks.merge_cache(s.withColumn("title", F.upper("title")), path, "id")
    sinks.merge_cache(s.where("id < 0"), path, "id")
    return spark.read.parquet(path)


@query("SELECT DISTINCT id, upper(title) AS title FROM novel")
def s_rebuilt(spark, d):
    """K7: a rebuild in steps; a second run finds nothing to do."""
    path = f"{scratch(spark)}/rebuilt.parquet"
    nv = _t(spark, d, "novel").select("id", "title").distinct()
    work = lambda df: df.select("id", F.upper("title").alias("title"))
    sinks.rebuild(nv, "id", path, work, version=2, parts=2)
    sinks.rebuild(nv, "id", path, work, version=2, parts=2)
    return spark.read.parquet(path).select("id", "title")


@query("""WITH c AS (SELECT id, any_value(novel_id) AS novel_id, min(ingested_at) AS came FROM chapter GROUP BY id) SELECT id, novel_id FROM c QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY came, id) <= 12""")
def st_ingest(spark, d):
    """Chapters streamed in with repeats dropped and at most twelve per novel.

    Batches hold earliest deliveries first where the table is one file; over several files the order of the files decides.
    """
    place = scratch(spark)
    stream = ingest.read_files(spark, f"{d}/chapter.parquet", readers.CHAPTER).select("id", "novel_id", "chapter_number", "ingested_at")
    ingest.ingest_chapters(stream, f"{place}/chapters", f"{place}/state")
    return spark.read.parquet(f"{place}/chapters").select("id", "novel_id")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def st_windows(spark, d):
    """Windowed counts of the event stream."""
    place = scratch(spark)
    schema = _t(spark, d, "events").schema
    ingest.windowed_counts(ingest.read_files(spark, f"{d}/events.parquet", schema), f"{place}/windows", f"{place}/state")
    return spark.read.parquet(f"{place}/windows").select("event_type", "day", "n", F.round("total", 6).alias("total"))


@query("SELECT kind, least(count(*), 25) AS n FROM documents GROUP BY kind")
def st_keyed_quota(spark, d):
    """At most 25 documents per kind from a stream, by state per key."""
    place = scratch(spark)
    schema = _t(spark, d, "documents").schema
    stream = ingest.read_files(spark, f"{d}/documents.parquet", schema).withColumnRenamed("doc_id", "id")
    ingest.keyed_quota(stream, "kind", 25).writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("kind").agg(F.count("*").alias("n"))
