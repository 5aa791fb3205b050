import datetime as dt

from pyspark.sql import functions as F

from fabula.sources import books, parsers, readers, sinks
from fabula.streaming import ingest


def test_split_book():
    body = "It was a long day. " * 20
    text = f"Title: T\nAuthor: A\nSubjects: Sea stories; Pirates -- Fiction\n*** START OF THIS BOOK ***\nCHAPTER I\nCHAPTER II\n\nCHAPTER I\n\n{body}\nCHAPTER II\n\n{body}\n*** END OF THE BOOK ***\nlicence"
    title, author, subjects, chapters = books.split_book(text)
    assert (title, author, subjects) == ("T", "A", ["Sea stories", "Pirates", "Fiction"])
    assert [h for h, _ in chapters] == ["CHAPTER I", "CHAPTER II"] and all(b == body.strip() for _, b in chapters)
    assert books.split_book(None)[3] == [] and books.split_book("short text")[3] == [("Chapter 1", "short text")]


def test_book_table_function(spark):
    df = spark.createDataFrame([(1, "CHAPTER 1\n\n" + "word " * 60 + "\nCHAPTER 2\n\n" + "other " * 60), (2, ""), (3, None)], "k long, t string")
    rows = books.chapters(df, "k", "t").collect()
    assert sorted((r["k"], r["chapter_number"]) for r in rows) == [(1, 1), (1, 2)]


def test_parsers(spark):
    raw = spark.createDataFrame([(("Saga - Chapter 3 - x", "Me"), "<p>Hi</p>"), (("Solo", None), "t")], "meta struct<title: string, author: string>, text string")
    rows = parsers.parse(raw, "scribblehub").collect()
    assert [(r["series_title"], r["chapter_title"], r["chapter_number"], r["author"], r["text_en"]) for r in rows] == [("Saga", "Chapter 3 - x", 3, "Me", "Hi"), ("Solo", "Solo", None, "Unknown", "t")]
    flat = spark.createDataFrame([(None, None, "Ch 2", "b")], "title string, author string, chapter_title string, text string")
    r = parsers.parse(flat, "flat").first()
    assert (r["series_title"], r["chapter_number"]) == ("Unknown Title", 2)
    assert parsers.parse(flat, "cnnovel").first()["text_zh"] == "b"


def test_caches(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"1": {"x": 2}, "_v": {"x": 3}, "7": {"x": 4}}')
    assert sorted((r["id"], r["value"]["x"]) for r in readers.json_map(spark, str(tmp_path / "c.json"), "struct<x: int>").collect()) == [(1, 2), (7, 4)]
    assert readers.resolve("c.json", ["/nowhere", str(tmp_path)]) == str(tmp_path / "c.json") and readers.resolve("zzz", ["/nowhere"]) is None
    assert readers.centroids(spark, str(tmp_path)) is None
    c = spark.createDataFrame([("a", [1.0], 3)], "label string, centroid array<double>, samples_used long")
    sinks.save_centroids(c, c, str(tmp_path))
    assert [tuple(r) for r in readers.centroids(spark, str(tmp_path))[0].collect()] == [("a", [1.0], 3)]
    blobs = spark.createDataFrame([(bytearray(b"no gzip"),), (None,)], "data binary").select(readers.unzip("data", "x int").alias("v")).collect()
    assert [r["v"] for r in blobs] == [None, None]


def test_merge_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sinks.merge_cache(df, path, "id") and not sinks.merge_cache(df.limit(0), path, "id")
    sinks.merge_cache(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path, "id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    done = str(tmp_path / "done")
    assert sinks.rebuild(df, "id", done, lambda x: x, 2) > 0 and sinks.rebuild(df, "id", done, lambda x: x, 2) == 0


def test_stream_quota_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, i % 2, 0, "t", None, "e", None, dt.datetime(2024, 1, 1, 0, i)) for i in range(20)]
    for part in (rows[:10], rows[5:15], rows[15:]):
        spark.createDataFrame(part, readers.CHAPTER).coalesce(1).write.mode("append").parquet(str(src))
    stream = ingest.read_files(spark, str(src), readers.CHAPTER, files_per_batch=1)
    ingest.ingest_chapters(stream, str(tmp_path / "out"), str(tmp_path / "state"), most=4)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 8 and out.select("id").distinct().count() == 8
    ingest.ingest_chapters(ingest.read_files(spark, str(src), readers.CHAPTER), str(tmp_path / "out"), str(tmp_path / "state"), most=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_registry_is_complete():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) >= 80 and set(o) <= set(q)


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "fabula"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", f.read_text(), re.M), f


def test_all_features_columns(spark):
    from fabula.functions.metrics import with_features

    df = with_features(spark.createDataFrame([("「はい」と言った。",)], "t string"), "t", "ja")
    assert df.select(F.col("ja_dialogue_ratio")).first()[0] > 0


def test_the_whole_cache_is_merged(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    got = entry.queries()["s_merged_whole"](spark, d).collect()
    want = {(r["id"], r["title"].upper()) for r in spark.read.parquet(f"{d}/stats_cache.parquet").select("id", "title").collect()}
    assert len(got) == len(want) and {(r["id"], r["title"]) for r in got} == want
