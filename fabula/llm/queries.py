"""The registered queries of the text problems: each runs its operator over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.lit("documents").alias("record_kind"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("label"), "text")
    arcs = _t(spark, d, "arc_cache").select(F.lit("arc_cache").alias("record_kind"), F.col("novel_id").alias("rec_id"), F.col("_lang").alias("label"), F.col("opening").alias("text"))
    chapters = _t(spark, d, "chapter").select(F.lit("chapter").alias("record_kind"), F.col("id").alias("rec_id"), F.lit("en").alias("label"), F.col("text_en").alias("text"))
    return docs.unionByName(arcs).unionByName(chapters).where("text <> ''")


def _profile(spark: SparkSession, d: str):
    from .language import fit, label_column

    docs = _t(spark, d, "documents")
    return fit(docs.select("doc_id", "text", label_column(docs["lang"]).alias("lang")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one language of every record whose label is missing or wrong or whose text is mixed."""
    from .language import label_cases

    return label_cases(_records(spark, d), _profile(spark, d)).select("record_kind", "rec_id", "seg", "lang").distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and place of every stretch of every document, opening and English chapter text."""
    from .language import language_runs

    runs = language_runs(_records(spark, d).drop("label"), _profile(spark, d))
    return runs.select("record_kind", "rec_id", F.explode("runs").alias("r")).select("record_kind", "rec_id", "r.*").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of novels of which at least one is among the five most similar of the other."""
    from .neighbours import neighbours

    found = neighbours(_t(spark, d, "novel_vector").select("id", "concept"), "id", "concept")
    return found.select(F.least("id", "match").alias("id_a"), F.greatest("id", "match").alias("id_b")).distinct()


def p3_top_matches(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt top_matches of every novel whose id is divisible by 20, searched among all novels."""
    from .neighbours import neighbours

    vectors = _t(spark, d, "novel_vector").select("id", "concept")
    return neighbours(vectors, "id", "concept", queries=vectors.where("id % 20 = 0").select("id"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    from .align import align

    return align(_t(spark, d, "chapter").select("id", "text_ja", "text_en"), "id", "text_ja", "text_en", _t(spark, d, "glossary").select("term_en", "term_ja"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the Japanese and English text of a chapter that hold translations of one another."""
    return _aligned(spark, d).select(F.col("id").alias("chapter_id"), "ja_line", "en_line").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chapters whose Japanese or Chinese text reads the same in different characters."""
    from .canon import same_reading

    return same_reading(_t(spark, d, "chapter"), "id", ["text_ja", "text_zh"]).distinct()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter text that reads like another one stored otherwise: its class, its stored form's first chapter, and its number of links."""
    from .canon import reading_classes

    return reading_classes(_t(spark, d, "chapter"), "id", ["text_ja", "text_zh"])


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every Japanese and Chinese chapter text, by its length and print."""
    from .canon import canonical

    texts = _t(spark, d, "chapter").select("id", "text_ja", "text_zh").withColumns({c: canonical(F.col(c)) for c in ("text_ja", "text_zh")})
    return texts.select("id", *(f(F.col(c)).alias(f"{n}_{c[-2:]}") for c in ("text_ja", "text_zh") for n, f in (("chars", F.length), ("print", F.md5)))).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every chapter text."""
    from .sentences import fit_stripped, sentence_spans

    ch = _t(spark, d, "chapter").select("id", "text_ja", "text_en", "text_zh")
    df = sentence_spans(ch, "id", {"text_ja": True, "text_en": False, "text_zh": True}, fit_stripped(ch, "id", ["text_ja", "text_zh"]))
    return df.withColumnRenamed("id", "chapter_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    from .leak import leaks

    return leaks(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_item").select("item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items of whose passage they hold at least half the sentences."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_exposed_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents expose each test item, and the most sentences that one holds."""
    return _leaks(spark, d).distinct().groupBy("item_id").agg(F.count("*").alias("documents"), F.max("held").alias("most_held"), F.max("of").alias("sentences"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from .mix import token_counts

    docs = _t(spark, d, "documents").select("doc_id", "source", "text")
    return token_counts(docs, "text", str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in order of (slot, offset): every taken document by its parts in blocks, with pass, release time, deadline and slot."""
    from .mix import schedule

    return schedule(_sized(spark, d), _t(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the mixture per source."""
    from .mix import report

    return report(_sized(spark, d), _t(spark, d, "mix_target"))


def _scores(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    from .abuse import fit, scores

    docs = _t(spark, d, "documents")
    return scores(docs, fit(docs.select("doc_id", "text"), _t(spark, d, "doc_label").select("doc_id", "kind")), keep)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual sentences, by kind."""
    from .abuse import KINDS

    flags = F.array(*[F.when(F.col(k) >= 0.5, F.lit(k)) for k in KINDS])
    return _scores(spark, d, ["doc_id"]).select("doc_id", F.explode(F.array_compact(flags)).alias("kind")).distinct()


def p9_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of the documents of each source that hold content of each kind, and their mean scores."""
    from .abuse import KINDS

    own = _scores(spark, d, ["doc_id", "source"]).distinct().groupBy(F.lower(F.trim("source")).alias("source"))
    return own.agg(F.count("*").alias("documents"), *[x for k in KINDS for x in (F.avg((F.col(k) >= 0.5).cast("double")).alias(f"{k}_rate"), F.avg(k).alias(f"{k}_score"))])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
