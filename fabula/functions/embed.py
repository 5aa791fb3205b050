"""Pluggable text embedders.  The default hashes words and word pairs, needs no model and gives the same vector everywhere."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .text import non_blank

_WORD = re.compile(r"[぀-ヿ一-鿿]|\w+")


class HashingEmbedder:
    """Unit vectors by signed hashing; the zero vector for texts without a word."""

    def __init__(self, dim: int = 384, most: int = 2000):
        self.dim, self.most = dim, most

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            words = _WORD.findall((t or "")[: self.most].lower())
            for term in (*words, *map(" ".join, zip(words, words[1:]))):
                h = zlib.crc32(term.encode())
                out[i, h % self.dim] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(c: Column, make: Callable[[], Callable[[list], np.ndarray]] = HashingEmbedder) -> Column:
    """Vectors of a text column; ``make`` is called once per worker, so a model is loaded once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for s in batches:
            yield pd.Series(list(embedder(s.tolist())))

    return run(c)


def windows3(c: Column, words: int = 300) -> list[Column]:
    """Slices of a text from its start, 25 % and 60 %, moved behind the next blank line if that comes within 500 characters."""

    def part(share: float) -> Column:
        rest = F.substring(c, F.floor(F.length(c) * share).cast("int") + 1, F.lit(2_147_483_000))
        gap = F.length(F.regexp_extract(rest, "(?s)^(.*?\\n\\s*\\n)", 1))
        body = F.substring(rest, F.when(gap < 500, gap).otherwise(0) + 1, F.lit(words * 12))
        return F.array_join(F.slice(non_blank(F.split(body, "(?U)\\s+")), 1, words), " ")

    return [part(s) for s in (0.0, 0.25, 0.60)]


def with_prose_vector(df: DataFrame, text: str, name: str = "vector", make: Callable = HashingEmbedder) -> DataFrame:
    """Adds the unit sum of the three windows' vectors, weighted 0.50, 0.25 and 0.25 (pooled beside the embedder, where the vectors are)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        embedder = make()
        for three in batches:
            v = sum(w * embedder(s.tolist()).astype(np.float64) for w, s in zip((0.50, 0.25, 0.25), three))
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(n > 0, n, 1)))

    return df.withColumn(name, run(*[F.when(w == "", "sample prose text").otherwise(w) for w in windows3(F.col(text))]))


def concept_text(title: Column, setting: Column, genre: Column, catalyst: Column, plot: Column, tags: Column, territory: Column) -> Column:
    """Parts that are there, joined by full stops; the genre only without a setting; "fiction" without any."""
    has = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    part = lambda name, c: F.concat(F.lit(f"{name}: "), has(c))
    name = F.when(has(title) != "Unknown Title", has(title))
    text = F.concat_ws(". ", name, F.coalesce(part("Setting", setting), part("Genre", genre)), part("Catalyst", catalyst), part("Plot", plot), part("Tropes", tags), part("Tradition", territory))
    return F.when(text == "", "fiction").otherwise(text)
