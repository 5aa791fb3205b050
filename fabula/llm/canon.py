"""One consistent form for text that looks the same.

Quick check: a class of the characters that are not stable under the form (their
NFKC quick-check property is No or Maybe, or they are invisible, an odd space or
a look-alike).  Only runs of such characters, together with the character before
them with which they may compose, are normalised; the canonical segments are
spliced into the unchanged rest.  Each distinct segment is normalised once per
task and remembered.

``canonical`` keeps text readable: NFKC, one kind of space and line break, no
invisible characters, and letters of another script only where they stand among
letters of that script.  ``skeleton`` further maps each family of look-alikes to
one member and is meant for comparison only.

Defined results: null stays null; a text of invisible characters only becomes the
empty string; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.lineage import cut

#: Look-alikes across scripts, each followed by the Latin letter that it looks like.
LATIN_ALIKE = "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX аa сc ԁd еe ɡg һh іi јj кk оo рp ԛq ѕs ԝw хx уy ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp κk ɑa ı​i".replace("​", "").split()
#: Kanji, kana and signs that look alike; the first member stands for its family in a skeleton.
KANA_ALIKE = "ロ口囗 カ力 ニ二 エ工 ハ八 タ夕 ト卜 オ才 チ千 ミ三 へヘ べベ ぺペ りリ ー一―—–‐‑−─━ ・·‧•∙･ 〜～~".split()
_SPACE = re.compile(r"[^\S\n]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵​-‏‪-‮⁠-⁯ㅤ﻿ﾠ︀-️\U000e0100-\U000e01ef\U000e0000-\U000e007f]")
_TO_LATIN = {ord(p[0]): p[1] for p in LATIN_ALIKE}
_TO_KANA = {ord(c): f[0] for f in KANA_ALIKE for c in f[1:]}


def _ranges(keep: Callable[[str], bool]) -> str:
    """Character class of the characters of the basic plane that ``keep`` holds."""
    ranges: list[list[int]] = []
    for c in range(0x10000):
        if not 0xD800 <= c <= 0xDFFF and keep(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges) + "]"


def _joins(ch: str) -> bool:
    """Whether the character may compose with the one before it."""
    return unicodedata.combining(ch) != 0 or ch in "ﾞﾟ" or 0x1160 <= ord(ch) <= 0x11FF


def _changes(extra: str) -> Callable[[str], bool]:
    """Whether the form may change the character."""
    def keep(ch: str) -> bool:
        if ch < "\x80":
            return ch in extra or ch in "\t\v\f\r"
        return ch in extra or _joins(ch) or not unicodedata.is_normalized("NFKC", ch) or bool(_INVISIBLE.match(ch)) or (ch.isspace() and ch != "\n") or ord(ch) in _TO_LATIN

    return keep


_RUNS: dict[bool, tuple[re.Pattern, re.Pattern, re.Pattern]] = {}


def _runs(compare: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Patterns of a joining character, of the unstable segments, and of those with one character of context before.

    Characters beyond the basic plane all count as unstable; most of them come back as they are.
    """
    if compare not in _RUNS:
        one = f"(?:{_ranges(_changes(''.join(f[1:] for f in KANA_ALIKE) if compare else ''))}|[\U00010000-\U0010ffff])+"
        _RUNS[compare] = (re.compile(_ranges(_joins)), re.compile(one), re.compile(r"[^\n]?" + one))
    return _RUNS[compare]


def _segment(piece: str, compare: bool) -> str:
    out = unicodedata.normalize("NFKC", _INVISIBLE.sub("", piece.replace("\r\n", "\n")).replace("\r", "\n"))
    out = _SPACE.sub(" ", _INVISIBLE.sub("", out)).translate(_TO_LATIN)
    return out.translate(_TO_KANA) if compare else out


_FOREIGN = re.compile("[Ͱ-ϿЀ-ӿ]{2,}")


def former(compare: bool = True) -> Callable[[str], str]:
    """The function that brings one text to its skeleton (``compare``) or to its canonical form."""
    known: dict[str, str] = {}
    joining, alone, with_context = _runs(compare)

    def one(m: re.Match) -> str:
        piece = m.group()
        got = known.get(piece)
        if got is None:
            if len(known) > 200_000:  # bounds the memory of a task; the segments are only worked out again
                known.clear()
            got = known[piece] = _segment(piece, compare)
        return got

    def form(text: str) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not compare and _FOREIGN.search(text):  # words of that script: its letters are no look-alikes there
            return unicodedata.normalize("NFKC", _SPACE.sub(" ", _INVISIBLE.sub("", text)))
        # Runs are maximal, so no mark of a next segment can meet this one; where nothing can join, no context is needed either.
        return (with_context if joining.search(text) else alone).sub(one, text)

    return form


def canonical(column, compare: bool = False):
    """Column of canonical texts (or skeletons)."""

    def run(batches: Iterator) -> Iterator:
        form = former(compare)
        for s in batches:
            yield s.map(form, na_action="ignore")

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())(column)


def _long(data: bytes) -> int:
    return int.from_bytes(data, "little", signed=True)


def prints(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Of each text that isn't empty: ``key``, ``field_name``, the 128-bit print (k1, k2) of its skeleton and the 64-bit print of the stored string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = former(True)
        for batch in batches:
            for c, name in enumerate(fields):
                rows, k1, k2, raw = [], [], [], []
                for i, text in enumerate(batch.column(c + 1).to_pylist()):
                    if not text:
                        continue
                    data = hashlib.blake2b(form(text).strip().encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append(i)
                    k1.append(_long(data[:8]))
                    k2.append(_long(data[8:]))
                    raw.append(_long(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([name] * len(rows), pa.string()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(raw, pa.int64())], [key, "field_name", "k1", "k2", "raw"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInArrow(run, f"{key} {kind}, field_name string, k1 long, k2 long, raw long")


def reading_classes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per row and field that reads like another one stored otherwise: ``key``, ``field_name``, ``class_id`` (least key of the reading),
    ``form_id`` (least key with the same stored string), ``forms`` and ``members`` of the reading, and ``links``, its members in other forms.

    Only prints are shuffled; counts are pre-aggregated by stored form, so copies of one string meet as one row.  Repeated rows of a key count once.
    """
    rows = cut(prints(df, key, fields).distinct())
    reading = ["field_name", "k1", "k2"]
    forms = rows.groupBy(*reading, "raw").agg(F.count("*").alias("own"), F.min(key).alias("form_id"))
    several = forms.groupBy(*reading).agg(F.sum("own").alias("members"), F.count("*").alias("forms"), F.min("form_id").alias("class_id")).where("forms > 1")
    wanted = forms.join(several, reading).select("field_name", "k1", "k2", "raw", "class_id", "form_id", "forms", "members", (F.col("members") - F.col("own")).alias("links"))
    return rows.join(wanted, [*reading, "raw"]).select(key, "field_name", "class_id", "form_id", "forms", "members", "links")


def same_reading(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Pairs (id_a < id_b, field_name) of rows whose field reads the same but isn't the same string: the links of ``reading_classes`` written out.

    The pairs of a reading are those of different forms only, so that copies of one string pair with nothing.
    """
    left = cut(reading_classes(df, key, fields).select(key, "field_name", "class_id", "form_id"))
    a, b = left.alias("a"), left.alias("b")
    on = (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.form_id") != F.col("b.form_id")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return a.join(b, on).select(F.col(f"a.{key}").alias("id_a"), F.col(f"b.{key}").alias("id_b"), F.col("a.field_name").alias("field_name"))
