"""Several values packed in one field: one row per value with its position.

Dictionary-guided segmentation.  A multi-pattern automaton finds the whole known
values in a field; dynamic programming over the places between separators picks
the cover with the most text inside known values, then the fewest values, so that
a separator inside a known value, a quoted value or behind a backslash stays.

Defined results: null, empty and separator-only fields give no row; a quote that
is never closed is an ordinary character; repeats keep their places; texts of any
length are handled whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the same matches by a regular expression
    ahocorasick = None

SEPARATORS = ",;|/、，；｜·・／\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "「": "」", "『": "』", "`": "`", "‘": "’", "«": "»"}
_BRACKETS = {"[": "]", "{": "}", "(": ")", "【": "】"}
_BRACKETED = re.compile(r"\s*(?:\[[^\[\]]*\]\s*)+")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str, quote: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        return chr(int(c[1:], 16)) if len(c) == 5 else _CONTROL.get(c, c) if quote else c

    return _ESCAPE.sub(one, text.replace(quote * 2, quote) if quote else text)


def finder(known: Iterable[str]) -> Callable[[str], list[tuple[int, int]]]:
    """The places [a, b) where known values stand, without regard to case."""
    words = sorted({w.strip().lower() for w in known if w and any(c in SEPARATORS for c in w)})
    if not words:
        return lambda text: []
    if ahocorasick is not None:
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, len(w))
        machine.make_automaton()
        return lambda text: [(end + 1 - n, end + 1) for end, n in machine.iter(text.lower())] if len(text.lower()) == len(text) else []
    pattern = re.compile("(?=(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + "))")
    return lambda text: [m.span(1) for m in pattern.finditer(text.lower())]


def _quoted(text: str, at: int, separators: str) -> int:
    """End of the quotation that opens at ``at``; 0 if it never closes before a separator or the end."""
    close = QUOTES[text[at]]
    i = at + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 2
            continue
        if text[i] == close:
            if close in "\"'" and text[i + 1 : i + 2] == close and text[i + 2 : i + 3] != "" or close in "\"'" and text[i : i + 3] == close * 3:
                i += 2
                continue
            rest = text[i + 1 :].lstrip(" 　")
            if not rest or rest[0] in separators or rest[0] in "]})】":
                return i + 1
        i += 1
    return 0


def split_packed(text: str | None, find: Callable[[str], list[tuple[int, int]]], separators: str = SEPARATORS) -> list[str]:
    """The values of one field in written order, empty ones left out."""
    if not text or not text.strip():
        return []
    text = text.strip()
    if text[0] == "[" and _BRACKETED.fullmatch(text) and text.count("[") > 1:
        return [v for part in re.findall(r"\[([^\[\]]*)\]", text) for v in ([part.strip()] if part.strip() and part.strip()[0] not in QUOTES else split_packed(part, find, separators))]
    if text[0] in _BRACKETS and text[-1] == _BRACKETS[text[0]] and len(text) > 1:
        return split_packed(text[1:-1], find, separators)
    n = len(text)
    # Quotations and escaped characters hold no separator; a known value counts where it fills a place between separators.
    cuts, quoted, i, fresh = [-1], {}, 0, True
    while i < n:
        c = text[i]
        if fresh and c in QUOTES and (end := _quoted(text, i, separators)):
            quoted[i] = end
            i, fresh = end, False
        elif c == "\\" and i + 1 < n:
            i, fresh = i + 2, False
        elif c in separators:
            cuts.append(i)
            i, fresh = i + 1, True
        else:
            fresh = fresh and c.isspace()
            i += 1
    cuts.append(n)
    place = {c: k for k, c in enumerate(cuts)}
    jumps: dict[int, list[tuple[int, int]]] = {}
    for a, b in find(text):
        left, right = a, b
        while left > 0 and text[left - 1].isspace() and left - 1 not in place:
            left -= 1
        while right < n and text[right].isspace() and right not in place:
            right += 1
        if left - 1 in place and right in place:
            jumps.setdefault(place[left - 1], []).append((place[right], b - a))
    # Best cover of the places between cuts: (text in known values, fewer values), from the end.
    last = len(cuts) - 1
    best: list = [None] * (last + 1)
    best[last] = (0, 0, -1)
    for k in range(last - 1, -1, -1):
        choices = [(best[k + 1][0], best[k + 1][1] - 1, k + 1)] + [(best[j][0] + w, best[j][1] - 1, j) for j, w in jumps.get(k, ())]
        best[k] = max(choices)
    out, k = [], 0
    while k < last:
        j = best[k][2]
        piece = text[cuts[k] + 1 : cuts[j]]
        lead = len(piece) - len(piece.lstrip())
        body = piece.strip()
        start = cuts[k] + 1 + lead
        if start in quoted and quoted[start] == start + len(body):
            value = _unescape(body[1:-1], body[0]).strip()
        else:
            value = _unescape(body, "").strip()
            if len(value) > 1 and value[0] in "[【" and value[-1] == _BRACKETS[value[0]]:
                value = value[1:-1].strip()
        if value:
            out.append(value)
        k = j
    return out


def unpack(df: DataFrame, key: str, fields: list[str], known: DataFrame, most: int = 100_000) -> DataFrame:
    """(key, field_name, pos, val, n) of every value of the packed ``fields``; n is the number of values in the field.

    ``known`` has one column, the known values; they are sent to every task, so more than ``most`` are refused.  Other columns are dropped and
    repeated rows of a key count once.
    """
    words = [r[0] for r in known.distinct().limit(most + 1).collect() if r[0]]
    if len(words) > most:
        raise ValueError(f"more than {most} known values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = finder(words), {}
        for batch in batches:
            for c, name in enumerate(fields):
                rows, values = [], []
                for i, text in enumerate(batch.column(c + 1).to_pylist()):
                    if not text:
                        continue
                    got = memo.get(text)
                    if got is None:
                        if len(memo) > 50_000:
                            memo.clear()
                        got = memo[text] = split_packed(text, find)
                    if got:
                        rows.append(i)
                        values.append(got)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([name] * len(rows), pa.string()), pa.array(values, pa.list_(pa.string()))], [key, "field_name", "vals"])

    kind = df.schema[key].dataType.simpleString()
    packed = df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field_name string, vals array<string>").distinct()
    return packed.select(key, "field_name", F.posexplode("vals").alias("p", "val"), F.size("vals").alias("n")).select(key, "field_name", (F.col("p") + 1).alias("pos"), "val", "n")
