"""Text functions as column builders; built-in functions only, but for the two that Spark lacks."""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KANA, _HAN = "[\\u3040-\\u309f\\u30a0-\\u30ff]", "[\\u4e00-\\u9fff]"
#: Letters, digits and the underscore, of any script.
WORD = "[\\p{L}\\p{N}_]+"
SENTENCE_END = {"en": "[.!?]+", "ja": "[。！？]+", "zh": "[。！？\\n]+"}


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def first_text(*columns: str) -> Column:
    """The first of the columns that isn't empty, else the empty string."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def language(c: Column) -> Column:
    """ja if there is kana, zh if there are Han characters, else en (also for null and empty)."""
    return F.when(c.rlike(_KANA), "ja").when(c.rlike(_HAN), "zh").otherwise("en")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def marks(c: Column) -> Column:
    """The characters that aren't white space, as an array."""
    return F.filter(F.split(F.regexp_replace(c, "(?U)\\s", ""), ""), lambda x: x != "")


def non_blank(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike("(?U)\\S"))


def sentences(c: Column, lang: str) -> Column:
    return non_blank(F.split(c, SENTENCE_END[lang]))


def paragraphs(c: Column) -> Column:
    """Split at blank lines if the text is hard-wrapped, else at every line break."""
    wrapped = c.rlike("[a-zA-Z0-9,]\\r?\\n[a-z]")
    return F.transform(non_blank(F.when(wrapped, F.split(c, "(?:\\r?\\n\\s*){2,}")).otherwise(F.split(c, "[\\r\\n]+"))), strip)


def count_word(c: Column, terms: list[str]) -> Column:
    """How often the terms stand in ``c`` as whole words, each counted on its own (so overlapping phrases count twice)."""
    single = [t for t in terms if " " not in t and "-" not in t]
    total = F.regexp_count(c, F.lit("(?U)\\b(?:" + "|".join(single) + ")\\b")) if single else F.lit(0)
    for t in terms:
        if t not in single:
            total = total + F.when(c.contains(t), F.regexp_count(c, F.lit(f"(?U)\\b{t}\\b"))).otherwise(0)  # most phrases are absent
    return total


def _overlap(a: str, b: str) -> bool:
    """Whether occurrences of two different terms can share characters."""
    return a == b or a in b or b in a or any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(1, min(len(a), len(b))))


def disjoint_groups(terms: list[str]) -> list[list[str]]:
    """The terms in groups whose occurrences never overlap, so that one pass with an alternation counts a whole group."""
    groups: list[list[str]] = []
    for t in terms:
        for g in groups:
            if not any(_overlap(t, x) for x in g):
                g.append(t)
                break
        else:
            groups.append([t])
    return groups


def count_part(c: Column, terms: list[str]) -> Column:
    """How often the terms stand in ``c`` as substrings, without overlap of a term with itself; a term given twice counts twice."""
    total = F.lit(0)
    for g in disjoint_groups(terms):
        total = total + F.regexp_count(c, F.lit("|".join(g)))
    return total


def cjk(term: str) -> bool:
    return any("\u3040" <= ch <= "\u30ff" or "\u4e00" <= ch <= "\u9fff" for ch in term)


def count_markers(c: Column, terms: list[str]) -> Column:
    """Occurrences in lower-case text: whole words for Latin terms, substrings for others."""
    low = F.lower(F.coalesce(c, F.lit("")))
    latin, other = [t for t in terms if not cjk(t)], [t for t in terms if cjk(t)]
    return count_word(low, latin) + count_part(low, other)


def distinct_markers(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur at all."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = [low.contains(t) if cjk(t) else low.rlike(f"(?U)\\b{t}\\b") for t in terms]
    total = F.lit(0)
    for h in hits:
        total = total + h.cast("int")
    return total


def clean_english(c: Column) -> Column:
    """Without the notes of translators and editors, also across lines."""
    names = "(?:TL\\s*note|T/N|Editor's\\s*note|EN|TN)"
    return strip(F.regexp_replace(c, f"(?is)(?:\\[{names}:.*?\\]|\\({names}:.*?\\))", ""))


def chapter_number(c: Column) -> Column:
    """The number after the word chapter (or ch), else a number at the start, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(?i)ch(?:apter)?\\s*(\\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, "^(\\d+)", 1), F.lit(""))).cast("int")


def header_parts(src: Column, trg: Column) -> dict[str, Column]:
    """Number, titles and bodies of a parallel chapter whose first lines may be headers; without a number the bodies stay whole."""
    one, two = F.split(strip(src), "\n")[0], F.split(strip(trg), "\n")[0]
    number_ja = F.nullif(F.regexp_extract(one, "^(\\d+)[.．\\s]", 1), F.lit("")).cast("int")
    number = F.coalesce(number_ja, chapter_number(two))
    rest = lambda c: strip(F.regexp_replace(strip(c), "^[^\\n]*\\n?", ""))
    title_ja = F.when(number_ja.isNotNull(), strip(F.regexp_replace(one, "^\\d+[.．\\s]", ""))).otherwise(one)
    title_en = F.when(two.rlike("(?i)^(?:c?hapter|ch)\\s*\\d+"), strip(F.regexp_replace(two, "(?i)^(?:c?hapter|ch)\\s*\\d+[\\s:.\\-]*", ""))).otherwise(strip(F.regexp_replace(two, "^\\d+[\\s:.\\-]*", "")))
    header = number.isNotNull()
    return {
        "chapter_number": number,
        "title_ja": F.when(header, title_ja).otherwise("Chapter "),
        "title_en": F.when(header, title_en).otherwise("Chapter "),
        "body_ja": F.when(header, rest(src)).otherwise(src),
        "body_en": F.when(header, rest(trg)).otherwise(trg),
    }


def generic_title(title: Column, number: Column) -> Column:
    return F.when(title.isin("Chapter", "Chapter "), F.concat(F.lit("Chapter "), number.cast("string"))).otherwise(title)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def _plain(markup: str) -> str:
    p = _Text()
    p.feed(markup)
    p.close()
    return html.unescape("".join(p.out))


def clean_html(c: Column) -> Column:
    """Text of markup: line breaks for br, blank lines after blocks, entities decoded, at most one blank line in a row."""

    @F.pandas_udf(StringType())
    def tags(s: pd.Series) -> pd.Series:
        return s.map(_plain, na_action="ignore")

    broken = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)<br\\s*/?>", "\n"), "(?i)</(?:p|div|li|h[1-6])>", "\n\n")
    return strip(F.regexp_replace(F.regexp_replace(tags(broken), "\\r\\n", "\n"), "\\n{3,}", "\n\n"))


def clean_japanese(c: Column, drop_bar_first: bool = False) -> Column:
    """NFKC, then without ruby in 《》.  A full-width bar becomes a plain bar by NFKC and stays, unless it is dropped first."""

    @F.pandas_udf(StringType())
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    src = F.coalesce(c, F.lit(""))
    return F.regexp_replace(nfkc(F.replace(src, F.lit("｜"), F.lit("")) if drop_bar_first else src), "《.*?》", "")


def sample_words(c: Column, target: int = 1000) -> Column:
    """The first words of a short text; of one of 15,000 characters or more a third each from behind 20, 50 and 80 %, from the next blank line on."""
    each = target // 3

    def part(share: float) -> Column:
        start = F.floor(F.length(c) * F.lit(share)).cast("int")
        rest = F.substring(c, start + 1, F.lit(2_147_483_000))
        gap = F.length(F.regexp_extract(rest, "(?s)^(.*?\\n\\s*\\n)", 1))
        return F.array_join(F.slice(non_blank(F.split(F.substring(rest, gap + 1, F.lit(each * 12)), "(?U)\\s+")), 1, each), " ")

    short = F.array_join(F.slice(non_blank(F.split(c, "(?U)\\s+")), 1, target), " ")
    return F.when(F.length(c) < 15_000, short).otherwise(F.concat_ws("\n\n", part(0.2), part(0.5), part(0.8)))


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts of a delimited string."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip), lambda x: x != "")
