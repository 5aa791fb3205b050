"""Sentence alignment of bilingual (Japanese and English) documents.

1. Learn: sentences that share enough anchors (names by their sound, numbers,
   glossary terms) and are each other's best match over the whole corpus give
   pairs, whose pieces are counted together (pre-aggregated in the tasks) into a
   table of Japanese pieces and the English words they go with.
2. Retrieve: each Japanese sentence becomes a weighted bag of anchors and likely
   English words; inverted lists of the document's sentences give the best
   partner of every sentence in both directions; mutual best partners match.
3. Grow: a sentence left over joins a match of its neighbour if its own bag
   explains what the match leaves unexplained in the partner.

Counts cover all documents; the table keeps every word whose Dice value with a piece
is at least ``least`` (that bounds it: a piece has few such words), and its size is
checked before it is sent.

Defined results: documents without sentences on one side give no pair; English
sentences written in Japanese, remarks and lines without letters pair with
nothing; repeated documents count once in the distinct result.
"""

from __future__ import annotations

import marshal
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse, product, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .canon import _TO_KANA, former
from .sentences import segment_batch

_ROWS = {"k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾヂヅ", "t": "タチツテト", "d": "ダデド", "n": "ナニヌネノン", "h": "ハヒヘホ", "f": "フ", "b": "バビブベボヴ", "p": "パピプペポ", "m": "マミムメモ", "y": "ヤユヨ", "r": "ラリルレロ", "w": "ワヲ"}
_SOUND = {kana: c for c, row in _ROWS.items() for kana in row}
_SMALL = "ァィゥェォャュョッー"
_KANA_NAME = re.compile(r"[ァ-ヴー口力二工八夕卜才千三]{2,}")
_DROP, _VOWEL, _TWICE = re.compile(r"(?<=[^aeiou])h$|(?<=[^aeiouy])y(?=[aeiou])|[^a-z]"), re.compile(r"[aeiou]|y$"), re.compile(r"(.)\1+")
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_NUMBER = re.compile(r"\d+(?:\.\d+)*|[〇零一二三四五六七八九十百千]+")
_ALL_KANA, _KANA = re.compile("[ァ-ヴー]+"), re.compile("[ァ-ヴ]")
_PART = re.compile(r"(?:#|[^\W\d_ァ-ヴー]){2,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_HIRAGANA = re.compile("[ぁ-ゖ]{2,}")
_HIRAGANA_PAIRS = frozenset(x + y for x, y in product(map(chr, range(ord("ぁ"), ord("ゖ") + 1)), repeat=2))
_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:[’'][a-z]+)?|\d+(?:\.\d+)*")
#: Words that go with everything and tell nothing.
_COMMON = frozenset("the of and to in on at by for was were had has have who that would not out but nor than from with without".split())
_REMARK = re.compile(r"^\s*[\[(（]\s*(?:T/?N|TL|Editor|Translator|Note|PR)\b", re.I)
#: Weights of the anchors.
NAME, NUMBER, TERM, LEARNED = 1.5, 3.0, 2.0, 0.9
#: Bits of the kinds of anchors that count something, or name some thing.
_KINDS = {"#": 1, "T": 2}


@lru_cache(100_000)
def kana_sound(word: str) -> str:
    """Consonant skeleton of a katakana word."""
    out = []
    for i, c in enumerate(word):
        if c == "ウ" and word[i + 1 : i + 2] in tuple("ァィェォ"):
            out.append("w")
        elif c not in _SMALL and (s := _SOUND.get(c)):
            out.append(s)
    return _TWICE.sub(r"\1", "".join(out))


@lru_cache(100_000)
def latin_sound(word: str) -> str:
    """Consonant skeleton of a name in Latin letters, comparable with that of its kana."""
    w = word.lower().replace("’", "'").split("'")[0]
    for a, b in (("sh", "s"), ("ch", "t"), ("ts", "t"), ("ph", "f"), ("th", "t"), ("x", "ks"), ("c", "k"), ("q", "k"), ("l", "r"), ("v", "b"), ("j", "z")):
        w = w.replace(a, b)
    w = _DROP.sub("", w)
    return _TWICE.sub(r"\1", _VOWEL.sub("", w))


def kanji_number(text: str) -> str:
    if text[0].isdigit():
        return text
    if not re.search("[十百千]", text):
        return "".join(str(_DIGITS[c]) for c in text)
    total, unit = 0, 0
    for c in text:
        if c in _DIGITS:
            unit = unit * 10 + _DIGITS[c]
        else:
            total += max(unit, 1) * {"十": 10, "百": 100, "千": 1000}[c]
            unit = 0
    return str(total + unit)


class Reader:
    """Sentences of one document with their anchors, words and lines."""

    def __init__(self, glossary: list[tuple[str, str]]):
        self.form = former(False)
        self.ja_names, self.en_names, self.ja_things, self.en_things = {}, {}, {}, {}
        for k, (en, ja) in enumerate(glossary):
            if en and ja:
                ja, name = self.form(ja), en[:1].isupper() and " " not in en and bool(_KANA_NAME.fullmatch(self.form(ja)))
                key = (self.ja_names if name else self.ja_things).setdefault(ja, f"{'P' if name else 'T'}{k}")
                (self.en_names if name else self.en_things).setdefault(en.lower(), key)
        any_of = lambda terms: "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) or r"(?!)"
        self.ja_re = re.compile(f"(?=[{re.escape(''.join(sorted({t[0] for t in self.ja_things})))}])(?:{any_of(self.ja_things)})" if self.ja_things else r"(?!)")
        self.en_re = re.compile(rf"\b(?:{any_of(self.en_things)})\b")
        self.kana_name, self.en_word = lru_cache(100_000)(self._kana_name), lru_cache(100_000)(self._en_word)

    def _kana_name(self, name: str) -> tuple[list[tuple[str, float]], str, set | None]:
        """Anchors of a katakana name, its word, and the keys that an English name would have if it may be a loan word."""
        word = name if _ALL_KANA.fullmatch(name) else name.translate(_TO_KANA)
        anchors, loan = [], None
        if (key := self.ja_names.get(word)) is not None:
            anchors.append((key, TERM))
        if len(_KANA.findall(name)) >= 2:
            sound = kana_sound(word)
            loan = {"N" + sound, key}
            if sound:
                anchors.append(("N" + sound, NAME))
        return anchors, word, loan

    def ja(self, s: str) -> tuple[dict[str, float], set[str], dict[str, set]]:
        anchors: dict[str, float] = {}
        loans: dict[str, set] = {}
        bare = s
        if numbers := _NUMBER.findall(s):
            bare = _NUMBER.sub("#", s)
            for m in numbers:
                n = kanji_number(m)
                if m[0].isdigit() or len(n) > 1:
                    anchors["#" + n] = NUMBER
        for t in self.ja_re.findall(s):
            anchors[self.ja_things[t]] = TERM
        for name in _KANA_NAME.findall(s):
            more, word, loan = self.kana_name(name)
            anchors.update(more)
            if loan is not None:
                loans[word] = loan
        grams = set(_HIRAGANA.findall(s))
        for part in _PART.findall(bare):
            grams.update(filterfalse(_HIRAGANA_PAIRS.__contains__, map(add, part, part[1:])))
        return anchors, grams, loans

    def _en_word(self, w: str) -> tuple:
        """Lower-case form, key of the glossary and sound of a word with a capital letter."""
        return w.lower(), self.en_names.get(w.lower()), "N" + latin_sound(w)

    def en(self, s: str, names: set[str]) -> tuple[dict[str, float], list[str]]:
        anchors: dict[str, float] = {}
        for t in self.en_re.findall(s.lower()):
            anchors[self.en_things[t]] = TERM
        words = set()
        for i, w in enumerate(_WORD.findall(s)):
            c = w[0]
            if c.islower():
                if len(w) > 2:
                    words.add(w)
            elif c.isdigit():
                anchors["#" + w.rstrip(".")] = NUMBER
            elif len(w) > 1:
                low, key, sound = self.en_word(w)
                if key is not None:
                    anchors[key] = TERM
                if sound in names or (i and len(sound) > 2 and not w.isupper()):
                    anchors[sound] = NAME
                else:
                    words.add(low)
        return anchors, sorted(words - _COMMON)

    def read(self, ja: list[str], en: list[str]) -> Iterator[tuple[list, list]]:
        """Of each document ([(line, anchors, pieces)], [(line, anchors, words)])."""
        sides: list = []
        for texts, every in ((ja, True), (en, False)):
            rows: list = [[] for _ in texts]
            texts = [t if t.isascii() else self.form(t) for t in texts]  # line breaks keep their places
            for k, text, spans, _ in segment_batch(texts, (every for _ in texts)):
                number, at, line = {}, 0, 0
                for part in text.split("\n"):
                    if part.strip():
                        line += 1
                    number[at] = line
                    at += len(part) + 1
                for a, b in spans:
                    rows[k].append((number[text.rfind("\n", 0, a) + 1], text[a:b]))
            sides.append(rows)
        for one, two in zip(*sides):
            left = [(line, *self.ja(x)) for line, x in one]
            names = {a for _, anchors, _, _ in left for a in anchors if a[0] == "N"}
            right = [(line, *self.en(x, names)) for line, x in two if not _CJK.search(x) and not _REMARK.match(x)]
            # Katakana words that no English name of the document answers may be loan words.
            known = {a for _, anchors, _ in right for a in anchors}
            for _, _, grams, loans in left:
                grams.update(w for w, keys in loans.items() if known.isdisjoint(keys))
            yield [(line, anchors, list(grams)) for line, anchors, grams, _ in left], right


def pack(left: list, right: list) -> bytes:
    """What a :class:`Lot` needs of a document, as bytes; pieces and words hold no space."""
    shared, weights, kinds = anchor_lists(left, right)
    ints = lambda x: array("i", x).tobytes()
    fields = [field for side, weight, kind in zip((left, right), weights, kinds) for field in (ints([x[0] for x in side]), ints([len(x[2]) for x in side]), " ".join([w for x in side for w in x[2]]), array("d", weight).tobytes(), bytes(kind))]
    return marshal.dumps((*fields, ints(shared[0]), array("d", shared[1]).tobytes(), bytes(shared[2]), ints(shared[3]), ints(shared[4])))


class Lot:
    """Documents in flat arrays, sentences numbered through; of either side ``line``, ``doc``, ``held`` (number of pieces or words), ``tokens`` (these),
    ``weight`` of the anchors and ``kinds`` of them (bits); ``start``: first sentence of each document, ``i``, ``j``, ``add``, ``kind``: shared anchors."""

    def __init__(self, blobs: list[bytes]):
        fields = list(zip(*map(marshal.loads, blobs)))
        numbers = lambda k, kind: np.frombuffer(b"".join(fields[k]), kind)
        self.line, self.held, self.weight, self.kinds = ([numbers(k + side, kind) for side in (0, 5)] for k, kind in ((0, np.int32), (1, np.int32), (3, np.float64), (4, np.uint8)))
        self.tokens = [" ".join(filter(None, fields[2 + side])).split(" ") if any(fields[2 + side]) else [] for side in (0, 5)]
        sizes = [np.array([len(x) // 4 for x in fields[side]], np.int64) for side in (0, 5)]
        self.start = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
        self.doc = [np.repeat(np.arange(len(n)), n) for n in sizes]
        self.n = [len(x) for x in self.line]
        many = numbers(13, np.int32)
        shared = np.repeat(self.start[0][:-1], [len(x) for x in fields[12]]) + numbers(10, np.int32)
        self.i, self.add, self.kind = np.repeat(shared, many), np.repeat(numbers(11, np.float64), many), np.repeat(numbers(12, np.uint8), many)
        self.j = np.repeat(self.start[1][:-1], [len(x) // 4 for x in fields[14]]) + numbers(14, np.int32)


def lots(blobs: list[bytes], size: int = 400_000) -> Iterator[tuple[int, Lot]]:
    """All documents in lots of about ``size`` bytes, each with the number of its first document."""
    lo, held = 0, 0
    for k, blob in enumerate(blobs):
        held += len(blob)
        if held >= size or k + 1 == len(blobs):
            yield lo, Lot(blobs[lo : k + 1])
            lo, held = k + 1, 0


def _firsts(x: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array has another value than before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def _order(x: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below ``n``."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


class Pairs:
    """Sentence pairs that share something, found through inverted lists: (left, right) numbers ``i`` and ``j`` with what they share."""

    def __init__(self, n_left: int, n_right: int, i: np.ndarray, j: np.ndarray):
        """``i``, ``j``: the sentences of every meeting in a list."""
        order = _order(j, n_right)
        self.order = order = order[_order(i[order], n_left)]
        key = i[order] * max(1, n_right) + j[order]
        self.first = _firsts(key)
        self.key = key[self.first]
        self.i, self.j = self.key // max(1, n_right), self.key % max(1, n_right)
        self.sides = []
        for own, by in ((self.i, np.arange(len(self.i))), (self.j, _order(self.j, n_right))):
            first = _firsts(own[by])
            self.sides.append((by, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))))

    def total(self, of: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        """What the meetings add to each pair."""
        return how.reduceat(of[self.order], self.first) if len(self.first) else of[:0]

    def mutual(self, score: np.ndarray, least: float, lead: float = 0.0) -> np.ndarray:
        """Numbers of the pairs that are each other's best (ties: the first), at least ``least`` and, with ``lead``, alone within it on both sides."""
        good = score >= least
        if not len(score):
            return good.nonzero()[0]
        for by, first, group in self.sides:
            own = score[by]
            at = (own == np.maximum.reduceat(own, first)[group]).nonzero()[0]
            at = at[_firsts(group[at])]
            best = np.zeros(len(score), bool)
            best[by[at]] = True
            if lead:
                own[at] = -np.inf
                best[by[at]] = np.maximum.reduceat(own, first) <= score[by[at]] - lead
            good &= best
        return good.nonzero()[0]


def anchor_lists(left: list, right: list) -> tuple[tuple[list, list, list, list, list], tuple[list, list], tuple[list, list]]:
    """By inverted lists of every anchor of a left sentence that is shared: its left sentence, weight, kind and number of right sentences, and these;
    the anchor weights of the sentences of either side; their kinds of anchors."""
    lists: dict[str, list[int]] = {}
    for j, (_, anchors, _) in enumerate(right):
        for a in anchors:
            lists.setdefault(a, []).append(j)
    at, weight, kind, many, met = shared = ([], [], [], [], [])
    # An anchor that the other side of the document doesn't know at all tells nothing (a name that is spelled otherwise, a loan word).
    mine = {a for _, anchors, _ in left for a in anchors}
    weights, kinds = ([], []), ([], [])
    for i, (_, anchors, _) in enumerate(left):
        parts, bits = [], 0
        for a, w in anchors.items():
            bit = _KINDS.get(a[0], 0)
            bits |= bit
            if a in lists:
                at.append(i)
                weight.append(w)
                kind.append(bit)
                many.append(len(lists[a]))
                met += lists[a]
                parts.append(w)
            else:
                parts.append(w if bit == 1 else 0.3 * w)
        weights[0].append(sum(parts))
        kinds[0].append(bits)
    for _, anchors, _ in right:
        parts, bits = [], 0
        for a, w in anchors.items():
            bit = _KINDS.get(a[0], 0)
            bits |= bit
            parts.append(w if a in mine or bit == 1 else 0.3 * w)
        weights[1].append(sum(parts))
        kinds[1].append(bits)
    return shared, weights, kinds


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, hi), and of each the number of its range."""
    n = hi - lo
    spread = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n) + lo[spread], spread


def _with_empty(tokens: np.ndarray, held: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the chosen sentences with a 0 behind those of each, and of each the number of its sentence among the chosen."""
    edges = np.concatenate([[0], np.cumsum(held)])
    at, spread = _ranges(edges[chosen], edges[chosen + 1] + 1)
    return np.where(at == edges[chosen + 1][spread], 0, np.append(tokens, 0)[at]), spread


class Numbers(dict):
    """Numbers of strings in the order of their coming."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n

    def of(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))


class Table:
    """What Japanese pieces are likely to be in English, and what English words weigh."""

    def __init__(self, rows: list[tuple[str, str, float]], weight: dict[str, float]):
        self.word = {w: k for k, w in enumerate(weight)}
        self.value = LEARNED * np.minimum(np.array(list(weight.values()), np.float64), 4.0)
        rows = [r for r in rows if r[1] in self.word]
        self.piece: dict[str, int] = {}
        number = np.array([self.piece.setdefault(f, len(self.piece)) for f, _, _ in rows], np.int64)
        order = np.argsort(number, kind="stable")
        self.start = np.searchsorted(number[order], np.arange(len(self.piece) + 1))
        self.goes = np.array([self.word[e] for _, e, _ in rows], np.int64)[order]
        self.likely = np.array([p for _, _, p in rows], np.float64)[order]

    def of(self, piece: str) -> dict[str, float]:
        k = self.piece.get(piece)
        names = list(self.word)
        return {} if k is None else {names[w]: float(p) for w, p in zip(self.goes[self.start[k] : self.start[k + 1]], self.likely[self.start[k] : self.start[k + 1]])}


def learn(read: DataFrame, least: float = 0.05, most: int = 3_000_000) -> Table:
    """The table counted over all documents: every word that meets a piece at least twice and has a Dice value of at least ``least`` with it.  A table of more than ``most`` entries or words is refused."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = Numbers({"": 0}), Numbers({"": 0})
        waiting: list[np.ndarray] = []
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge() -> None:
            nonlocal keys, times
            new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            waiting.clear()
            both = np.concatenate([keys, new])
            order = np.argsort(both, kind="stable")
            first = _firsts(both[order])
            keys, times = both[order][first], np.add.reduceat(np.concatenate([times, n])[order], first) if len(first) else times

        def flush() -> pa.RecordBatch:
            nonlocal keys, times
            out = pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()).take(pa.array(keys >> 32)), pa.array(list(words), pa.string()).take(pa.array(keys & 0xFFFFFFFF)), pa.array(times)], ["f", "e", "n"])
            keys, times = keys[:0], times[:0]
            for names in (pieces, words):
                names.clear()
                names[""] = 0
            return out

        for batch in batches:
            for _, lot in lots(batch.column(0).to_pylist()):
                pairs = Pairs(*lot.n, lot.i, lot.j)
                together = pairs.total(lot.add)
                score = np.where(together < 3, 0.0, 2 * together / np.maximum(lot.weight[0][pairs.i] + lot.weight[1][pairs.j], 1))
                chosen = pairs.mutual(score, 0.6, 0.15)
                # Of every chosen pair each piece with each word; the empty one among either counts the pairs themselves.
                f, f_of = _with_empty(pieces.of(lot.tokens[0]), lot.held[0], pairs.i[chosen])
                e, e_of = _with_empty(words.of(lot.tokens[1]), lot.held[1], pairs.j[chosen])
                edges = np.searchsorted(e_of, np.arange(len(chosen) + 1))
                lo, hi = edges[f_of], edges[f_of + 1]
                held = np.cumsum(hi - lo)
                parts = np.searchsorted(held, np.arange(0, held[-1] if len(held) else 0, 500_000)).tolist()  # a long document is counted in parts
                for a, b in zip(parts, [*parts[1:], len(held)]):
                    post, spread = _ranges(lo[a:b], hi[a:b])
                    waiting.append(f[a:b][spread] << 32 | e[post])
                    if sum(map(len, waiting)) > 1_000_000:
                        merge()
                if len(keys) > 1_000_000 or max(len(pieces), len(words)) > 200_000:
                    merge()
                    yield flush()
        merge()
        yield flush()

    counts = read.select("read").mapInArrow(count, "f string, e string, n long").groupBy("f", "e").agg(F.sum("n").alias("n")).where("n >= 2")
    counts = counts.persist()
    ones = counts.where("e = '' OR f = ''")
    total = next((r["n"] for r in ones.where("e = '' AND f = ''").collect()), 0)
    ranked = counts.where("e <> '' AND f <> ''").join(ones.where("e = '' AND f <> ''").select("f", F.col("n").alias("nf")), "f").join(ones.where("f = '' AND e <> ''").select("e", F.col("n").alias("ne")), "e")
    # The Dice value keeps rare coincidences and words that go with everything down.
    ranked = ranked.withColumn("dice", 2 * F.col("n") / (F.col("nf") + F.col("ne"))).where(F.col("dice") >= least)
    rows = ranked.select("f", "e", "dice", "n", "nf").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries of the translation table")
    words = {r["e"]: r["n"] for r in ones.where("f = '' AND e <> ''").limit(most + 1).collect()}
    if len(words) > most:
        raise ValueError(f"more than {most} words")
    counts.unpersist()
    return Table([(r["f"], r["e"], float(r["n"] / r["nf"] * min(1.0, r["dice"] * 1.5) ** 0.5)) for r in rows], {w: float(np.log((total + 1) / n)) for w, n in words.items()})


def align_lot(lot: Lot, table: Table, slot: np.ndarray, least: float = 0.42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left sentences, right sentences and scores of the matches in the documents of a lot.

    The bag of a left sentence holds its anchors and the English words that its pieces go with; the inverted lists of the right sentences' words
    and anchors give the pairs that share something, and only those are scored.  ``slot``: scratch of -1 for every word of the table."""
    (n_left, n_right), (wl, wr) = lot.n, lot.weight
    known = np.fromiter(map(table.word.get, lot.tokens[1], repeat(-1)), np.int64, len(lot.tokens[1]))
    at = np.repeat(np.arange(n_right), lot.held[1])
    full = np.bincount(at, np.where(known >= 0, table.value[known] if len(table.value) else 0.2, 0.2), n_right)
    # The words of each document that the table knows, in the order of their coming.
    at, known = at[known >= 0], known[known >= 0]
    unique, came, of = np.unique(lot.doc[1][at] * max(1, len(table.word)) + known, return_index=True, return_inverse=True)
    order = np.argsort(came)
    name = np.empty(len(unique), np.int64)
    name[order] = np.arange(len(unique))
    mine, names = name[of], known[came[order]]
    value = table.value[names]
    edges, lists = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=len(names)))]), at[_order(mine, len(names))]
    # The bag of a left sentence: of every word of this document that its pieces go with, the greatest probability.
    who = np.repeat(np.arange(n_left), lot.held[0])
    row = np.fromiter(map(table.piece.get, lot.tokens[0], repeat(-1)), np.int64, len(who))
    who, row = who[row >= 0], row[row >= 0]
    entry, spread = _ranges(table.start[row], table.start[row + 1])
    goes, here = table.goes[entry], np.full(len(entry), -1, np.int64)
    ends = np.searchsorted(who[spread], lot.start[0]).tolist(), np.searchsorted(lot.doc[1][at[came[order]]], np.arange(len(lot.start[1]))).tolist()
    for a, b, x, y in zip(ends[0], ends[0][1:], ends[1], ends[1][1:]):
        slot[names[x:y]] = np.arange(x, y)
        here[a:b] = slot[goes[a:b]]
        slot[names[x:y]] = -1
    there = here >= 0
    own, word, chance = who[spread[there]], here[there], table.likely[entry[there]]
    order = _order(word, len(names))
    order = order[_order(own[order], n_left)]
    own, word = own[order], word[order]
    first = _firsts(own * max(1, len(names)) + word)
    own, word = own[first], word[first]
    gained = (np.maximum.reduceat(chance[order], first) if len(first) else np.zeros(0)) * value[word]
    base = np.bincount(own, gained, n_left)
    post, spread = _ranges(edges[word], edges[word + 1])
    pairs = Pairs(n_left, n_right, np.concatenate([lot.i, own[spread]]), np.concatenate([lot.j, lists[post]]))
    together, learned = pairs.total(np.concatenate([lot.add, np.zeros(len(post))])), pairs.total(np.concatenate([np.zeros(len(lot.add)), gained[spread]]))
    gain = together + learned
    # Likely words of the left sentence that stand elsewhere in the document count against a partner without them.
    down = wl[pairs.i] + wr[pairs.j] + full[pairs.j] + np.maximum(base[pairs.i], learned)
    score = 2 * gain / np.maximum(down, 1e-9)
    likely, same = score >= least, pairs.total(np.concatenate([lot.kind, np.zeros(len(post), np.uint8)]), np.bitwise_or)
    apart = lot.kinds[0][pairs.i] & lot.kinds[1][pairs.j] & ~same
    for kind, penalty in (("#", 0.35), ("T", 0.2)):  # both count something, or name some thing, and not the same
        score[likely & (apart & _KINDS[kind] > 0)] -= penalty
    chosen = pairs.mutual(score, least)
    # What is left goes on among itself, more carefully.
    taken_i, taken_j = np.zeros(n_left, bool), np.zeros(n_right, bool)
    taken_i[pairs.i[chosen]] = taken_j[pairs.j[chosen]] = True
    free = ~(taken_i[pairs.i] | taken_j[pairs.j])
    chosen = np.concatenate([chosen, pairs.mutual(np.where(free, score, -1.0), least + 0.08)])
    found, scores = [pairs.i[chosen], pairs.j[chosen]], score[chosen]

    def of_pairs(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        key = i * n_right + j
        k = np.minimum(np.searchsorted(pairs.key, key), len(pairs.key) - 1)
        return np.where(pairs.key[k] == key, values[k], 0.0)

    # Merges: a sentence left over beside a matched one.
    heavy = [wl + base, wr + full]
    for side in (0, 1) if len(chosen) else ():
        order = _order(found[side], lot.n[side])
        edges = np.searchsorted(found[side][order], np.arange(lot.n[side] + 1))
        left_over = (edges[1:] == edges[:-1]).nonzero()[0]
        x, p = [], []
        for step in (-1, 1):
            y = left_over + step
            beside = (y >= 0) & (y < lot.n[side])
            beside[beside] = lot.doc[side][y[beside]] == lot.doc[side][left_over[beside]]
            y = y[beside]
            entry, spread = _ranges(edges[y], edges[y + 1])
            x.append(left_over[beside][spread])
            p.append(order[entry])
        x, p = np.concatenate(x), np.concatenate(p)
        match = [found[0][p], found[1][p]]
        new = [x, match[1]] if side == 0 else [match[0], x]
        own, other = heavy[side][x], heavy[1 - side][match[1 - side]]
        mine, theirs = of_pairs(gain, *new), of_pairs(gain, *match)
        joint = 2 * (mine + theirs) / np.maximum(1e-9, other + heavy[side][match[side]] + own)
        good = ((mine >= 0.6 * own) & (joint > of_pairs(score, *match) + 0.08) & (mine + theirs <= 1.25 * other)).nonzero()[0]
        good = good[len(good) - 1 - np.unique((new[0] * n_right + new[1])[good][::-1], return_index=True)[1]]  # of a pair found from both sides the last
        found, scores = [np.concatenate([found[k], new[k][good]]) for k in (0, 1)], np.concatenate([scores, joint[good]])
    return *found, scores


def align(docs: DataFrame, key: str, ja: str, en: str, glossary: DataFrame, most: int = 100_000) -> DataFrame:
    """(key, ja_line, en_line, score): lines of which some sentence translates one of the other; ``glossary`` has the columns (en, ja)."""
    terms = [(r[0], r[1]) for r in glossary.distinct().limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} glossary terms")
    terms.sort(key=lambda t: (t[0] or "", t[1] or ""))
    both = docs.where((F.length(F.trim(ja)) > 0) & (F.length(F.trim(en)) > 0)).select(key, ja, en)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(terms)
    kind = docs.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            blobs = [pack(left, right) for left, right in reader.read(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], [key, "read"])

    # The documents are read once; what the two passes need of them is kept, not the texts.
    features = cut(both.mapInArrow(read, f"`{key}` {kind}, read binary"))
    model = context.broadcast(learn(features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        slot = np.full(max(1, len(table.word)), -1, np.int64)
        for batch in batches:
            for lo, lot in lots(batch.column(1).to_pylist()):
                i, j, score = align_lot(lot, table, slot)
                doc, jl, el = lot.doc[0][i], lot.line[0][i], lot.line[1][j]
                order = np.lexsort((-score, el, jl, doc))  # of the sentences of two lines the best
                doc, jl, el = doc[order], jl[order], el[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (jl[1:] != jl[:-1]) | (el[1:] != el[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc[new])), pa.array(jl[new]), pa.array(el[new]), pa.array([round(s, 4) for s in score[order][new].tolist()], pa.float64())], [key, "ja_line", "en_line", "score"])

    return features.mapInArrow(run, f"`{key}` {kind}, ja_line int, en_line int, score double")
