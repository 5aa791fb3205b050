"""Sentence boundaries across languages and scripts.

Every candidate character of a text (closing marks, quotation signs, brackets,
line breaks) becomes one observation of a linear-chain model; Viterbi decoding
tags it as *boundary* or *inside* while keeping track of the quotation depth, so
that an ambiguous sign such as the straight double quote is opened or closed by
what makes the whole chain most likely.  The probability of a boundary given an
observation is counted on ``SEED``, a list of whole sentences, and on their
concatenations.  For text without punctuation, :class:`StrippedModel` is the same
chain over every character, trained on sentences whose punctuation was stripped;
it cuts what is too long to be one sentence and holds no closing mark.

Defined results: null, empty and all-blank texts have no sentence; a line without
any letter or digit is none; an unclosed quotation is closed by a blank line (in
Japanese and Chinese by any line break); very long texts are decoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVISIBLE = re.compile("[­​-‏⁠﻿︀-️\U000e0100-\U000e01ef]")
_ANY_INVISIBLE = np.zeros(0x110000, dtype=bool)
for _a, _b in ((0xAD, 0xAD), (0x200B, 0x200F), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)):
    _ANY_INVISIBLE[_a : _b + 1] = True

_MARK = "[.!?。！？…‥｡．]"
_OPEN = "“„«「『｢（(\\[【《〈‘"
_CLOSE = "”»」』｣）)\\]】》〉"
_UP = "A-ZÀ-ÖØ-ÞА-Я"
_LOW = "a-zß-öø-ÿа-я"
_CJK = "　-ヿ㐀-鿿豈-﫿＀-￯…―"
#: Verbs of speech that follow a quotation and its speaker.
_SAY = (
    "said|says|say|asked|asks|cried|cries|shouted|shouts|wondered|wonders|roared|whispered|replied|answered|murmured|muttered|yelled|screamed|"
    "called|added|exclaimed|growled|hissed|sighed|snapped|begged|demanded|insisted|announced|declared|thought|laughed|sobbed|groaned|mumbled|"
    "warned|repeated|continued|went on|explained|agreed|snarled|barked|dijo|preguntó|gritó|disse|perguntou|gritou|dit|demanda|cria|sagte|fragte|rief"
)
_SAY_ZH = "说|說|问|問|喊|叫|道|嚷|吼|答|想|嘀咕|低语|回应|追问|疑惑|自语"
_ATTR_LATIN = rf"(?=\s*,?\s*[—–-]?\s*[{_LOW}]|\s*,|\s+(?:[{_UP}][\w.’'-]*\s+){{1,5}}(?:{_SAY})\b|\s+(?:{_SAY})\b)"
_ATTR_JA = r"(?=\s*(?:と|って)(?!ころ|き[、は]))"
_ATTR_KO = r"(?=\s*(?:하고|라고|이라고|하며)\s)"
_ATTR_ZH = rf"(?=[^。！？；…\n“”「」『』!?;]{{0,40}}(?:(?<!知)道|{_SAY_ZH.replace('道|', '')})(?:道|着|了)?\s*(?:[。．，,！!：:｡\n]|\Z))"
_ATTR = f"(?:{_ATTR_LATIN}|{_ATTR_JA}|{_ATTR_KO}|{_ATTR_ZH})"
_GO_ON = "そして|それから|でも|だが|しかし|けれど|それでも|すると|然后|然後|于是|於是|但|可是|却|卻|而|又|接着|接著|才|就"

def _after(words: str) -> str:
    """Matches right behind one of the words."""
    return "(?:" + "|".join(rf"(?<=\b{w})" for w in words.split()) + ")"


#: Titles and Latin short forms that a word always follows; short forms that a number follows; those that may end a sentence.
_TITLES = _after(r"Mr Mrs Ms Mme Dr St Ste Capt Lt Sgt Col Gen Prof Rev Hon Sr Sra Srta Hr Fr Mt vs cf e\.g i\.e viz [UP]")
_NUMBERED = _after(r"[Vv]ol [Vv]ols [Cc]h p pp [Nn]o [Nn]os [Nn]r [Nn]úm Lv LV lv [Ff]ig [Ss]ec [Aa]rt")
_SHORT = _after(r"[ap]\.m [ap]\.\sm [AP]\.M etc kg km cm mm ft lb lbs oz Co Inc Ltd Jr approx dept est")
_INNER = _after(r"[ap] [AP]")

#: Observation name and its pattern, first match wins.  ``x`` patterns are consumed without an observation.
_PATTERNS = [
    ("break", r"\n(?:[^\w\n]*\n)+|\A(?:[^\w\n]*\n)+"),
    ("line", r"LINE\n"),
    ("x1", rf"{_TITLES}\.(?=\s*\S)|{_INNER}\.(?=\s?[mM]\.)|{_NUMBERED}\.(?=\s*\d)"),
    ("short_up", rf"{_SHORT}\.(?=\s+[“\"‘«(\[—¿¡]*\s?[UP]|\s*[CJKWORD「『])"),
    ("x3", rf"{_SHORT}\.(?![.!?\"”’])"),
    ("close_mark_said", r"MARK+\s?[CLOSE’]ATTR|(?<=MARK[CLOSE’])[CLOSE’]ATTR"),
    ("close_mark", r"MARK+\s?[CLOSE]|MARK+\s?[CLOSE’](?!\w)|(?<=MARK[CLOSE’])[CLOSE’]"),
    ("strong_dash", r"[.…‥．]*[!?。！？｡]MARK*(?=\s*[—–―-]\s*[LOW])"),
    ("strong", r"[.…‥．]*[!?。！？｡]MARK*"),
    ("dots_on", r"(?:\.{2,}|[…‥]+)[.…‥]*(?=\s*(?:[LOW、，,;；:：]|GOON))"),
    ("dots", r"(?:\.{2,}|[…‥]+)[.…‥]*"),
    ("dot_on", r"\.(?=\s+[LOW])"),
    ("x4", r"[.．](?=[\d０-９LOW,;])"),
    ("dot", r"[.．]"),
    ("open", r"[OPEN]"),
    ("close_line", r"[CLOSE](?=[^\S\n]*\n\s*[UP“\"«「『(（CJKWORD]|\s*\Z)"),
    ("close_said", r"[CLOSE]ATTR"),
    ("close", r"[CLOSE]|(?<!\w)’|’(?!\w)"),
    ("straight_mark_said", r"(?<=MARK)\"ATTR"),
    ("straight_mark", r"(?<=MARK)\""),
    ("straight_open", r"(?:(?<=[\s(（—])|\A)\"(?=\S)"),
    ("straight_line", r"\"(?=[^\S\n]*\n\s*[UP“\"«(]|\s*\Z)"),
    ("straight", r"\""),
]
#: A line break that ends a sentence although it stands alone: after Japanese or Chinese, after a heading at the start.
_LINE = r"(?:(?<=[CJK])|(?<=[CJK]\s))"
_HEADING = re.compile(rf"\A\s*(?:(?:Chapter|CHAPTER|Interlude|Prologue|Epilogue|Volume|Part|Book)\b[^\n]{{0,80}}|\d+\s*[-–—:.]?[^\n.!?]{{0,60}})(?=\n[^\S\n]*[{_UP}“\"«(—])")
_FIRST = f"(?=[\n.!?。！？…‥｡．\"’{_OPEN}{_CLOSE}]|\\A)"


def _pattern(every_line: bool) -> re.Pattern:
    parts = []
    for name, p in _PATTERNS:
        p = p.replace("LINE", "" if every_line else _LINE)
        for key, value in (("CJKWORD", "぀-ヿ一-鿿"), ("MARK", _MARK), ("ATTR", _ATTR), ("GOON", _GO_ON), ("CLOSE", _CLOSE), ("OPEN", _OPEN), ("[CJK]", f"[{_CJK}]"), ("[UP]", f"[{_UP}]"), ("LOW", _LOW)):
            p = p.replace(key, value)
        p = re.sub(r"UP(?=[“\]])|(?<=\])UP", _UP, p)
        parts.append(f"(?P<{name}>{p})")
    return re.compile(_FIRST + "(?:" + "|".join(parts) + ")")


_RE = {every: _pattern(every) for every in (False, True)}
OBSERVATIONS = [n for n, _ in _PATTERNS if n[0] != "x"]
_CODE = {n: k for k, n in enumerate(OBSERVATIONS)}
#: Outside a quotation, outside and at a boundary, inside one, two, three or more quotations.
OUT, END, Q1, Q2, Q3 = range(5)
_NONE = -1e4

#: Whole sentences, the training text of the chain (each line is one sentence).
SEED = """\
It was the best of times for the farmers of the valley.
Mr. Brown sold 3.75 tons of wheat to Dr. Green in March.
See vol. 2, p. 118, of the report by Prof. Hill.
A. B. White, who taught music, never came back.
The shop opens at 8 a.m.
She bought flour, sugar, butter, etc.
By 7 p.m. on Sunday, Capt. Reed had left.
The parcel was 2.5 kg, i.e. too heavy for the boy.
Where did you put my keys?
What a wonderful evening!
He paused... and sat down again.
If only I had known earlier...
"Are you coming?" asked the nurse.
"Sit down. The soup is hot. Don't spill it."
“Sit down. The soup is hot. Don't spill it.”
“Watch the road!” the driver yelled.
"Well... I am not sure," she said.
"City vs. United, second half," said the screen.
Table 4.1.2 lists "iron, copper" as metals.
“Did the teacher say ‘not today’ to you?” he wondered.
"Fire!!! Everyone out!!! Now!!!"
No. 12 was my uncle (the one with the red hat).
(Nobody ever found the letter.)
[This chapter was printed twice.]
—¿Cuándo sale el tren? —preguntó la señora.
« Avez-vous faim ? » demanda le garçon.
春になると川の水が増える。
「もう食べましたか？」と母が聞いた。
「座って。熱いよ。こぼさないで。」
『本当！？　信じられない！』と彼女が叫んだ。
「火事だ！！！　早く！！！　外へ！！！」
彼は少し考え……それから笑った。
空を見上げるだけだった……。
十二番は私の叔父（赤い帽子の人）だった。
（その手紙は誰も読まなかった。）
「第一部、春の歌」と表紙に書いてあった。
春天来了，河水涨了。
“你吃饭了吗？”妈妈问。
“坐下。汤很烫。别洒了。”
「真的！？我不信！」她喊道。
他想了想……然后笑了。
我们只好抬头看天……
“老师真的说过‘今天不行。’吗？”他疑惑地问。
谁把我的钥匙拿走了呢？
十二号是我叔叔（戴红帽子的那位）。
（那封信谁也没有读过。）
封面上写着“春之歌，第一部”。
「언제 떠나지?」 하고 아이가 물었다.
봄이 오면 강물이 불어난다."""


def _moves() -> np.ndarray:
    """Log weights of structure, [before, observation, after]: which depth follows which."""
    w = np.full((5, len(OBSERVATIONS), 5), _NONE)
    for name, o in _CODE.items():
        for s in range(5):
            depth = max(0, s - 1) if s != END else 0
            if name in ("break", "line"):
                w[s, o, END] = 0.0 if depth == 0 else -2.0
            elif name == "open" or name == "straight_open":
                w[s, o, min(depth + 1, 3) + 1] = 0.0
                if name == "straight_open" and depth:  # rarely a closing sign after a space
                    w[s, o, depth if depth > 1 else OUT] = w[s, o, END] = -3.0
                    w[s, o, min(depth + 1, 3) + 1] = -1.0 if depth == 1 else 0.0
            elif name.startswith(("close", "straight")):
                if depth == 0:
                    w[s, o, OUT] = w[s, o, END] = 0.0
                    if name.startswith("straight"):
                        w[s, o, Q1] = 0.0 if name.startswith("straight_mark") else -1.0
                        w[s, o, OUT] = w[s, o, END] = -4.0
                elif depth == 1:
                    w[s, o, OUT] = w[s, o, END] = 0.0
                else:
                    w[s, o, depth] = 0.0
            elif depth == 0:
                w[s, o, OUT] = w[s, o, END] = 0.0
            else:
                w[s, o, s] = 0.0
    return w


def _train(seed: str) -> np.ndarray:
    """[before, observation, after] log weights: structure plus counted boundary odds of each observation."""
    counts = np.full((len(OBSERVATIONS), 2), 0.05)
    moves = _moves()
    lines = seed.split("\n")
    joined = [(a + (" " if a[-1].isascii() or b[0].isascii() else "") + b, len(a)) for a in lines for b in lines if a[-1].isascii() == b[0].isascii()]
    for text, cut in joined:
        obs = [(_CODE[m.lastgroup], m.end()) for m in _RE[False].finditer(text) if m.lastgroup[0] != "x"]
        depth = 0
        for o, end in obs:
            name = OBSERVATIONS[o]
            if name in ("open", "straight_open"):
                depth += 1
                continue
            if name.startswith(("close", "straight")):
                depth = max(0, depth - 1)
            if depth == 0:
                counts[o, int(end == cut or end == len(text))] += 1
    odds = np.log(counts / counts.sum(1, keepdims=True))
    w = moves.copy()
    for o, name in enumerate(OBSERVATIONS):
        if name in ("break", "line"):
            continue
        w[:, o, OUT] += odds[o, 0]
        w[:, o, END] += odds[o, 1]
    return w


WEIGHTS = _train(SEED)


def viterbi(sequences: list[np.ndarray], weights: np.ndarray = WEIGHTS) -> list[np.ndarray]:
    """The most likely state after each observation, for many chains at once; chains of like length are decoded together."""
    out: list = [None] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    by_obs = np.ascontiguousarray(weights.transpose(1, 0, 2)).astype(np.float32)
    for lo in range(0, len(order), 1024):
        part = order[lo : lo + 1024]
        longest = max(len(sequences[i]) for i in part)
        if longest == 0:
            for i in part:
                out[i] = np.zeros(0, np.int8)
            continue
        n = len(part)
        obs = np.full((longest, n), -1, np.int64)
        for c, i in enumerate(part):
            obs[: len(sequences[i]), c] = sequences[i]
        score = np.full((n, 5), _NONE, np.float32)
        score[:, END] = 0
        back = np.empty((longest, n, 5), np.int8)
        stay = np.arange(5, dtype=np.int8)
        for t in range(longest):
            o = obs[t]
            live = o >= 0
            total = score[:, :, None] + by_obs[np.where(live, o, 0)]
            best = total.argmax(1).astype(np.int8)
            new = np.take_along_axis(total, best[:, None, :].astype(np.int64), 1)[:, 0]
            back[t] = np.where(live[:, None], best, stay)
            score = np.where(live[:, None], new, score)
        state = score.argmax(1)
        path = np.empty((longest, n), np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = back[t, rows, state]
        for c, i in enumerate(part):
            out[i] = path[: len(sequences[i]), c]
    return out


_WORD = re.compile(r"[^\W_]")
_ANY_MARK = re.compile(_MARK)


def segment_batch(texts: Iterable[str | None], every_line: Iterable[bool]) -> Iterator[tuple[int, str, list[tuple[int, int]], object]]:
    """For each text that isn't blank: its number, the text without invisible characters, the spans [a, b) of its sentences there, and
    the array that maps positions to the text as stored (None: the same).  ``every_line``: each line break ends a sentence."""
    kept, sequences = [], []
    for k, (text, every) in enumerate(zip(texts, every_line)):
        if not text:
            continue
        where = None
        if not text.isascii() and INVISIBLE.search(text):
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            where = np.flatnonzero(~_ANY_INVISIBLE[code])
            text = INVISIBLE.sub("", text)
        if "„" in text:
            text = re.sub("„([^„“”]*)“", "„\\1”", text)
        obs, ends, goes_on = [], [], {}
        if not every and (m := _HEADING.match(text)):
            obs.append(_CODE["line"])
            ends.append(m.end())
        for m in _RE[every].finditer(text):
            code = _CODE.get(m.lastgroup)
            if code is not None:
                obs.append(code)
                if code == 0 and m.start():  # lines without a letter belong to no sentence
                    goes_on[len(ends)] = m.end()
                    ends.append(m.start())
                else:
                    ends.append(m.end())
        kept.append((k, text, ends, goes_on, where))
        sequences.append(np.asarray(obs, np.int64))
    for (k, text, ends, goes_on, where), path in zip(kept, viterbi(sequences)):
        spans, a = [], 0
        for t in np.flatnonzero(path == END).tolist():
            b = ends[t]
            piece = text[a:b]
            if _WORD.search(piece):
                left = piece.lstrip()
                a += len(piece) - len(left)
                spans.append((a, a + len(left.rstrip())))
            a = goes_on.get(t, b)
        piece = text[a:]
        if _WORD.search(piece):
            left = piece.lstrip()
            a += len(piece) - len(left)
            spans.append((a, a + len(left.rstrip())))
        yield k, text, spans, where


def sentence_spans(df: DataFrame, key: str, fields: dict[str, bool], stripped: dict[str, "StrippedModel"] | None = None) -> DataFrame:
    """One row per sentence of each text field of ``df``: ``key``, ``field_name``, ``start_pos``, ``end_pos`` (1-based code points).

    ``fields`` maps a column to whether every line break ends a sentence there.  ``stripped`` gives fields a model for text without punctuation: a
    sentence without a mark that is longer than nearly all (``StrippedModel.longest``) is cut by it.  Repeated rows of a key count once.  Texts
    never leave the tasks that read them; only the spans are shuffled, packed into one array per text.
    """
    columns = list(fields)
    sent = df.sparkSession.sparkContext.broadcast(stripped or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            ids = batch.column(0)
            for c, name in enumerate(columns):
                rows, flat, sizes = [], [], []
                model = models.get(name)
                for k, text, spans, where in segment_batch(batch.column(c + 1).to_pylist(), (fields[name] for _ in range(batch.num_rows))):
                    if not spans:
                        continue
                    if model is not None and len(text) > model.longest and any(b - a > model.longest for a, b in spans):
                        spans = [x for a, b in spans for x in model.recut(text, a, b)]
                    pos = np.asarray(spans, np.int64)
                    start, last = pos[:, 0], pos[:, 1] - 1
                    if where is not None:
                        start, last = where[start], where[last]
                    flat.append(np.stack([start + 1, last + 1], 1).ravel())
                    rows.append(k)
                    sizes.append(2 * len(spans))
                values = pa.array(np.concatenate(flat) if flat else [], pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]) if flat else [0], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array([name] * len(rows), pa.string()), pa.ListArray.from_arrays(offsets, values)], [key, "field_name", "spans"])

    kind = df.schema[key].dataType.simpleString()
    packed = df.select(key, *columns).mapInArrow(run, f"{key} {kind}, field_name string, spans array<int>").distinct()
    return packed.select(key, "field_name", F.explode(F.expr("transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] AS start_pos, spans[i + 1] AS end_pos))")).alias("s")).select(key, "field_name", "s.start_pos", "s.end_pos")


def fit_stripped(df: DataFrame, key: str, fields: list[str], sample: int = 500, sentences: int = 4000) -> dict[str, "StrippedModel"]:
    """A model for text without punctuation of each field, of at most ``sentences`` punctuated sentences of at most ``sample`` rows (smallest hash
    of the key); fields without any get none."""
    out = {}
    for c in fields:
        keys = df.where(F.length(c) > 0).select(key).orderBy(F.xxhash64(key), key).limit(sample).distinct()
        texts = [r[0] for r in df.join(F.broadcast(keys), key, "left_semi").dropDuplicates([key]).orderBy(key).select(c).collect()]
        lines = [text[a:b] for _, text, spans, _ in segment_batch(texts, [True] * len(texts)) for a, b in spans]
        lines = [x for x in lines if re.search(_MARK + f"[{_CLOSE}]?$", x)][:sentences]
        if lines:
            out[c] = StrippedModel(lines)
    return out


class StrippedModel:
    """The boundary chain over every character, for text without punctuation.

    Trained on whole sentences whose punctuation was stripped: the log odds that a sentence ends between two characters are counted on the
    characters on either side (one and two of each), and the chain's transition keeps boundaries apart by the usual sentence length.
    """

    def __init__(self, sentences: Iterable[str]):
        lines = [self.strip(s) for s in sentences]
        lines = [s for s in lines if s]
        self.ends: dict[str, float] = {}
        inside: dict[str, int] = {}
        at: dict[str, int] = {}
        for a, b in zip(lines, [*lines[1:], lines[0]] if lines else []):
            text = a + b
            for i in range(1, len(text)):
                for f in self._features(text, i):
                    if i == len(a):
                        at[f] = at.get(f, 0) + 1
                    elif i < len(a):
                        inside[f] = inside.get(f, 0) + 1
        n_at, n_in = max(1, len(lines)), max(1, sum(max(0, len(s) - 1) for s in lines))
        for f in {*at, *inside}:
            self.ends[f] = float(np.log((at.get(f, 0) + 0.1) / (n_at + 1)) - np.log((inside.get(f, 0) + 0.1) / (n_in + 1)))
        self.prior = float(np.log(n_at / n_in))
        self.least = max(2, int(np.quantile([len(s) for s in lines], 0.02))) if lines else 2
        #: Length that a sentence rarely has.
        self.longest = int(1.5 * np.quantile([len(s) for s in lines], 0.995)) if lines else 1 << 30

    def recut(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The span [a, b) of a text, cut into sentences if it is too long for one and holds no closing mark."""
        if b - a <= self.longest or _ANY_MARK.search(text, a, b):
            return [(a, b)]
        return [(a + x, a + y) for x, y in self.cut(text[a:b])] or [(a, b)]

    @staticmethod
    def strip(text: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", "", text)).strip()

    @staticmethod
    def _features(t: str, i: int) -> tuple[str, ...]:
        return ("a" + t[i - 1], "b" + t[i : i + 1], "c" + t[max(0, i - 2) : i], "d" + t[i : i + 2], "e" + t[i - 1 : i + 1])

    def cut(self, text: str) -> list[tuple[int, int]]:
        """Spans of the sentences of a text; Viterbi over boundary and inside with a least length between boundaries."""
        n = len(text)
        if not text.strip():
            return []
        score = np.array([self.prior + sum(self.ends.get(f, 0.0) for f in self._features(text, i)) / 2 for i in range(1, n)])
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        top, top_at = -np.inf, 0
        for i in range(1, n + 1):
            if i - self.least >= 0 and best[i - self.least] > top:
                top, top_at = best[i - self.least], i - self.least
            gain = score[i - 1] if i < n else 0.0
            best[i], back[i] = (top + gain, top_at) if top > -np.inf else (-np.inf if i < n else 0.0, 0)
        spans, i = [], n
        while i > 0:
            a, b = back[i], i
            piece = text[a:b]
            if _WORD.search(piece):
                lead = len(piece) - len(piece.lstrip())
                spans.append((a + lead, a + len(piece.rstrip())))
            i = back[i]
        return spans[::-1]
