"""Abusive, hateful and sexual content: a calibrated score per kind for every document, and rates per source.

Gradient-boosted trees judge sentences by dense features: densities of seed
lexicons and of weighted terms learned from the ratings, nearness of a second
person, capitals, exclamation and obfuscation rates.  Ratings are given to whole
documents, so the worst sentence of a document stands for it: terms and trees are
fitted in rounds, each taking as bad sentences those that the round before judged
worst.  Isotonic regression on documents held out from the trees turns the worst
sentence's margin into a probability.

The model is fitted on at most ``sample`` rated documents (smallest hash of the
id, default 8,000); every document is scored.  Defined results: null, blank and
letterless texts score 0 for every kind; contradicting ratings of a document
count as their share; texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import former
from .sentences import segment_batch

KINDS = ("abuse", "hate", "sexual")
SIZE = 1 << 20
#: Seed words of each kind, general ones in several languages; in scripts without spaces they are found as substrings.
LEXICON = {
    "abuse": (
        "idiot moron imbecile fool stupid dumb jerk scum trash garbage filth bastard asshole arsehole bitch whore slut cunt loser freak pig worm parasite coward worthless pathetic useless disgusting "
        "fucking shit shitty damn goddamn bloody die idiota imbécil estúpido tonto basura cerdo cobarde inútil cállate muérete mierda cabrón burro lixo porco covarde merda "
        "imbécile crétin connard ordure salaud lâche Dummkopf Arschloch Abschaum Schwein Drecksack Feigling Scheiße "
        "馬鹿 バカ 阿呆 クズ ゴミ 死ね 黙れ 消えろ くたばれ 豚 畜生 役立たず 蠢 笨蛋 白痴 垃圾 废物 混蛋 王八蛋 去死 滚 闭嘴 猪 바보 멍청 쓰레기 병신 죽어 꺼져 닥쳐"
    ),
    "hate": (
        "vermin subhuman savages breed race inferior animals exterminate eradicate deport plague parasites disease infest alimañas plaga exterminar raza praga raça vermine exterminer "
        "Ungeziefer Rasse ausrotten Untermenschen 害虫 劣等 民族 根絶 駆除 种族 灭绝 消灭 瘟疫 해충 열등 민족 박멸"
    ),
    "sexual": (
        "naked nude sex sexual fuck fucked penis cock dick vagina pussy breasts nipples thighs orgasm moan moaning erection aroused lust horny undressed desnudo desnuda sexo orgasmo pechos seios "
        "nue sexe orgasme seins nackt Orgasmus Brüste 裸 性器 喘 淫 乳房 絶頂 勃起 性交 呻吟 高潮 下体 阴茎 알몸 성기 신음 섹스 절정"
    ),
}
_SECOND = re.compile(r"(?:you|your|yours|yourself|tú|tu|te|ti|usted|vos|você|vous|toi|du|dich|dir|ihr)(?:'|$)")
_SECOND_WIDE = re.compile("你|您|お前|おまえ|貴様|てめえ|君|あなた|너|당신")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힣]|[^\W_぀-ヿ㐀-鿿가-힣](?:[^\W_぀-ヿ㐀-鿿가-힣]|[*@$#'’](?=[^\W_぀-ヿ㐀-鿿가-힣]))*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_぀-ヿ㐀-鿿가-힣](?:[ .\-_*•]+|(?=[ .\-_*•]))){2,}[^\W\d_぀-ヿ㐀-鿿가-힣](?![^\W_])")
_SPACED_WIDE = re.compile(r"(?:[぀-ヿ㐀-鿿가-힣][ .*・\-_•]){2,}[぀-ヿ㐀-鿿가-힣]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans("013457@$", "oieastas")
_MASK = re.compile(r"[*@$#0-9]")


def _open(word: str) -> str:
    """A word with its vowels, and what may stand for them, left open."""
    return _VOWELS.sub(".", word)


_VOWELS = re.compile(r"[aeiou*@$#0-9]")
_CAPITAL = re.compile("[A-Z]")


class Words:
    """Tokens of sentences, with masked and stretched words put right."""

    def __init__(self, known: set[str]):
        self.known = known
        self.by_frame: dict[str, list[str]] = {}
        for w in sorted(known):
            self.by_frame.setdefault(_open(w), []).append(w)

    def plain(self, word: str) -> tuple[str, int]:
        """The word that is meant, and whether it was written otherwise: letters repeated, or vowels replaced by signs."""
        if _LONG.search(word):
            once, twice = _LONG.sub(r"\1", word), _LONG.sub(r"\1\1", word)
            return self.plain(twice if twice in self.known and once not in self.known else once)[0], 1
        if not _MASK.search(word) or word.isdigit():
            return word.replace("’", "'"), 0
        if re.fullmatch(r"\d+[^\W\d]{0,3}", word):
            return "0", 0
        straight = word.translate(_LEET)
        if straight in self.known and not re.search(r"[*#]", straight):
            return straight, 1
        for t in self.by_frame.get(_open(word), ()):  # the same but for what is masked
            if all(a == b or _MASK.match(a) for a, b in zip(word, t)):
                return t, 1
        return straight, 1

    @staticmethod
    def joined(text: str) -> tuple[str, int]:
        """The text with words spelled out by signs or spaces put together, and how many there were."""
        if " " not in text and "." not in text:
            return text, 0
        text, n = _SPACED.subn(lambda m: re.sub(r"[ .\-_*•]", "", m.group()), text)
        text, w = _SPACED_WIDE.subn(lambda m: re.sub(r"[ .*・\-_•]", "", m.group()), text)
        return text, n + w

    def of(self, sentence: str) -> tuple[list[str], int]:
        """(plain tokens, obfuscated ones) of one sentence."""
        text, odd = self.joined(sentence)
        got = [self.plain(t) for t in _TOKEN.findall(text.lower())]
        return [t for t, _ in got], odd + sum(o for _, o in got)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array of whole numbers of 0 and more, in order."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=-1))]


#: Flags of a token: a seed word of kind k (1 << k), a second person, of a script without spaces, obfuscated.
_YOU, _WIDE_TOKEN, _ODD = 8, 16, 32


class Sentences:
    """Feature extraction: terms and dense features of many sentences at once."""

    def __init__(self, known: set[str]):
        self.words = Words(known)
        self.spaced = [{w.lower() for w in v.split() if ord(w[0]) < 0x3000} for v in LEXICON.values()]
        wide = {w: sum(1 << k for k, v in enumerate(LEXICON.values()) if w in v.split()) for v in LEXICON.values() for w in v.split() if ord(w[0]) >= 0x3000}
        self.wide, self.wide_re = wide, re.compile("|".join(sorted(map(re.escape, wide), key=len, reverse=True)))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.plain: list[str] = []
        self.hashes: list[int] = []
        self.flags: list[int] = []

    def _new(self, token: str) -> int:
        word, odd = self.words.plain(token)
        h = 1469598103934665603
        for b in word.encode():
            h = ((h ^ b) * 1099511628211) & 0x7FFFFFFFFFFFFFFF
        flag = sum(1 << k for k, own in enumerate(self.spaced) if word in own)
        flag |= (_YOU if _SECOND.match(word) else 0) | (_WIDE_TOKEN if word[:1] >= "\u3000" else 0) | (_ODD if odd else 0)
        self.number[token] = n = len(self.plain)
        self.plain.append(word)
        self.hashes.append(h & 0x7FFFFFFF)
        self.flags.append(flag)
        return n

    def read(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of all sentences one after another, terms per sentence, dense features): a term is a number of one, two or three tokens."""
        if len(self.plain) > 300_000:
            self.forget()
        get, new = self.number.get, self._new
        flat: list[int] = []
        sizes, extra = np.zeros(len(sentences), np.int64), np.zeros((len(sentences), 4))
        texts = []
        for i, sentence in enumerate(sentences):
            text, odd = self.words.joined(sentence)
            toks = _TOKEN.findall(text.lower())
            own = [get(t) for t in toks]
            if None in own:
                own = [n if (n := get(t)) is not None else new(t) for t in toks]
            flat += own
            sizes[i] = len(own)
            texts.append(text)
            extra[i] = odd, len(_CAPITAL.findall(text)) / max(1, len(sentence)), sentence.count("!") + sentence.count("！"), sentence[:1] in "\"“「『‘«"
        token = np.asarray(flat, np.int64)
        who = np.repeat(np.arange(len(sentences)), sizes)
        flag = np.asarray(self.flags, np.int64)[token] if len(token) else token
        h = np.asarray(self.hashes, np.int64)[token] if len(token) else token
        near2, near3 = who[1:] == who[:-1], who[2:] == who[:-2]
        two = (h[:-1] * 1000003 + h[1:]) & 0x7FFFFFFF
        three = (two[:-1] * 1000003 + h[2:]) & 0x7FFFFFFF
        keys = [who * SIZE + h % SIZE, who[1:][near2] * SIZE + ((two * 7 + 1) % SIZE)[near2], who[2:][near3] * SIZE + ((three * 13 + 5) % SIZE)[near3]]
        keys = distinct(np.concatenate(keys))
        n = np.maximum(sizes, 1)
        count = lambda bit: np.bincount(who, (flag & bit) > 0, len(sentences))
        hits = np.stack([count(1 << k) for k in range(len(KINDS))], 1) if len(sentences) else np.zeros((0, len(KINDS)))
        spaced = hits.copy()
        you = count(_YOU) > 0
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(count(_WIDE_TOKEN)).tolist():
            found = self.wide_re.findall("".join([self.plain[t] for t in flat[ends[i] - sizes[i] : ends[i]]]))
            for w in found:
                for k in range(len(KINDS)):
                    hits[i, k] += self.wide[w] >> k & 1
            you[i] |= bool(_SECOND_WIDE.search(sentences[i]))
        near = np.where(you[:, None] & (hits > 0), 0.5, 0.0)
        for i, k in np.argwhere(you[:, None] & (spaced > 0)).tolist():
            own = flag[ends[i] - sizes[i] : ends[i]]
            a, b = np.flatnonzero(own & (1 << k)), np.flatnonzero(own & _YOU)
            if len(b):
                near[i, k] = 1 / (1 + np.abs(a[:, None] - b[None, :]).min())
        dense = [np.log1p(n), (count(_ODD) + extra[:, 0]) / n, extra[:, 1], extra[:, 2], you.astype(float), extra[:, 3]]
        for k in range(len(KINDS)):
            dense += [hits[:, k], hits[:, k] / n, near[:, k]]
        return (keys % SIZE).astype(np.int32), np.bincount(keys // SIZE, minlength=len(sentences)), np.stack(dense, 1)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 24, l2: float = 1.0) -> list:
    """Boosted regression trees on the logistic loss, by histograms; each tree is (feature, cut) per inner node and values per leaf."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    extra = [np.unique(x[y > 0.5][:, f]) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, e[:: max(1, len(e) // bins)]])) for c, e in zip(cuts, extra)]
    if (y > 0.5).any() and (y < 0.5).any():  # places between the classes, so that a cut can stand in the middle of a gap
        low, high = np.quantile(x[y < 0.5], [0.99, 0.999, 1.0], axis=0), np.quantile(x[y > 0.5], [0.0, 0.02, 0.1], axis=0)
        cuts = [np.unique(np.concatenate([c, *[np.linspace(a, b, 8)[1:-1] for a in low[:, f] for b in high[:, f] if a < b]])) for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    score = np.full(len(x), np.log((w * y).sum() / max(1e-9, (w * (1 - y)).sum()) + 1e-9))
    trees = [float(score[0]) if len(x) else 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p) + 1e-9
        node = np.zeros(len(x), np.int64)
        splits = []
        for level in range(depth):
            nodes = 1 << level
            best = np.full(nodes, 1e-6)
            pick = np.full((nodes, 2), -1)
            for f in range(x.shape[1]):
                at = node * width + binned[:, f]
                gs = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(1)
                hs = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[:, -1] = 0
                v = gain.max(1)
                even = gain >= v[:, None] - 1e-9 * np.abs(v[:, None])
                first, last = even.argmax(1), width - 1 - even[:, ::-1].argmax(1)
                b = np.where(even.sum(1) == last - first + 1, (first + last) // 2, first)  # the middle of an empty gap
                better = v > best
                best[better] = v[better]
                pick[better] = np.stack([np.full(nodes, f), b], 1)[better]
            go = np.zeros(len(x), np.int64)
            row = []
            for k in range(nodes):
                f, b = pick[k]
                row.append((int(f), float(cuts[f][b]) if f >= 0 and b < len(cuts[f]) else np.inf))
                if f >= 0:
                    own = node == k
                    go[own] = binned[own, f] > b
            splits.append(row)
            node = node * 2 + go
        leaves = 1 << depth
        value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        trees.append((splits, value))
        score = score + value[node]
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), trees[0])
    for splits, value in trees[1:]:
        node = np.zeros(len(x), np.int64)
        for row in splits:
            f = np.array([r[0] for r in row])[node]
            cut = np.array([r[1] for r in row])[node]
            node = node * 2 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut))
        score += value[node]
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the least-squares increasing fit, by pooling adjacent violators: the ends of every pool without its outer
    twentieths (single outliers must not carry a pool's value far), between which the probability is to be interpolated."""
    order = np.argsort(score, kind="stable")
    ordered = score[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-np.inf))  # equal scores are one observation of their mean
    counts = np.diff(np.append(first, len(ordered)))
    pools: list[list[float]] = []
    for v, n in zip((np.add.reduceat(y[order], first) / counts).tolist() if len(first) else [], counts.tolist()):
        pools.append([v, n])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2 = pools.pop()
            v1, n1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    ends, at = [], 0
    for v, n in pools:
        lo, hi = float(ordered[at + n // 20]), float(ordered[at + n - 1 - n // 20])
        ends += [(lo, v), (hi, v)] if hi > lo else [(hi, v)]
        at += n
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


class Model:
    """Term weights, trees and calibration of the three kinds."""

    def __init__(self, docs: list[tuple[str, tuple[float, float, float]]], rounds: int = 3, seed: int = 5, calm_sentences: int = 20_000):
        docs = [(t, y) for t, y in docs if t]
        lexicon = {w.lower() for v in LEXICON.values() for w in v.split()}
        vocabulary: dict[str, int] = {}
        for t, _ in docs:
            for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
                vocabulary[w] = vocabulary.get(w, 0) + 1
        self.known = lexicon | {w for w, n in vocabulary.items() if n >= 3}
        reader, form = Sentences(self.known), former(True)
        parts, owner = [], []
        for lo in range(0, len(docs), 1000):
            own = []
            for k, text, spans, _ in segment_batch([form(t) for t, _ in docs[lo : lo + 1000]], [False] * len(docs[lo : lo + 1000])):
                own += [text[a:b] for a, b in spans]
                owner += [lo + k] * len(spans)
            parts.append(reader.read(own))
        self.weights = np.zeros((len(KINDS) + 1, SIZE), np.float32)
        self.trees: list = [None] * len(KINDS)
        self.steps = [(np.array([0.0, 1.0]), np.array([0.0, 0.9]))] * len(KINDS)
        labels = np.array([y for _, y in docs], np.float64).reshape(-1, len(KINDS))
        if (labels.max(1, initial=0) >= 0.5).sum() < 5 or (labels.sum(1) == 0).sum() < 5:
            return
        flat, sizes, dense = (np.concatenate([p[i] for p in parts]) for i in range(3))
        data = flat, sizes, dense, np.asarray(owner, np.int64)
        del parts
        # Each half of the documents is judged by a model of the other half, which saw none of it: neither terms nor trees.
        half = np.random.default_rng(seed).permutation(len(docs)) % 2
        margins = np.full((len(docs), len(KINDS)), np.nan)
        for h in (0, 1):
            weights, trees = self._fit(*_of_documents(data, labels, half != h), rounds, seed, calm_sentences)
            who = np.flatnonzero(half == h)
            own, _ = _of_documents(data, labels, half == h)
            for k in range(len(KINDS)):
                if trees[k] is not None:
                    top = np.full(len(who), -20.0)
                    np.maximum.at(top, own[3], predict(trees[k], _features(weights, k, own[0], own[1], own[2])))
                    margins[who, k] = top
        self.weights, self.trees = self._fit(data, labels, rounds, seed, calm_sentences)
        for k in range(len(KINDS)):
            judged = ~np.isnan(margins[:, k])
            if self.trees[k] is not None and judged.any():
                self.steps[k] = isotonic(margins[judged, k], labels[judged, k])

    @staticmethod
    def _fit(data: tuple, labels: np.ndarray, rounds: int, seed: int, calm_sentences: int) -> tuple[np.ndarray, list]:
        """(term weights by kind and, last, of bad sentences of any kind; trees by kind) of documents with their ratings."""
        flat, sizes, dense_a, owner_a = data
        rng = np.random.default_rng(seed)
        weights, trees = np.zeros((len(KINDS) + 1, SIZE), np.float32), [None] * len(KINDS)
        bad, good = labels.max(1, initial=0) >= 0.5, labels.sum(1) == 0
        if bad.sum() < 3 or good.sum() < 3:
            return weights, trees
        n_docs, n_all = len(labels), len(sizes)
        sent = np.repeat(np.arange(n_all, dtype=np.int32), sizes)
        root = np.sqrt(np.maximum(sizes, 1))
        hint = np.stack([np.minimum(dense_a[:, 6 + 3 * k], 3) + dense_a[:, 8 + 3 * k] for k in range(len(KINDS))], 1)

        def pick(total: np.ndarray) -> np.ndarray:
            """Of the bad documents the worst sentence if it is clearly worse than nearly all harmless ones, and others that are half as bad as usual."""
            top = np.full(n_docs, -np.inf)
            np.maximum.at(top, owner_a, total)
            low = float(np.quantile(total[calm], 0.995)) + 1.0
            usual = top[bad & (top > low)]
            high = max(low, 0.5 * float(np.median(usual))) if len(usual) else low
            return bad[owner_a] & (((total >= top[owner_a]) & (total > low)) | (total > high))

        def held_by(which: np.ndarray) -> np.ndarray:
            """For every term, the documents that hold it in one of these sentences; a name repeated in one text counts once."""
            pick = which[sent]
            return np.bincount(distinct(owner_a[sent[pick]] * SIZE + flat[pick]) % SIZE, minlength=SIZE)

        def weigh(count: np.ndarray, n: float, base: np.ndarray, m: float) -> np.ndarray:
            """Log odds of terms by cautious shares: upwards counts less their deviation against the shares of the rest; downwards counts with their
            deviation and three more (none seen excludes no share below three in all), so that the names of harmless texts tell nothing."""
            rest = (base + 0.3) / (m + 1)
            sure = np.maximum(count - 1.5 * np.sqrt(count), 0)
            up = np.log((sure + 3 * rest) / (n + 3) / rest)
            least = np.log((count + 1.5 * np.sqrt(count) + 3) / (n + 3) / ((np.maximum(base - np.sqrt(base), 0) + 0.3) / (m + 1)))
            return np.where(up > 0, np.minimum(up, 5), np.where(least < 0, np.maximum(least, -3), 0.0))

        # 1. Bad sentences of any kind: terms that bad documents hold and harmless ones do not, then those of the worst sentences.
        pair = distinct(owner_a[sent] * SIZE + flat)
        doc, term = pair // SIZE, pair % SIZE
        w = weigh(np.bincount(term[bad[doc]], minlength=SIZE), bad.sum(), np.bincount(term[good[doc]], minlength=SIZE), good.sum())
        calm = good[owner_a]
        base = held_by(calm)
        for _ in range(rounds):
            total = np.bincount(sent, w[flat], n_all) / root + 0.5 * hint.max(1)
            chosen = pick(total)
            w = weigh(held_by(chosen), len(distinct(owner_a[chosen])), base, good.sum())
        total = np.bincount(sent, w[flat], n_all) / root + 0.5 * hint.max(1)
        chosen = pick(total)
        weights[-1] = w
        # 2. Their kinds: the ratings of the documents as a prior that terms may overrule.
        at = np.flatnonzero(chosen)
        prior = 0.2 + labels[owner_a[at]]
        prior /= prior.sum(1, keepdims=True)
        kind = prior.argmax(1)
        # Naive Bayes over the chosen sentences, a document counting a term once; rounds until the kinds settle.
        inner = np.cumsum(chosen) - 1
        own_sent, own_flat = inner[sent[chosen[sent]]], flat[chosen[sent]]
        for _ in range(3 * rounds):
            share = np.stack([held_by(np.isin(np.arange(n_all), at[kind == k])) for k in range(len(KINDS))]).astype(np.float64)
            held = share.sum(0)
            many = np.maximum([len(distinct(owner_a[at[kind == k]])) for k in range(len(KINDS))], 1)[:, None]
            rate = (share + 2.0 * held / held.max(initial=1) + 0.1) / (many + 1.0)
            tell = np.log(rate / rate.mean(0))
            tell[:, held < 3] = 0
            fit_score = np.stack([np.bincount(own_sent, tell[k][own_flat], len(at)) for k in range(len(KINDS))], 1) / root[at][:, None]
            kind = (fit_score + np.log(prior) + hint[at]).argmax(1)
        # 3. The lexicon of each kind with its weights, and trees on the densities of these lexicons and the other dense features.
        for k in range(len(KINDS)):
            mine = np.zeros(n_all, bool)
            mine[at[kind == k]] = True
            if mine.sum() < 3:
                continue
            against = calm | (chosen & ~mine)
            weights[k] = weigh(held_by(mine), len(distinct(owner_a[mine])), held_by(against), len(distinct(owner_a[against])))
        for k in range(len(KINDS)):
            mine = np.zeros(n_all, bool)
            mine[at[kind == k]] = True
            if mine.sum() < 3:
                continue
            x = _features(weights, k, flat, sizes, dense_a)
            hard = x[:, 9] > np.quantile(x[calm, 9], 0.97)
            use = np.flatnonzero(mine | (chosen & ~mine) | (calm & (hard | (rng.random(n_all) < min(1.0, calm_sentences / max(1, calm.sum()))))))
            # Ratings may miss bad sentences: a calm one whose terms are as bad as those of the bad ones teaches neither way.
            doubt = ~mine[use] & calm[use] & (x[use, 9] > 0.35 * np.median(x[mine, 9])) & (x[use, 12] > 0)
            use = use[~doubt]
            trees[k] = boost(x[use], mine[use].astype(float), np.ones(len(use)))
        return weights, trees

    def score(self, texts: list, reader: Sentences, form) -> np.ndarray:
        """Calibrated probabilities, texts by kinds."""
        sentences, owner = [], []
        for k, text, spans, _ in segment_batch([form(t) if t else t for t in texts], [False] * len(texts)):
            sentences += [text[a:b] for a, b in spans]
            owner += [k] * len(spans)
        out = np.zeros((len(texts), len(KINDS)))
        if not sentences:
            return out
        flat, sizes, dense = reader.read(sentences)
        owner_a = np.asarray(owner)
        has = np.unique(owner_a)
        for k in range(len(KINDS)):
            if self.trees[k] is None:
                margin = np.minimum(1.0, 0.3 * (dense[:, 6 + 3 * k] + dense[:, 8 + 3 * k]))
            else:
                margin = predict(self.trees[k], _features(self.weights, k, flat, sizes, dense))
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner_a, margin)
            at, p = self.steps[k]
            out[has, k] = np.interp(top[has], at, p)
        return out


def _of_documents(data: tuple, labels: np.ndarray, keep: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The sentences of some documents, renumbered, and the ratings of these."""
    flat, sizes, dense, owner = data
    own = keep[owner]
    return (flat[np.repeat(own, sizes)], sizes[own], dense[own], (np.cumsum(keep) - 1)[owner[own]]), labels[keep]


def _features(weights: np.ndarray, k: int, flat: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Dense features of sentences for one kind: sizes, rates, the seed lexicon, and how dense the learned lexicons of this and the other kinds lie."""
    n = len(sizes)
    sent = np.repeat(np.arange(n), sizes)
    w = weights[k][flat]
    root, size = np.sqrt(np.maximum(sizes, 1)), np.maximum(sizes, 1)
    others = np.max([np.bincount(sent, weights[j][flat], n) for j in range(len(KINDS)) if j != k], axis=0)
    up, down = np.bincount(sent, np.maximum(w, 0), n), np.bincount(sent, np.minimum(w, 0), n)
    worst = np.bincount(sent, weights[-1][flat], n) / root
    own = dense[:, [6 + 3 * k, 7 + 3 * k, 8 + 3 * k]]
    return np.column_stack([dense[:, :6], own, (up + down) / root, worst, others / root, (up + down - others) / root, up / root, up / size, np.bincount(sent, w > 1, n) / size])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """The model of the ratings ``labels`` (doc_id, kind) of ``docs`` (doc_id, text)."""
    raters = labels.where(F.col("doc_id").isNotNull() & F.col("kind").isNotNull()).groupBy("doc_id").agg(*[F.avg((F.col("kind") == k).cast("double")).alias(k) for k in KINDS])
    picked = raters.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", *KINDS).collect()
    return Model([(r[0], (r[1], r[2], r[3])) for r in rows])


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and one probability column per kind; ``docs`` has a column text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{k} double" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        reader, form = Sentences(own.known), former(True)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                p = own.score(part.column(len(keep)).to_pylist(), reader, form)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(p[:, k]) for k in range(len(KINDS))], [*keep, *KINDS])

    return docs.select(*keep, "text").mapInArrow(run, schema)
