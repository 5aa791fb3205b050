"""Language of documents and of the stretches of mixed-language documents.

Hyperdimensional profiles: every letter has a random vector of ``DIM`` signs; an
n-gram vector binds (multiplies) the letter vectors permuted (rolled) by their
place (by whole bytes of signs); the n-gram vectors of a language, weighted by how much the n-gram speaks
for it (the log of its share against the mean share), are bundled (added) into its
prototype, and a sentence is compared with the prototypes by cosine.  As the dot
product with a bundle is the sum of the dot products with its parts, the products
of all n-grams of the training text with the prototypes, divided by the prototypes'
lengths, are computed once on the driver and sent to the tasks as one table of
fixed size (``FEATURES`` x 8 floats).  The length of a sentence's vector is the
root of the sum of squared n-gram counts (times the root of ``DIM``), for n-gram
vectors are orthogonal up to 1 / sqrt(DIM).

Training text: ``SEED`` below and, of at most ``sample`` labelled rows (smallest
hash of the key, default 4,000), those sentences on which the seed profile agrees
with the label, so that wrong labels teach nothing.

Defined results: null, blank and letterless texts have no segment; a sentence
without evidence takes the language of the sentence before it (else after it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentences import segment_batch

LANGS = ("en", "ja", "zh", "es", "pt", "fr", "de", "ko")
#: Other spellings of the labels, without region or script subtag, in lower case.
ALIASES = {
    "en": "en eng english", "ja": "ja jp jpn japanese 日本語", "zh": "zh zho chi chinese cmn cn 中文", "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português", "fr": "fr fra fre french français", "de": "de deu ger german deutsch", "ko": "ko kor korean kr 한국어",
}
UNLABELLED = ("", "und", "unknown", "none", "null", "mul", "n/a")
DIM = 32768
#: Least lead of the best cosine, and of the best product, over the next.
MARGIN, LEAST = 0.02, 0.1

SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to recognition everywhere as a person before the law. "
    "Could you please tell me where the nearest station is? I have been working in this office since last summer. We are going to eat bread, cheese and apples for lunch. My sister lives in a big house with two cats. Don't forget to close the windows when you leave. It is raining again, so let us stay at home. What time does your train arrive? He doesn't want to talk about his work. Shut your mouth or I will hit you. You are a good friend, but this is too much for me. The water was cold and the road was long. These books belong to our teacher. That doctor always helps poor people. Thank you very much, see you tomorrow.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. "
    "¿Podría decirme dónde está la estación más cercana, por favor? Trabajo en esta oficina desde el verano pasado. Vamos a comer pan, queso y manzanas a mediodía. Mi hermana vive en una casa grande con dos gatos. No olvides cerrar las ventanas cuando salgas. Está lloviendo otra vez, así que quedémonos en casa. ¿A qué hora llega tu tren? Él no quiere hablar de su trabajo. Cierra la boca o te pego. Eres un buen amigo, pero esto es demasiado para mí. El agua estaba fría y el camino era largo. Estos libros son de nuestro maestro. Ese médico siempre ayuda a los pobres. Ojalá se mejore pronto. Me duelen los dientes y la cabeza. Tiró la basura y rompió un pedazo de vidrio. Muchas gracias, hasta mañana.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão. Ninguém será submetido a tortura nem a penas ou tratamentos cruéis, desumanos ou degradantes. Todos os indivíduos têm direito ao reconhecimento, em todos os lugares, da sua personalidade jurídica. "
    "Você poderia me dizer onde fica a estação mais próxima, por favor? Trabalho neste escritório desde o verão passado. Vamos comer pão, queijo e maçãs ao meio-dia. A minha irmã mora numa casa grande com dois gatos. Não se esqueça de fechar as janelas quando sair. Está chovendo outra vez, então vamos ficar em casa. A que horas chega o seu trem? Ele não quer falar do seu trabalho. Cale a boca ou eu bato em você. És um bom amigo, mas isto é demais para mim. A água estava fria e o caminho era longo. Estes livros são do nosso professor. Esse médico sempre ajuda os pobres. Tomara que melhore logo. Doem-me os dentes e a cabeça. Jogou o lixo fora e quebrou um pedaço de vidro. Muito obrigado, até amanhã.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude. Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. "
    "Pourriez-vous me dire où se trouve la gare la plus proche, s'il vous plaît ? Je travaille dans ce bureau depuis l'été dernier. Nous allons manger du pain, du fromage et des pommes à midi. Ma sœur habite une grande maison avec deux chats. N'oublie pas de fermer les fenêtres quand tu sors. Il pleut encore, alors restons chez nous. À quelle heure arrive ton train ? Il ne veut pas parler de son travail. Ferme ta bouche ou je te frappe. Tu es un bon ami, mais c'est trop pour moi. L'eau était froide et la route était longue. Ces livres sont à notre professeur. Ce médecin aide toujours les pauvres. J'ai mal aux dents et à la tête. Merci beaucoup, à demain.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden. Niemand darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden. "
    "Könnten Sie mir bitte sagen, wo der nächste Bahnhof ist? Ich arbeite seit dem letzten Sommer in diesem Büro. Wir essen zu Mittag Brot, Käse und Äpfel. Meine Schwester wohnt mit zwei Katzen in einem großen Haus. Vergiss nicht, die Fenster zu schließen, wenn du gehst. Es regnet schon wieder, also bleiben wir zu Hause. Um wie viel Uhr kommt dein Zug an? Er will nicht über seine Arbeit sprechen. Halt den Mund oder ich schlage dich. Du bist ein guter Freund, aber das ist zu viel für mich. Das Wasser war kalt und der Weg war lang. Diese Bücher gehören unserem Lehrer. Dieser Arzt hilft immer den armen Leuten. Mir tun die Zähne und der Kopf weh. Vielen Dank, bis morgen.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。何人も、奴隷にされ、又は苦役に服することはない。何人も、拷問又は残虐な、非人道的な若しくは屈辱的な取扱若しくは刑罰を受けることはない。"
    "一番近い駅はどこか教えていただけますか。去年の夏からこの事務所で働いています。お昼にパンとチーズとりんごを食べましょう。姉は二匹の猫と大きな家に住んでいる。出かける時は窓を閉めるのを忘れないで。また雨が降っているから家にいよう。黙れ、さもないと殴るぞ。この本は先生のものです。水は冷たく、道は長かった。どうもありがとうございました、また明日。第一話。第百二十三話。序章。終章。登場人物紹介。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役。任何人不得加以酷刑，或施以残忍的、不人道的或侮辱性的待遇或刑罚。人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。"
    "请问最近的车站在哪里？我从去年夏天开始在这个办公室工作。中午我们吃面包、奶酪和苹果吧。我姐姐和两只猫住在一所大房子里。出门的时候别忘了关窗户。又下雨了，我们就待在家里吧。闭嘴，不然我打你。这些书是我们老师的。水很冷，路很长。请告诉我你们什么时候到。非常感谢，明天见。請問最近的車站在哪裡？這些書是我們老師的。我從去年夏天開始在這個辦公室工作。第一章。第一百二十三章。序章。終章。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다. 어느 누구도 노예상태 또는 예속상태에 놓여지지 아니한다. "
    "가장 가까운 역이 어디인지 알려 주시겠어요? 저는 작년 여름부터 이 사무실에서 일하고 있습니다. 점심에 빵과 치즈와 사과를 먹읍시다. 언니는 고양이 두 마리와 큰 집에서 산다. 나갈 때 창문 닫는 것을 잊지 마라. 또 비가 오니까 집에 있자. 이 책은 우리 선생님의 것이다. 물은 차갑고 길은 길었다. 입 다물어라. 정말 고맙습니다, 내일 만나요.",
}

_LETTERS = "abcdefghijklmnopqrstuvwxyzáàâãäåçèéêëìíîïñòóôõöùúûüÿßœæ"
_CLASS = np.zeros(0x110000, np.uint8)
for _k, _c in enumerate(_LETTERS):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper()[0])] = _k + 1
_CLASS[ord("S")] = _LETTERS.index("s") + 1
_UPPER = np.zeros(0x110000, bool)
for _c in _LETTERS:
    _UPPER[ord(_c.upper()[0])] = True
_UPPER[0xFF21:0xFF3B] = True
for _c in range(0xFF21, 0xFF3B):
    _CLASS[_c] = _CLASS[_c + 32] = _c - 0xFF21 + 1
_WIDE = np.zeros(0x110000, bool)
for _a, _b in ((0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0xFF66, 0xFF9D)):
    _WIDE[_a : _b + 1] = True
_LATIN, _UNI = 64**3, 65536
FEATURES = _LATIN + 2 * _UNI
#: Weight of a letter of a script without spaces against a Latin three-letter piece.
_WIDE_WEIGHT = 2.0


def _features(code: np.ndarray, names: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, feature numbers) of the n-grams of a text: three letters of a spaced script, one and two of an unspaced one.

    Words that begin with a capital are mostly names or headings and say little of the language: they count only with ``names``."""
    cls = _CLASS[code].astype(np.int32)
    if not names:
        letter = cls > 0
        first = letter & ~np.concatenate([[False], letter[:-1]])
        heads = np.flatnonzero(first)
        if len(heads):
            capital = _UPPER[code[heads]]
            cls[letter & capital[np.maximum(np.cumsum(first) - 1, 0)]] = 0
    pad = np.concatenate([[0], cls, [0]])
    tri = (pad[:-2] << 12) | (pad[1:-1] << 6) | pad[2:]
    at = np.flatnonzero(cls)
    wide = np.flatnonzero(_WIDE[code])
    uni = code[wide].astype(np.int64) & 0xFFFF
    pairs = np.flatnonzero(np.diff(wide) == 1) if len(wide) else wide
    two = (uni[pairs] * 31 + uni[pairs + 1]) & 0xFFFF if len(pairs) else uni[:0]
    return [(at, tri[at].astype(np.int64)), (wide, uni + _LATIN), (wide[pairs] if len(pairs) else wide[:0], two + _LATIN + _UNI)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Profile:
    """Prototypes of the languages, kept as the table of n-gram products."""

    def __init__(self, texts: dict[str, list[str]], least: int = 1, seed: int = 7):
        counts = np.zeros((len(LANGS), FEATURES), np.float32)
        pairs: dict[int, tuple[int, int]] = {}
        for k, lang in enumerate(LANGS):
            code = _codes("\n".join(texts.get(lang, [])) + "\n")
            if len(code) < 2:
                continue
            for family, (at, number) in enumerate(_features(code)):
                counts[k] += np.bincount(number, minlength=FEATURES)
                if family == 2:
                    for n, p in zip(*np.unique(number, return_index=True)):
                        pairs.setdefault(int(n), (int(code[at[p]]), int(code[at[p] + 1])))
        seen = np.flatnonzero(counts.sum(0) >= least)
        share = counts[:, seen] / np.maximum(counts.sum(1, keepdims=True), 1) + 2e-5
        weight = np.clip(np.log(share / share.mean(0)), -2.5, 2.5)
        weight[:, seen >= _LATIN] *= _WIDE_WEIGHT
        latin = [self._signs(seed, 1 << 20 | k) for k in range(64)]
        wide: dict[int, np.ndarray] = {}

        def letter(n: int) -> np.ndarray:
            if n not in wide:
                wide[n] = self._signs(seed, n)
            return wide[n]

        def vectors(numbers: np.ndarray) -> np.ndarray:
            """Packed signs; of signs kept as bits, the product is the exclusive or."""
            out = np.empty((len(numbers), DIM // 8), np.uint8)
            for i, n in enumerate(numbers.tolist()):
                if n < _LATIN:
                    out[i] = np.roll(latin[n >> 12], 2) ^ np.roll(latin[(n >> 6) & 63], 1) ^ latin[n & 63]
                elif n < _LATIN + _UNI:
                    out[i] = letter(n - _LATIN)
                else:
                    a, b = (letter(x & 0xFFFF) for x in pairs[n])
                    out[i] = np.roll(a, 1) ^ b
            return out

        self.table = np.zeros((FEATURES, len(LANGS)), np.float32)
        for lo, hi in ((0, _LATIN), (_LATIN, FEATURES)):  # spaced and unspaced scripts have subspaces, so prototypes, of their own
            own = np.flatnonzero((seen >= lo) & (seen < hi))
            prototype = np.zeros((len(LANGS), DIM), np.float32)
            made = []
            for s in (own[i : i + 512] for i in range(0, len(own), 512)):
                made.append((s, vectors(seen[s])))
                prototype += weight[:, s] @ (np.unpackbits(made[-1][1], axis=1).astype(np.float32) * 2 - 1)
            prototype /= np.maximum(np.linalg.norm(prototype, axis=1, keepdims=True), 1e-9) * np.sqrt(DIM)
            if lo:
                prototype *= _WIDE_WEIGHT
            for s, bits in made:
                self.table[seen[s]] = (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) @ prototype.T

    @staticmethod
    def _signs(seed: int, n: int) -> np.ndarray:
        return np.frombuffer(np.random.default_rng([seed, n]).bytes(DIM // 8), np.uint8)

    def cosines(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of the sentences [start, end) of one code array: their products with the prototypes of length one, and the lengths of their vectors.
        A cosine is a product divided by the length (0: no n-gram)."""
        total = np.zeros((len(starts), len(LANGS)), np.float64)
        square = np.zeros(len(starts))
        for at, number in _features(code, names):
            if not len(at):
                continue
            lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
            live = np.flatnonzero(hi - lo)
            run = np.zeros((len(at) + 1, len(LANGS)))
            np.cumsum(self.table[number], axis=0, dtype=np.float64, out=run[1:])
            total[live] += run[hi[live]] - run[lo[live]]
            which = np.repeat(np.arange(len(starts)), hi - lo)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            keys = np.sort(which * FEATURES + number[inside])
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            count = np.diff(np.append(first, len(keys)))
            square += np.bincount(keys[first] // FEATURES, weights=count * count, minlength=len(starts))
        return total, np.sqrt(square)


def sure_of(total: np.ndarray, size: np.ndarray, margin: float, least: float) -> np.ndarray:
    """Whether the best cosine leads the next one by ``margin``, and by more the shorter the sentence: the lead of the products themselves, so the
    evidence summed over the n-grams, must reach ``least`` too."""
    order = np.sort(total, axis=1)
    lead = order[:, -1] - order[:, -2]
    return (size > 0) & (lead >= margin * size) & (lead >= least)


def runs_of(spans: list[tuple[int, int]], total: np.ndarray, size: np.ndarray, margin: float, least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the maximal runs of sentences in one language; a sentence without enough evidence takes the language
    of the one before it (at the start: after it)."""
    sure = sure_of(total, size, margin, least)
    lang = [int(b) if ok else -1 for b, ok in zip(total.argmax(1), sure)]
    last = -1
    for i, x in enumerate(lang):
        if x < 0:
            lang[i] = last
        last = lang[i]
    first = next((x for x in lang if x >= 0), -1)
    if first < 0:
        first = int(total.sum(0).argmax()) if total.any() else -1
        if first < 0:
            return []
    lang = [first if x < 0 else x for x in lang]
    out, i = [], 0
    while i < len(lang):
        j = i
        while j + 1 < len(lang) and lang[j + 1] == lang[i]:
            j += 1
        own = total[i : j + 1].sum(0)
        rest = max(float(own[k]) for k in range(len(LANGS)) if k != lang[i])
        out.append((spans[i][0], spans[j][1], LANGS[lang[i]], round(float(1 / (1 + np.exp(-(float(own[lang[i]]) - rest) / least))), 4)))
        i = j + 1
    return out


def label_column(label: Column) -> Column:
    """The language that a label names: one of ``LANGS``, the label itself if it names another, null if it names none."""
    base = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), "(?U)^\\s+|\\s+$|[-_].*$", "")))
    known = F.lit(None).cast("string")
    for lang, names in ALIASES.items():
        known = F.when(base.isin(*names.split()), F.lit(lang)).otherwise(known)
    return F.when(base.isin(*UNLABELLED), F.lit(None).cast("string")).otherwise(F.coalesce(known, base))


def fit_rows(rows: list[tuple[str, str]], margin: float = MARGIN, least: float = LEAST) -> Profile:
    """The profile of ``SEED`` and of those sentences of the (label, text) rows on which the seed's profile agrees with the label."""
    texts = {k: [v] for k, v in SEED.items()}
    profile = Profile(texts)
    for k, clean, spans, _ in segment_batch([r[1] for r in rows], [r[0] in ("ja", "zh") for r in rows]):
        if not spans:
            continue
        a, label = np.asarray(spans), rows[k][0]
        total, size = profile.cosines(_codes(clean), a[:, 0], a[:, 1])
        sure = sure_of(total, size, margin, least)
        texts[label] += [clean[s:e] for (s, e), k, ok in zip(spans, total.argmax(1), sure) if ok and LANGS[k] == label]
    return Profile(texts, least=3) if rows else profile


def fit(labelled: DataFrame | None = None, sample: int = 4000) -> Profile:
    """The profile of ``SEED`` and of at most ``sample`` rows of ``labelled`` (key, text, lang; lang already normalised)."""
    if labelled is None:
        return fit_rows([])
    key, text, lang = labelled.columns
    fit_for = labelled.where(F.col(lang).isin(*LANGS) & F.col(text).isNotNull())
    keys = fit_for.select(key).orderBy(F.xxhash64(key), key).limit(sample)  # keys alone: a partition sends the driver ids, not texts
    rows = fit_for.join(F.broadcast(keys.distinct()), key, "left_semi").dropDuplicates([key]).orderBy(key).select(lang, text).collect()
    return fit_rows([(r[0], r[1]) for r in rows])


_CHUNK = 400_000


def _batches(texts: list, lines: list[bool], profile: Profile, margin: float = MARGIN, least: float = LEAST) -> Iterator[tuple[int, list]]:
    """For each text its number and its runs, in positions of the stored text."""
    held, chars = [], 0

    def flush():
        code = _codes("\n\n".join(t for _, t, _, _ in held))
        starts, ends, base = [], [], 0
        for _, t, spans, _ in held:
            a = np.asarray(spans, np.int64).reshape(-1, 2) + base
            starts.append(a[:, 0])
            ends.append(a[:, 1])
            base += len(t) + 2
        total, size = profile.cosines(code, np.concatenate(starts), np.concatenate(ends))
        at = 0
        for k, t, spans, where in held:
            own_total, own_size = total[at : at + len(spans)], size[at : at + len(spans)]
            at += len(spans)
            if not sure_of(own_total, own_size, margin, least).any():  # all capitals, say: then every letter counts
                a = np.asarray(spans, np.int64)
                own_total, own_size = profile.cosines(_codes(t), a[:, 0], a[:, 1], names=True)
            own = runs_of(spans, own_total, own_size, margin, least)
            yield k, [(a + 1, b, lang, conf) if where is None else (int(where[a]) + 1, int(where[b - 1]) + 1, lang, conf) for a, b, lang, conf in own]

    for k, text, spans, where in segment_batch(texts, lines):
        if spans:
            held.append((k, text, spans, where))
            chars += len(text)
        if chars > _CHUNK:
            yield from flush()
            held, chars = [], 0
    if held:
        yield from flush()


def language_runs(df: DataFrame, profile: Profile, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """Adds to each row of ``df`` (any columns, one of them ``text``) the array ``runs`` of (seg, lang, confidence, start_pos, end_pos) and drops
    the text.  Rows without a letter get an empty array.  ``df`` must not have a column ``runs``."""
    spark: SparkSession = df.sparkSession
    table = spark.sparkContext.broadcast(profile.table)
    keep = [c for c in df.columns if c != "text"]
    kind = "array<struct<seg:int,lang:string,confidence:double,start_pos:int,end_pos:int>>"
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", runs {kind}"
    arrow = pa.list_(pa.struct([("seg", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = object.__new__(Profile)
        own.table = table.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found: list = [[] for _ in texts]
            for k, runs in _batches(texts, [False] * len(texts), own, margin, least):
                found[k] = [{"seg": i + 1, "lang": lang, "confidence": conf, "start_pos": a, "end_pos": b} for i, (a, b, lang, conf) in enumerate(runs)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(found, arrow)], [*keep, "runs"])

    return df.select(*keep, "text").mapInArrow(run, schema)


def label_cases(df: DataFrame, profile: Profile, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """Runs of the records of ``df`` (record_kind, rec_id, label, text) whose label is missing or wrong or whose text is mixed."""
    out = language_runs(df.select("record_kind", "rec_id", label_column(F.col("label")).alias("label"), "text"), profile, margin, least)
    wrong = (F.size("runs") > 1) | ((F.size("runs") == 1) & ~F.col("runs")[0]["lang"].eqNullSafe(F.col("label")))
    return out.where(wrong).select("record_kind", "rec_id", F.explode("runs").alias("r")).select("record_kind", "rec_id", "r.*")
