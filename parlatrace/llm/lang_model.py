"""A nearest-centroid language classifier over TF-IDF vectors of letter n-grams, and the stretches of a text by language."""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np

DIMENSIONS = 1 << 15
CENTROIDS = 4
SIZES = (2, 3, 4)
SEED = 7
MIN_SHARE = 0.08
#: Texts on other matters than the sample's are farther from their own language than the held-out ones, yet nearer than other languages.
LEAST_SHARE = 0.4
SCALES = (5.0, 10.0, 15.0, 20.0, 30.0, 40.0)

_CJK = r"぀-ヿ㐀-鿿豈-﫿가-힯ｦ-ﾟ"
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_]+)*")
_CJK_RUN = re.compile(rf"^[{_CJK}]")
#: What stands before speech on a line: list mark, time, label, in any order; or a line that is no speech at all.
_HEAD = re.compile(
    r"\s*(?:[-*•>#]+\s+|\d+[.)]\s+|[\[(]?\d{1,3}:\d{1,2}(?::\d{1,2})?(?:[.,]\d+)?[\])]?\s*:?\s*|<?/?v\s+[^>\n]{1,30}>|"
    r"(?://)?\*{0,2}\[?(?:speaker|spk|sprecher|hablante|locuteur|s)[ _.-]?\d{1,4}\]?\*{0,2}(?:\s*[:>-](?=\s|$)|:|(?=\s*[\[(]?\d{1,3}:\d)|(?=\*)|(?=\s*$))\s*)",
    re.I,
)
_NO_SPEECH = re.compile(r"^\s*(?:WEBVTT.*|[WEBVTwebvt]{3,6}|NOTE\b.*|#+ [\d\s./:_-]*|[\d\s:.,>-]*)$")
_END = re.compile(rf"[.!?…]+[\"'”’»)\]]*(?=\s|$)|(?<=[^\W\d_A-Z])[.!?]+(?=[¿¡]?[A-ZÀ-ÖØ-ÞА-Я][^\W\d_A-ZÀ-ÖØ-ÞА-Я])|[。！？]+[」』”]?")
_QUOTED = re.compile(r"\"[^\"\n]{1,60}\"|“[^”\n]{1,60}”|„[^“”\n]{1,60}[“”]|«[^»\n]{1,60}»|「[^」\n]{1,60}」")
_SOUND = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|a+h+|h+m+|m+h+m+|m{2,}|ä+h+m*|ö+h+m*|e+h+m*|e+u+h+|h+e+u+|ø+h*m*|å+h+|huh|hum|えーと|えっと|あのー?|うーん|э+м*|ну)$", re.I)


@dataclass(frozen=True)
class Sentence:
    start: int
    end: int


def sentences(text: str) -> list[Sentence]:
    """The sentences of a text, without the marks that stand before speech; a line break ends one too."""
    found = []
    at = 0
    for line in text.split("\n"):
        if not _NO_SPEECH.match(line):
            a = 0
            while (m := _HEAD.match(line, a)) and m.end() > a:
                a = m.end()
            end = len(line)
            while a < end:
                m = _END.search(line, a)
                b = m.end() if m else end
                lead = len(line[a:b]) - len(line[a:b].lstrip())
                if line[a:b].strip():
                    found.append(Sentence(at + a + lead, at + b))
                a = b
        at += len(line) + 1
    return found


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, hesitation sounds and (where anything else is left) quotations aside; runs without spaces in pairs."""
    bare = _QUOTED.sub(" ", text)
    tokens = _TOKEN.findall(bare if _TOKEN.search(bare) else text)
    out: list[str] = []
    for w in tokens:
        if _CJK_RUN.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        elif not _SOUND.match(w):
            out.append(w.lower())
    return out


def bare(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def grams(word: str) -> list[int]:
    """Feature numbers of a word: its n-grams with edges marked, and itself."""
    if _CJK_RUN.match(word):
        parts = [*word, word]
    else:
        edged = f" {word} "
        parts = [edged[i : i + n] for n in SIZES for i in range(len(edged) - n + 1)] + [f"={word}"]
    return [zlib.crc32(p.encode()) % DIMENSIONS for p in parts]


class Vocabulary:
    """Features of words, kept from batch to batch up to a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.features: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        got = self.features.get(word)
        if got is None:
            if len(self.features) >= self.most:
                self.features.clear()
            got = self.features[word] = np.array(grams(word), dtype=np.int64)
        return got


def counts(texts: list[list[str]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the n-grams of each word list, rows in order."""
    arrays = [vocabulary.of(w) for words in texts for w in words]
    if not arrays:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    sizes = np.fromiter((sum(len(vocabulary.features[w]) if w in vocabulary.features else len(vocabulary.of(w)) for w in words) for words in texts), dtype=np.int64, count=len(texts))
    rows = np.repeat(np.arange(len(texts)), sizes)
    keys, n = np.unique(rows * DIMENSIONS + np.concatenate(arrays), return_counts=True)
    return keys // DIMENSIONS, keys % DIMENSIONS, n.astype(np.float64)


@dataclass
class Model:
    """languages, the language of each centroid, idf, centroids (dimensions x centroids), and the similarity below which a text is no known language."""

    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    least: float
    scale: float

    def similarities(self, texts: list[list[str]], vocabulary: Vocabulary) -> np.ndarray:
        """Cosine of each word list to the nearest centroid of each language; rows without words are all zero. Lists that come again are scored once."""
        distinct: dict[tuple[str, ...], int] = {}
        place = [distinct.setdefault(tuple(t), len(distinct)) for t in texts]
        return self._scored([list(t) for t in distinct], vocabulary)[place] if texts else np.zeros((0, len(self.languages)))

    def _scored(self, texts: list[list[str]], vocabulary: Vocabulary) -> np.ndarray:
        rows, features, n = counts(texts, vocabulary)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(rows):
            return out
        x = (1 + np.log(n)) * self.idf[features]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        norm = np.sqrt(np.add.reduceat(x * x, starts))
        near = np.empty((len(starts), self.centroids.shape[1]), dtype=np.float32)
        ends = np.append(starts[1:], len(rows))
        block = 256
        for i in range(0, len(starts), block):
            a, b = starts[i], ends[min(i + block, len(starts)) - 1]
            near[i : i + block] = np.add.reduceat(self.centroids[features[a:b]] * x[a:b, None].astype(np.float32), starts[i : i + block] - a, axis=0)
        cos = near / np.maximum(norm, 1e-12)[:, None]
        for k in range(len(self.languages)):
            out[rows[starts], k] = cos[:, self.owner == k].max(axis=1)
        return out

    def confidence(self, similarity: np.ndarray) -> np.ndarray:
        """Share of the best language when similarities are weighed exponentially, 0 to 1."""
        e = np.exp(self.scale * (similarity - similarity.max(axis=-1, keepdims=True)))
        return 1 / e.sum(axis=-1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS, rounds: int = 8) -> Model:
    """A model of labelled texts (language, text). Accents and single letters get lost in transcripts, so each text is also learned without them.

    Per language the vectors are clustered (spherical k-means, fixed start), each cluster's mean is a centroid. The rejection
    threshold is LEAST_SHARE of the 1 % quantile of the similarity of a held-out tenth to its own language.
    """
    rng = np.random.default_rng(SEED)
    vocabulary = Vocabulary()
    texts, labels, held = [], [], []
    for i, (lang, text) in enumerate(sorted(set(samples))):
        words = words_of(text)
        if not words:
            continue
        worn = [w if len(w) < 4 or rng.random() > 0.3 else w[: (k := int(rng.integers(0, len(w))))] + w[k + 1 :] for w in words]
        for version in (words, [bare(w) for w in words], worn):
            texts.append(version)
            labels.append(lang)
            held.append(i % 10 == 9)
    languages = sorted(set(labels))
    rows, features, n = counts(texts, vocabulary)
    document_frequency = np.bincount(features, minlength=DIMENSIONS)
    idf = np.log((1 + len(texts)) / (1 + document_frequency)) + 1
    x = (1 + np.log(n)) * idf[features]
    norm = np.sqrt(np.bincount(rows, x * x, minlength=len(texts)))
    x /= norm[rows]
    label, is_held = np.array([languages.index(v) for v in labels]), np.array(held)
    owner, centers = [], []
    for k in range(len(languages)):
        mine = np.flatnonzero((label == k) & ~is_held)
        if not len(mine):
            mine = np.flatnonzero(label == k)
        place = np.full(len(texts), -1)
        place[mine] = np.arange(len(mine))
        pick = place[rows] >= 0
        used, column = np.unique(features[pick], return_inverse=True)  # the features this language has at all
        dense = np.zeros((len(mine), len(used)), dtype=np.float32)
        dense[place[rows[pick]], column] = x[pick]
        c = dense[np.linspace(0, len(mine) - 1, min(centroids, len(mine))).astype(int)]
        for _ in range(rounds):
            near = (dense @ _unit_rows(c).T).argmax(axis=1)
            c = np.stack([dense[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        # a small cluster may be made of texts under a wrong label: it gets no centroid
        share = np.bincount((dense @ _unit_rows(c).T).argmax(axis=1), minlength=len(c)) / len(mine)
        c = c[share >= min(MIN_SHARE, share.max())]
        near = (dense @ _unit_rows(c).T).argmax(axis=1)
        c = np.stack([dense[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        wide = np.zeros((len(c), DIMENSIONS), dtype=np.float32)
        wide[:, used] = _unit_rows(c)
        centers.append(wide)
        owner += [k] * len(c)
    model = Model(languages, np.array(owner), idf, np.ascontiguousarray(np.concatenate(centers).T), 0.0, 40.0)
    tests = [t for t, h in zip(texts, held, strict=True) if h]
    if tests:
        s = model.similarities(tests, vocabulary)
        own = s[np.arange(len(tests)), label[is_held]]
        model.least = float(np.quantile(own, 0.01)) * LEAST_SHARE
        loss = {}
        for scale in SCALES:
            model.scale = scale
            e = np.exp(scale * (s - s.max(axis=1, keepdims=True)))
            loss[scale] = -np.log(np.maximum(e[np.arange(len(tests)), label[is_held]] / e.sum(axis=1), 1e-6)).mean()
        model.scale = min(loss, key=loss.get)
    return model


SENTENCES_PER_DOCUMENT = 40
SENTENCES_PER_LANGUAGE = 600


def fit_on_documents(samples: list[tuple[str, str]], documents: list[tuple[str, str]], per_document: int = SENTENCES_PER_DOCUMENT, per_language: int = SENTENCES_PER_LANGUAGE) -> Model:
    """A model of sample sentences and of labelled documents (language, text), whose labels may be wrong or whose text may change language.

    A first model of the samples alone tells which documents are in the language of their label and drops sentences that clearly
    are in another; a second one, of what is left, drops those it places elsewhere; the third is the result. Of a document at most `per_document`
    sentences are read, spread evenly over it, and of a language at most `per_language`.
    """
    model = fit(samples)
    vocabulary = Vocabulary()
    pool: list[tuple[str, str, list[str]]] = []
    for lang, text in documents:
        if lang not in model.languages:
            continue
        found = sentences(text)
        parts = [text[s.start : s.end] for s in (found if len(found) <= per_document else [found[i * len(found) // per_document] for i in range(per_document)])]
        lists = [words_of(p) for p in parts]
        if not any(lists):
            continue
        k = model.languages.index(lang)
        s = model.similarities([sum(lists, []), *lists], vocabulary)
        if s[0].argmax() == k:
            pool += [(lang, p, w) for p, w, row in zip(parts, lists, s[1:], strict=True) if len(w) >= 3 and row[k] >= row.max() - 0.18]
    for _ in range(2):
        by_language: dict[str, list[str]] = {}
        for lang, p, _w in pool:
            by_language.setdefault(lang, []).append(p)
        chosen = []
        for lang, parts in by_language.items():
            step = max(1.0, len(parts) / per_language)
            chosen += [(lang, parts[int(i * step)]) for i in range(min(per_language, len(parts)))]
        model = fit(samples + chosen)
        vocabulary = Vocabulary()
        if pool:
            s = model.similarities([w for _, _, w in pool], vocabulary)
            pool = [x for x, row in zip(pool, s, strict=True) if row[model.languages.index(x[0])] >= row.max() - 0.06]
    return model


#: What a change between two languages costs: the first for languages that share nothing, the second for the two that are nearest to each other.
SWITCH = (0.04, 0.18)


def switch_costs(model: Model, low: float, high: float) -> np.ndarray:
    """The cost of a change between each two languages, by how alike their centroids are: a sentence may look like the next of kin more easily than like a stranger."""
    n = len(model.languages)
    alike = np.zeros((n, n))
    near = model.centroids.T @ model.centroids
    for i in range(n):
        for j in range(n):
            alike[i, j] = 0.0 if i == j else near[np.ix_(model.owner == i, model.owner == j)].max()
    costs = low + (high - low) * alike / max(alike.max(), 1e-12)
    np.fill_diagonal(costs, 0.0)
    return costs


def _path(scores: np.ndarray, weights: np.ndarray, switch: np.ndarray | float) -> list[int]:
    """The best language of each unit when a change costs `switch`, one value or one for each pair of languages."""
    n, k = scores.shape
    costs = switch if isinstance(switch, np.ndarray) else switch * (1 - np.eye(k))
    best, back = scores[0] * weights[0], np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        by = best[:, None] - costs
        back[i] = by.argmax(axis=0)
        stay = by.diagonal() >= by.max(axis=0)
        back[i, stay] = np.flatnonzero(stay)
        best = by.max(axis=0) + scores[i] * weights[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def _words_with_places(text: str, start: int, end: int) -> list[tuple[int, list[str]]]:
    quoted = [m.span() for m in _QUOTED.finditer(text, start, end)]
    out = []
    for m in _TOKEN.finditer(text, start, end):
        if any(a <= m.start() < b for a, b in quoted):
            continue
        w = words_of(m[0])
        if w:
            out.append((m.start(), w))
    return out


LONG_WORDS = 12
WINDOW_WORDS = 8
WORD_SWITCH = 1.2


def stretches(texts: list[str | None], model: Model, vocabulary: Vocabulary) -> list[list[tuple[int, str | None, float]]]:
    """For each text its stretches (start, language, confidence), the first at 0; none for a text without words.

    Sentences are the units. Each is held against the centroids; a path through the languages that pays for every change gives
    each its language, so that a doubtful sentence goes with its neighbours. A sentence of many words may hide a change where
    punctuation got lost, so it is also gone through word by word. A text too far from every centroid gets the language null.
    """
    docs = [sentences(t) if t else [] for t in texts]
    costs = switch_costs(model, *SWITCH)
    units: list[list[str]] = []
    spans: list[list[tuple[int, int, int]]] = []  # start, end, unit number
    for t, found in zip(texts, docs, strict=True):
        mine = []
        for s in found:
            words = words_of(t[s.start : s.end])
            if words:
                mine.append((s.start, s.end, len(units)))
                units.append(words)
        spans.append(mine)
    scores = model.similarities(units, vocabulary)
    lengths = np.array([len(u) for u in units])
    # words of long units, for changes inside
    longs = [i for i, u in enumerate(units) if len(u) >= LONG_WORDS]
    inside: dict[int, list[tuple[int, int]]] = {}
    if longs:
        # overlapping windows of a few words: a change in the middle shows in one of them, however little it is of the whole
        windows = [(i, units[i][k : k + WINDOW_WORDS]) for i in longs for k in range(0, max(1, len(units[i]) - WINDOW_WORDS // 2), WINDOW_WORDS // 2)]
        best = model.similarities([w for _, w in windows], vocabulary).argmax(axis=1)
        suspects = {i for (i, _), k in zip(windows, best, strict=True) if k != scores[i].argmax()}
        where = {u: (d, a, b) for d, mine in enumerate(spans) for a, b, u in mine if u in suspects}
        for u, (d, a, b) in where.items():
            tokens = _words_with_places(texts[d], a, b)
            if len(tokens) < 6:
                continue
            around = [sum((w for _, w in tokens[max(0, i - 1) : i + 2]), []) for i in range(len(tokens))]
            s = model.similarities([w for _, w in tokens], vocabulary) + 0.5 * model.similarities(around, vocabulary)
            path = _path(s, np.ones(len(tokens)), WORD_SWITCH)
            runs = [(tokens[i][0], path[i]) for i in range(len(path)) if i == 0 or path[i] != path[i - 1]]
            if len(runs) > 1:
                inside[u] = [(a if k == 0 else place, lang) for k, (place, lang) in enumerate(runs)]
    out = []
    for mine in spans:
        if not mine:
            out.append([])
            continue
        numbers = [u for _, _, u in mine]
        weight = np.minimum(lengths[numbers], 8) / 8.0
        path = _path(scores[numbers], weight * 2, costs) if len(numbers) > 1 else [int(scores[numbers[0]].argmax())]
        pieces: list[tuple[int, int, list[int]]] = []
        for (a, _, u), lang in zip(mine, path, strict=True):
            for place, which in inside.get(u, [(a, lang)]):
                if pieces and pieces[-1][1] == which:
                    pieces[-1][2].append(u)
                else:
                    pieces.append((place, which, [u]))
        got = []
        for k, (place, lang, members) in enumerate(pieces):
            w = lengths[members][:, None]
            mean = (scores[members] * w).sum(axis=0) / w.sum()
            known = mean[lang] >= model.least
            got.append((0 if k == 0 else place, model.languages[lang] if known else None, float(model.confidence(mean)) if int(mean.argmax()) == lang else 0.5))
        out.append(got)
    return out
