"""Toxicity by a support vector machine over a gapped string kernel, with Nystrom landmarks.

The kernel of two words counts their common subsequences of three signs, start and end of the
word being signs too, each weighted by decay to the power of the stretch it spans, at most five
signs; so an insult with a character put in or left out still resembles it.  Runs of single
characters count as one word.

Fitting reads a bounded sample of labelled documents.  Landmarks are words of sentences of both
kinds: words that toxic documents hold at least twice as often as clean ones, beyond what chance explains, taken by pivoted
Cholesky steps on their kernel, and then those words of clean documents that come nearest to them.  A sentence has, for
each landmark, the greatest resemblance among its words, and the machine works on these, whitened by the kernel between landmarks.
Toxic documents stand in the training set twice more with their telling words misspelt: with a sign or letter put
in, one left out, or signs or blanks between all letters.  Labels belong to documents, so sentences get theirs in
rounds: the best sentence of a toxic document is toxic, if it is beyond the best ones of most clean documents, all sentences of other
documents are clean, the machine is trained, and best sentences are taken anew.  A document's score is its sentences'
margins, turned into a probability; nothing else enters it.

Scoring is one narrow pass.  Sums of landmark weights per subsequence bound what a word
can reach, so the kernel is worked out only for words that may resemble a landmark;
the bound is never below the kernel, so nothing is lost.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import packed, row_columns, text_or_empty

#: Labelled documents that fitting reads, toxic and clean each, and characters of each at most: longer ones are not read.
SAMPLE, FIT_CHARS = 2000, 20_000
#: Words that landmarks are chosen from, landmarks, and clean sentences that the machine is trained on, the worst ones.
POOL, LANDMARKS, NEGATIVES = 1200, 48, 12_000
#: Documents with a word this much like a telling one are more among toxic ones than among clean ones, by so many standard errors.
ALIKE, ERRORS = 0.4, 4.0
#: A telling word is held by toxic documents so many times as often as by clean ones.  In a large sample endings and short words
#: pass the test of chance too, as toxic documents differ a little in length and language, and say nothing of a sentence.
LIFT = 2.0
#: Misspelt copies of each toxic document, for so many documents.
COPIES, COPIED = 2, 500
#: Landmarks among clean words for each telling one.
NEAREST = 2
#: Rounds in which sentences of toxic documents get their labels, cost of a miss, and the margin from which on all sentences of theirs count as toxic.
ROUNDS, COST, POSITIVE = 2, 3.0, 0.5
#: A sentence is toxic only if it is beyond the best ones of this share of clean documents.
USUAL = 0.9
DECAY, POWER = 0.7, 2
#: The kernel is cut off here: below this resemblance a word counts as not resembling the landmark.
LEAST = 0.2
#: Added to the kernel between landmarks before it is inverted, and words that a worker remembers.
RIDGE, KNOWN = 0.1, 120_000
THRESHOLD = 0.7
_GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_STEP = 512 << 10
#: Signs that may stand around a word.
_AROUND = ".,;:!?\"'()[]{}*#%&$-_"
_LETTERS_ONLY = re.compile(r"[^\W_]+")


def _alphabet() -> np.ndarray:
    """Codes of bytes: 0 blank, 63 other signs, 1 to 61 letters; digits and signs that stand for letters count as these."""
    codes = np.full(256, 63, np.uint8)
    codes[[32, 9, 10, 11, 12, 13]] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        codes[ord(c)] = codes[ord(c.upper())] = k + 1
    for k in range(10):
        codes[48 + k] = 27 + k
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        codes[ord(sign)] = codes[ord(letter)]
    codes[128:] = 37 + np.arange(128) % 25
    return codes


_CODES = _alphabet()
_LETTER = (_CODES > 0) & (_CODES < 63)
_START, _END, _OTHER = 0, 62, 63


def features(word: bytes) -> dict[int, float]:
    """Weights of the subsequences of a word with its start and end."""
    c = [_START, *_CODES[np.frombuffer(word, np.uint8)].tolist(), _END]
    c = [_OTHER if x == 0 and k else x for k, x in enumerate(c)]
    found: dict[int, float] = {}
    for i in range(len(c)):
        for a, b in _GAPS:
            if i + b < len(c) and _OTHER not in (c[i], c[i + a], c[i + b]):
                key = c[i] << 12 | c[i + a] << 6 | c[i + b]
                found[key] = found.get(key, 0.0) + DECAY ** (b + 1)
    return found


def kernel(a: bytes, b: bytes) -> float:
    """Resemblance of two strings, 0 to 1."""
    x, y = features(a), features(b)
    norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return (sum(v * y[k] for k, v in x.items() if k in y) / norm**0.5) ** POWER if norm else 0.0


@dataclass
class Words:
    """Words of many texts put together, each with its text and its sentence."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    sentence: np.ndarray


def split_words(texts: list[str]) -> Words:
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    # A blank before the first word too, as its start.
    data = b"\n" + b"\n".join(parts)
    octets = np.frombuffer(data, np.uint8)
    codes = _CODES[octets]
    edge = np.diff(np.concatenate([[True], codes == 0, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts):
        # Single letters in a row are one word: i d i o t.
        sums = np.concatenate([[0], np.cumsum(_LETTER[octets])])
        single = (sums[ends] - sums[starts] <= 1) & (ends - starts <= 2)
        joins = single[:-1] & single[1:] & (starts[1:] - ends[:-1] == 1)
        starts, ends = starts[np.concatenate([[True], ~joins])], ends[np.concatenate([~joins, [True]])]
    stops = np.flatnonzero((octets == 46) | (octets == 33) | (octets == 63) | (octets == 10))
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts - 1, "right")
    # A stop inside a word does not end its sentence before the word does.
    return Words(data, starts, ends, text, np.searchsorted(stops, starts, "right"))


def weighed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many words at once: numbers of words, keys, weights; each key once for a word."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words) + b" " * 4, np.uint8)
    codes = _CODES[data].astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    codes[codes == 0] = _OTHER
    codes[ends - lengths], codes[ends - 1] = _START, _END
    n = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(n)
    x = codes[:n]
    keys, values = [], []
    for a, b in _GAPS:
        y, z = codes[a : n + a], codes[b : n + b]
        good = np.flatnonzero((room > b) & (x != _OTHER) & (y != _OTHER) & (z != _OTHER))
        keys.append(owner[good] << 18 | x[good] << 12 | y[good] << 6 | z[good])
        values.append(np.full(len(good), DECAY ** (b + 1)))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> 18, key & (1 << 18) - 1, np.bincount(place, np.concatenate(values), len(key))


class Landmarks:
    """Landmark strings, their subsequence weights, and the whitening of their kernel."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        owner, key, value = weighed(strings)
        norm = np.sqrt(np.bincount(owner, value**2, len(strings)))
        keys = np.unique(key)
        self.column = np.full(1 << 18, -1, np.int32)
        self.column[keys] = np.arange(len(keys))
        self.table = np.zeros((len(strings), len(keys)))
        self.table[owner, self.column[key]] = value / norm[owner]
        self.bound = np.zeros(1 << 18, np.float32)
        self.bound[keys] = self.table.max(0, initial=0)
        values, vectors = np.linalg.eigh((self.table @ self.table.T) ** POWER + RIDGE * np.eye(len(strings)))
        self.white = vectors @ np.diag(values**-0.5) @ vectors.T

    def resemblances(self, words: list[bytes]) -> np.ndarray:
        """Kernel of each word with every landmark, values below LEAST as 0."""
        result = np.zeros((len(words), len(self.strings)))
        for low in range(0, len(words), 1000):
            part = words[low : low + 1000]
            owner, key, value = weighed(part)
            norm = np.sqrt(np.bincount(owner, value**2, len(part)))
            column = self.column[key]
            on = column >= 0
            dense = np.bincount(owner[on] * self.table.shape[1] + column[on], value[on], len(part) * self.table.shape[1])
            result[low : low + 1000] = (dense.reshape(len(part), -1) @ self.table.T / np.maximum(norm, 1e-300)[:, None]) ** POWER
        result[result < LEAST] = 0.0
        return result

    def candidates(self, words: Words) -> np.ndarray:
        """Words that may resemble a landmark: the sum of bounds is not below LEAST times the least norm of such a word."""
        if not len(words.starts):
            return words.starts
        octets = np.frombuffer(words.data, np.uint8)
        n = len(octets)
        codes = np.zeros(n + 5, np.int32)
        codes[:n] = _CODES[octets]
        # The blank before a word is its start, as the first of three, and the one after it its end, as a later one.
        later = codes.copy()
        later[words.ends] = _END
        starts, lengths = words.starts - 1, words.ends - words.starts + 1
        for_word = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(for_word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[for_word]
        room = words.ends[for_word] + 1 - inside
        total = np.zeros(len(inside), np.float32)
        first = codes[inside] << 12
        for a, b in _GAPS:
            triple = first | later[inside + a] << 6 | later[inside + b]
            total += np.where(room > b, self.bound[triple], np.float32(0)) * np.float32(DECAY ** (b + 1))
        sums = np.add.reduceat(total, np.cumsum(lengths) - lengths)
        # Each triple in a row adds its own square to a word's norm; other signs only take from it.
        letters = np.add.reduceat(_LETTER[octets[inside]].astype(np.int64), np.cumsum(lengths) - lengths)
        plain = letters >= lengths - 1  # words with other signs in them are always looked at if anything matches
        squares = np.maximum(lengths - 1, 0) * DECAY**6 + 2 * np.maximum(lengths - 2, 0) * DECAY**8 + 3 * np.maximum(lengths - 3, 0) * DECAY**10
        return np.flatnonzero((sums > 0) & (sums >= 0.999 * LEAST ** (1 / POWER) * np.where(plain, squares, 0.0) ** 0.5))

    def places(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words of texts that may resemble a landmark, each with its text and its sentence."""
        words = split_words(texts)
        maybe = self.candidates(words)
        own = [words.data[s:e] for s, e in zip(words.starts[maybe].tolist(), words.ends[maybe].tolist(), strict=True)]
        return own, words.text[maybe], words.sentence[maybe]


def _parts(owner: np.ndarray, sentence: np.ndarray, most: int = 20_000):
    """Bounds of runs of about so many words that end where sentences do."""
    low = 0
    while low < len(owner):
        high = min(low + most, len(owner))
        while high < len(owner) and owner[high] == owner[high - 1] and sentence[high] == sentence[high - 1]:
            high += 1
        yield low, high
        low = high


@dataclass
class Model:
    """A fitted scorer."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    #: Weights of the columns of summary.
    scale: np.ndarray
    known: dict[bytes, np.ndarray]

    def near(self, words: list[bytes]) -> np.ndarray:
        """Resemblances of each word with the landmarks."""
        new = sorted({w for w in words if w not in self.known})
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = sorted(set(words))
        self.known.update(zip(new, self.landmarks.resemblances(new).astype(np.float32), strict=True))
        return np.array([self.known[w] for w in words], np.float32).reshape(len(words), len(self.landmarks.strings))

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sentences with a word that may resemble a landmark: their texts, and for each landmark the greatest resemblance among their words."""
        text, best, low = [], [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= _STEP):
                size += len(texts[high])
                high += 1
            words, owner, sentence = self.landmarks.places(texts[low:high])
            for a, b in _parts(owner, sentence):
                own = owner[a:b]
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (sentence[a + 1 : b] != sentence[a : b - 1])])
                text.append(own[new] + low), best.append(np.maximum.reduceat(self.near(words[a:b]), new, axis=0))
            low = high
        return (np.concatenate(text), np.concatenate(best)) if text else (np.zeros(0, np.int64), np.zeros((0, len(self.landmarks.strings)), np.float32))

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts and margins of the sentences that may resemble a landmark.  All others have the margin bias."""
        text, best = self.pooled(texts)
        return text, best @ self.landmarks.white @ self.weights + self.bias

    def summary(self, texts: list[str]) -> np.ndarray:
        """For each text its greatest margin, the sum of the positive ones of its sentences, that for a hundred words, and 1."""
        text, margin = self.sentences(texts)
        most, total = np.full(len(texts), self.bias), np.zeros(len(texts))
        np.maximum.at(most, text, margin)
        np.add.at(total, text, np.maximum(margin, 0))
        words = np.array([max(t.count(" ") + t.count("\n") + 1, 30) for t in texts], float)
        return np.stack([np.clip(most, -3, 3), np.log1p(total), np.log1p(100 * total / words), np.ones(len(texts))], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.summary(texts) @ self.scale, -40, 40)))


def pool_of_words(toxic: list[str], clean: list[str], most: int = POOL) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of toxic texts, by how much more of these than of clean ones they are held, and whether LIFT times as often: the most ones, by the size of that difference."""
    held = []
    for texts in (toxic, clean):
        counts: Counter = Counter()
        for low in range(0, len(texts), 50):
            words = split_words(texts[low : low + 50])
            own = {(t, words.data[s:e].strip(_AROUND.encode())) for t, s, e in zip(words.text.tolist(), words.starts.tolist(), words.ends.tolist(), strict=True)}
            counts.update(w for _, w in own if len(held) == 0 or w in held[0])
        held.append(counts)
    more = {w: k / len(toxic) - held[1][w] / len(clean) for w, k in held[0].items() if features(w)}
    chosen = sorted(sorted(more, key=lambda w: (-abs(more[w]), w))[:most])
    often = [held[0][w] / len(toxic) >= LIFT * held[1][w] / len(clean) for w in chosen]
    return chosen, np.array([more[w] for w in chosen]), np.array(often, bool)


def misspelt(word: str, pick: random.Random) -> str:
    """The word with a letter or sign put in, a letter left out or doubled, or signs or blanks between its letters."""
    if len(word) < 3:
        return word
    at, way = pick.randrange(1, len(word)), pick.randrange(8)
    if way < 3:
        return word[:at] + pick.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]
    if way == 3:
        return word[:at] + pick.choice("-_.*") + word[at:]
    if way == 4:
        return word[: at - 1] + word[at:] if at > 1 else word[:1] + word[2:]
    if way == 5:
        return word[:at] + word[at - 1] + word[at:]
    return pick.choice(".-_*" if way == 6 else " ").join(word)


def like_words(landmarks: Landmarks, texts: list[str]) -> set[str]:
    """Words of the texts that resemble a landmark by ALIKE or more, without the signs around them."""
    found: set[str] = set()
    for low in range(0, len(texts), 50):
        words = sorted(set(landmarks.places(texts[low : low + 50])[0]))
        near = landmarks.resemblances(words).max(1, initial=0)
        found.update(w.decode("utf-8", "ignore").strip(_AROUND) for w, r in zip(words, near.tolist(), strict=True) if r >= ALIKE)
    return found


def misspelt_texts(texts: list[str], words: set[str], salt: int) -> list[str]:
    """texts with each of the words misspelt wherever it stands; texts and salt alone decide how."""
    out = []
    for text in texts:
        pick = random.Random(zlib.crc32(text.encode("utf-8", "replace")) + salt)
        out.append(_LETTERS_ONLY.sub(lambda found, pick=pick: misspelt(found.group(), pick) if found.group().lower() in words else found.group(), text))
    return out


def train_machine(positive: np.ndarray, negative: np.ndarray, often: np.ndarray, seldom: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss) by Newton's method, on rows that count often and seldom times.

    Both kinds weigh the same in all.
    """
    x1 = np.concatenate([positive, negative])
    x1 = np.hstack([x1, np.ones((len(x1), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = cost * np.r_[often / often.sum(), seldom / seldom.sum()] * len(positive)
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    value = lambda v: 0.5 * v @ v + (weight * np.maximum(1 - y * (x1 @ v), 0) ** 2).sum()
    now = value(w)
    for _ in range(50):
        miss = 1 - y * (x1 @ w)
        on = miss > 0
        gradient = w - 2 * x1[on].T @ (weight[on] * y[on] * miss[on])
        step = np.linalg.solve(ridge + 2 * x1[on].T @ (x1[on] * weight[on, None]), gradient)
        size = 1.0
        while size > 1e-4 and value(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, value(w)
        if before - now <= 1e-8 * abs(before):
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, each: float = 1.0) -> np.ndarray:
    """Weights of the columns of x, by Newton's method with a small penalty; rows of the first kind count each, and the lesser kind weighs more, by the root of what it lacks."""
    weight = np.where(y > 0, each, (each * (y > 0).sum() / max((y < 0).sum(), 1)) ** 0.5)
    t = np.where(y > 0, 1.0 - 1e-3, 1e-3)
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(b)), x.T @ (weight * (p - t)) + 1e-2 * b)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b


def shares(landmarks: Landmarks, texts: list[str]) -> np.ndarray:
    """For each landmark, how many of the texts have a word that resembles it by ALIKE or more."""
    has = np.zeros(len(landmarks.strings))
    for low in range(0, len(texts), 50):
        words, owner, _ = landmarks.places(texts[low : low + 50])
        if words:
            near = np.zeros((50, len(landmarks.strings)))
            np.maximum.at(near, owner, landmarks.resemblances(words))
            has += (near >= ALIKE).sum(0)
    return has / len(texts)


def weighed_words(toxic: list[str], clean: list[str], most: int) -> tuple[list[bytes], np.ndarray]:
    """Words by pivoted Cholesky steps on the pool: the next is the one with the greatest part of the difference left, words like it counted too.

    Those stay whose likes toxic texts hold more often than clean ones, by ERRORS standard errors and LIFT times.  The second
    list says how much each tells: which part of the toxic texts that hold its likes is more than the clean ones explain.
    """
    pool, more, often = pool_of_words(toxic, clean)
    if not often.any():
        return [], np.zeros(0)
    table = Landmarks(pool).table
    left, chosen = (table @ table.T) ** POWER, []
    while len(chosen) < most:
        gain = np.where(often & (np.diag(left) > 0.2), np.abs(left @ more), -1.0)
        pivot = int(gain.argmax())
        if gain[pivot] <= 0:
            break
        chosen.append(pool[pivot])
        left = left - np.outer(left[:, pivot], left[pivot]) / left[pivot, pivot]
    landmarks = Landmarks(chosen)
    p, q = shares(landmarks, toxic), shares(landmarks, clean)
    both = (p * len(toxic) + q * len(clean)) / (len(toxic) + len(clean))
    error = np.sqrt(both * (1 - both) * (1 / len(toxic) + 1 / len(clean)))
    good = np.flatnonzero((p - q > ERRORS * error) & (p >= LIFT * q))
    return [chosen[k] for k in good], 1 - q[good] / p[good]


def telling_words(toxic: list[str], clean: list[str], most: int) -> list[bytes]:
    """The words of weighed_words() alone."""
    return weighed_words(toxic, clean, most)[0]


def nearest_clean(landmarks: Landmarks, clean: list[str], each: int) -> list[bytes]:
    """For each landmark the words of clean texts that resemble it most, without itself, none of them much like another."""
    seen: set[bytes] = set()
    for low in range(0, len(clean), 50):
        seen.update(landmarks.places(clean[low : low + 50])[0])
    words = sorted(seen)
    near = landmarks.resemblances(words)
    chosen: list[bytes] = []
    for k in range(len(landmarks.strings)):
        own: list[bytes] = []
        for i in np.argsort(-near[:, k], kind="stable")[: 8 * each].tolist():
            if len(own) < each and 0 < near[i, k] < 0.9 and all(kernel(words[i], w) < 0.8 for w in [*chosen, *own]):
                own.append(words[i])
        chosen += own
    return chosen


def fit(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> Model:
    """A model from the texts of toxic and clean documents; without either kind it calls nothing toxic."""
    telling, told = weighed_words(toxic, clean, most) if toxic and clean else ([], np.zeros(0))
    if not telling:
        return Model(Landmarks([]), np.zeros(0), -1.0, np.array([0.0, 0.0, 0.0, -6.0]), {})
    chosen = telling + nearest_clean(Landmarks(telling), clean, NEAREST)
    model = Model(Landmarks(chosen), np.zeros(len(chosen)), -1.0, np.zeros(4), {})
    words = like_words(Landmarks(telling), toxic)
    given = len(toxic)
    toxic = toxic + [t for k in range(1, COPIES + 1) for t in misspelt_texts(toxic[:COPIED], words, k)]
    owner, near = model.pooled(toxic)
    owner, near = owner[near.any(1)], near[near.any(1)]
    clean_owner, clean_near = model.pooled(clean)
    other, place, seldom = np.unique(clean_near, axis=0, return_inverse=True, return_counts=True)
    x, y = near @ model.landmarks.white, other @ model.landmarks.white
    none = np.zeros((1, len(chosen)))  # a sentence that resembles no landmark is clean
    # At first a sentence is as toxic as its likeness to a telling word, by what that word tells.
    margin, clean_margin = ((v[:, : len(telling)] * told).max(1, initial=0) for v in (near, other))
    for _ in range(ROUNDS + 1):
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, owner, margin)
        # A toxic document whose best sentence is no worse than those of many clean ones has none of its own.
        usual = np.full(len(clean), -np.inf)
        np.maximum.at(usual, clean_owner, clean_margin[place.reshape(-1)])
        # Where many clean documents hold a telling word too, that bar is out of reach, and the best sentences of all teach.
        bar = min(np.sort(usual)[int(USUAL * (len(clean) - 1))], margin.max(initial=-1.0) - 1e-9)
        positive = (margin >= np.minimum(best[owner], POSITIVE)) & (margin > bar)
        # Clean sentences that come nearest to toxic ones say where the border lies.
        hard = np.argsort(-clean_margin, kind="stable")[:NEGATIVES]
        rows, often = np.unique(x[positive], axis=0, return_counts=True)
        if not len(rows):
            break
        model.weights, model.bias = train_machine(rows, np.concatenate([y[hard], none]), often, np.r_[seldom[hard], max(1, len(clean) // 4)])
        margin, clean_margin = x @ model.weights + model.bias, y @ model.weights + model.bias
    x = np.concatenate([model.summary(toxic), model.summary(clean)])
    # Copies take their part of what the documents given weigh.
    model.scale = fit_logistic(x, np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))]), given / len(toxic))
    model.known.clear()
    return model


def held_out(doc_id) -> F.Column:
    """True for the third of documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts of at most sample toxic and sample clean documents, held-out ones left out, in order of a hash of doc_id.

    Documents of more than FIT_CHARS characters are not read, so that the driver holds 2 sample FIT_CHARS at most.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
    known = known.where("toxic = least")
    pick = lambda kind: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(1).unionByName(pick(0)).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.length("text") <= FIT_CHARS)
    texts = texts.join(F.broadcast(chosen), "doc_id")
    # Repeated rows of a document stand once for it.
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    got = list(zip(rows.column("toxic").to_pylist(), rows.column("text").to_pylist(), strict=True))
    return [t for k, t in got if k == 1], [t for k, t in got if k == 0]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) -> row for row: row (all columns of docs, as a struct), score.

    Null and empty texts have the score of a text without any word.  Repeated rows have equal
    scores.  No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed_docs = packed(docs, text_or_empty().alias("text"))
    schema = packed_docs.select("row", F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                score = pa.array(sent.value.score(part.column(1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), score], ["row", "score"])

    return packed_docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted, row for row; the model is fitted on labelled_docs and labels.

    A null doc_id is not held out.  Labels other than 0 and 1, and ids with both, teach nothing.
    """
    model = fit(*training_sample(labelled_docs, labels, sample))
    found = scored(docs.select("doc_id", "text"), model)
    doc_id = F.col("row.doc_id")
    return found.select(
        doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not called toxic, with the columns of docs."""
    model = fit(*training_sample(labelled_docs, labels, sample))
    return scored(docs, model).where(F.col("score") < threshold).select(row_columns(docs))
