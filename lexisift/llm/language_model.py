"""Language by family first, then by one-versus-one linear support vector machines.

A sentence is folded (lower case, Latin, Greek and Cyrillic letters without accents, figures
that a scan put for letters read as letters; letters of every script stay) and represented by
its hashed character n-grams, their counts divided by the root of their number. A machine
separates each two families, and within a family each two languages. The family with most
wins decides, then the language of it with most wins; ties go to the larger sum of margins.

Sentences are handled together, as one array of code points with zeros between them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np

#: Hashed n-grams have BUCKETS = 2 ** BITS columns.
BITS = 15
BUCKETS = 1 << BITS
#: Lengths of the n-grams.
LENGTHS = (2, 3, 4, 5)
#: Sentences of each language that a model is fitted on, at most.
MOST_SAMPLES = 150
#: Penalty of the support vector machines, and rounds over the sentences.
PENALTY, ROUNDS = 10.0, 200
#: Steepness of the confidence as a function of a margin.
STEEPNESS = 4.0
#: Characters judged at once. A longer sentence is judged in such parts, whose sums are added.
PART_CHARS = 25_000
#: Families of languages by ISO 639-1 code. A code that is missing is a family of its own.
FAMILIES = {
    "Baltic": ("lt", "lv"),
    "Celtic": ("br", "cy", "ga", "gd"),
    "Dravidian": ("kn", "ml", "ta", "te"),
    "Germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "Indo-Aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "Iranian": ("fa", "ku", "ps", "tg"),
    "Malayic": ("id", "ms"),
    "Romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "Semitic": ("am", "ar", "he", "mt"),
    "Slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "Turkic": ("az", "kk", "ky", "tr", "uz"),
    "Uralic": ("et", "fi", "hu"),
}

_SPACE, _UNSEEN, _DROPPED = 32, 0xFFFFFFFF, 0xFFFFFFFE
_FIGURES = re.compile("[01]+")
_LETTER_FOR_FIGURE = str.maketrans("01", "ol")
_QUOTED = re.compile("[“„«\"][^“”„«»\"\0]{0,200}[”»\"]")
#: What each code point is folded to, filled when a code point is first seen.
_FOLDED = np.full(0x110000, _UNSEEN, np.uint32)
_FOLDED[0], _FOLDED[39] = 0, 39


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def _fold_to(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if kind[0] == "M":
        signs_of_vowels = 0x0591 <= c <= 0x05C7 or 0x064B <= c <= 0x065F or c == 0x0670
        return _DROPPED if 0x0300 <= c <= 0x036F or signs_of_vowels else c
    return c if kind[0] == "L" else _DROPPED if kind == "Cf" else _SPACE


def _letters_in_words(m: re.Match) -> str:
    """Figures beside a letter as letters, unless other figures stand there too."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    in_word = (before.isalpha() or after.isalpha()) and not (before.isdigit() or after.isdigit())
    return m[0].translate(_LETTER_FOR_FIGURE) if in_word else m[0]


def _codes(joined: str) -> np.ndarray:
    """Sentences, parted by zeros, as folded code points: single blanks between words, one at either end."""
    s = unicodedata.normalize("NFKD", joined.lower()).replace("ß", "ss").replace("’", "'")
    if "0" in s or "1" in s:
        s = _FIGURES.sub(_letters_in_words, s)
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _FOLDED[codes]
    if (folded == _UNSEEN).any():
        for c in np.unique(codes[folded == _UNSEEN]).tolist():
            _FOLDED[c] = _fold_to(c)
        folded = _FOLDED[codes]
    folded = folded[folded != _DROPPED]
    blank = folded == _SPACE
    again = np.zeros(len(blank), bool)
    again[1:] = blank[1:] & blank[:-1]
    return folded[~again]


def fold(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, begins): the folded sentences, each ended by a zero, and where each begins.

    Quoted titles are left out, unless nothing else is left of the sentence.
    """
    plain = [s.replace("\0", " ") if "\0" in s else s for s in sentences]
    whole = " " + " \0 ".join(plain) + " \0"
    codes = _codes(_QUOTED.sub(" ", whole))
    ends = np.flatnonzero(codes == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    bare = np.flatnonzero(ends - begins <= 1)
    if len(bare) and any(any(q in plain[i] for q in "“„«\"") for i in bare):
        parts = np.split(codes, ends[:-1] + 1)
        for i in bare.tolist():
            parts[i] = _codes(f" {plain[i]} \0")
        codes = np.concatenate(parts)
        ends = np.flatnonzero(codes == 0)
        begins = np.concatenate([[0], ends[:-1] + 1])
    return codes, begins


def grams(codes: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the bucket of the n-gram that begins at each place; BUCKETS where it would reach beyond its sentence."""
    ends = np.append(begins[1:], len(codes)) - 1
    h = np.zeros(len(codes), np.uint64)
    padded = np.concatenate([codes, np.zeros(max(LENGTHS), np.uint32)]).astype(np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h * np.uint64(1_000_003) + padded[n - 1 : n - 1 + len(codes)]
        if n in LENGTHS:
            bucket = (((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
            beyond = (ends[:, None] - np.arange(n)).ravel()  # of a sentence shorter than n also places before it, near its predecessor's end
            bucket[beyond[beyond >= 0]] = BUCKETS
            yield bucket


def _counts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The number of n-grams of each sentence."""
    length = np.append(begins[1:], len(codes)) - 1 - begins
    return sum(np.maximum(length - n + 1, 0) for n in LENGTHS)


def _features(sentences: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each sentence, sparse."""
    out = []
    for s in sentences:
        codes, begins = fold([s])
        bucket, n = np.unique(np.concatenate(list(grams(codes, begins))), return_counts=True)
        n = n[bucket < BUCKETS]
        out.append((bucket[bucket < BUCKETS], n / np.sqrt(max(1, n.sum()))))
    return out


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of a support vector machine with squared hinge loss: dual coordinate descent on sparse rows."""
    w, a = np.zeros(BUCKETS + 1), np.zeros(len(y))
    diagonal = np.array([(v * v).sum() for _, v in rows]) + 1 + 1 / (2 * PENALTY)
    rng = np.random.default_rng(0)
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, v = rows[i]
            margin = y[i] * (w[at] @ v + w[-1])
            step = max(0.0, a[i] - (margin - 1 + a[i] / (2 * PENALTY)) / diagonal[i]) - a[i]
            if step:
                a[i] += step
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    """langs: the codes; families: that of each; pairs: (kind, first, second) of each machine; weights: a row each bucket and one of zeros; bias: of each machine."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def _sums(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of weights, a row per part and a column per machine; the number of n-grams; whether there are letters."""
        codes, begins = fold(parts)
        each, more = np.zeros((2, len(codes), len(self.pairs)), np.float32)
        for bucket in grams(codes, begins):
            each += np.take(self.weights, bucket, 0, more, "clip")  # none is out of bounds; the default mode would copy
        letters = np.append(begins[1:], len(codes)) - 1 - begins > 1
        return np.add.reduceat(each, begins, 0), _counts(codes, begins), letters

    def margins(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row per sentence, a column per machine; and whether the sentence has letters."""
        sums, n, letters = np.zeros((len(sentences), len(self.pairs))), np.zeros(len(sentences)), np.zeros(len(sentences), bool)
        parts, of, chars = [], [], 0

        def add() -> None:
            s, k, has = self._sums(parts)
            at = np.array(of)
            np.add.at(sums, at, s)
            np.add.at(n, at, k)
            letters[at[has]] = True
            parts.clear()
            of.clear()

        for i, sentence in enumerate(sentences):
            at = 0
            while at < len(sentence):
                to = at + PART_CHARS
                if to < len(sentence) and (blank := sentence.rfind(" ", at + PART_CHARS // 2, to)) > 0:
                    to = blank
                parts.append(sentence[at:to])
                of.append(i)
                chars += len(parts[-1])
                at = to
                if chars >= PART_CHARS:
                    add()
                    chars = 0
        if parts:
            add()
        return sums / np.sqrt(np.maximum(n, 1))[:, None] + self.bias, letters

    def predict(self, sentences: list[str]) -> tuple[list[str | None], np.ndarray]:
        """The language of each sentence and its confidence from 0 to 1; none (0) where no letters are left."""
        if not sentences or not self.langs:
            return [None] * len(sentences), np.zeros(len(sentences))
        of_family = sorted(set(self.families))
        m, letters = self.margins(sentences)

        def winners(kind: str, n_names: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wins, total = np.zeros((2, len(among), n_names))
            weakest = np.full((len(among), n_names), np.inf)
            for j, (k, a, b) in enumerate(self.pairs):
                if k == kind:
                    margin = m[among, j]
                    for at, sign in ((a, 1), (b, -1)):
                        wins[:, at] += sign * margin > 0
                        total[:, at] += np.tanh(sign * margin)
                        weakest[:, at] = np.minimum(weakest[:, at], sign * margin)
            best = np.argmax(wins + total / (2 * n_names), 1)
            return best, 1 / (1 + np.exp(-STEEPNESS * np.minimum(weakest[np.arange(len(best)), best], 20)))

        have = np.flatnonzero(letters)
        first, sure = winners("", len(of_family), have)
        langs = np.full(len(sentences), None, object)
        confidence = np.zeros(len(sentences))
        for i, name in enumerate(of_family):
            members = np.array([at for at, f in enumerate(self.families) if f == name])
            among = have[first == i]
            best, sure_within = winners(name, len(members), among)
            langs[among] = np.array(self.langs, object)[members[best]]
            confidence[among] = sure[first == i] * sure_within
        return langs.tolist(), confidence


def fit(samples: list[tuple[str, str]]) -> Model:
    """The model of (language, sentence) pairs: the first MOST_SAMPLES sentences of each language, in order.

    Sentences without letters are no samples; a language with no others is a ValueError, as it
    would be missing without a word. Memory is that of the samples' n-grams and of
    one column of BUCKETS weights for each machine.
    """
    by_lang: dict[str, list[str]] = {}
    for lang, sentence in samples:
        of = by_lang.setdefault(lang, [])
        if len(of) < MOST_SAMPLES and len(fold([sentence])[0]) > 2:
            of.append(sentence)
    langs = sorted(by_lang)
    if bare := [x for x in langs if not by_lang[x]]:
        raise ValueError(f"no letters in the samples of {bare}")
    families = [family(x) for x in langs]
    rows = {lang: _features(by_lang[lang]) for lang in langs}
    names = sorted(set(families))

    def of(name: str) -> list:
        return [r for lang, f in zip(langs, families) if f == name for r in rows[lang]]

    tasks = [("", a, b, of(names[a]), of(names[b])) for a, b in combinations(range(len(names)), 2)]
    for name in names:
        members = [x for x, f in zip(langs, families) if f == name]
        tasks += [(name, a, b, rows[members[a]], rows[members[b]]) for a, b in combinations(range(len(members)), 2)]
    weights = np.zeros((BUCKETS + 1, len(tasks)), np.float32)
    bias = np.zeros(len(tasks))
    for j, (_, _, _, first, second) in enumerate(tasks):
        w = _machine(first + second, np.repeat([1.0, -1.0], [len(first), len(second)]))
        weights[:-1, j], bias[j] = w[:-1], w[-1]
    return Model(langs, families, [t[:3] for t in tasks], weights, bias)
