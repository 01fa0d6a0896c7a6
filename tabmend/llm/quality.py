"""Quality: naive Bayes support vectors (NB-SVM).

A text's features say which n-grams it holds: single words, and runs of one to
four word shapes (case, closing punctuation, whether a word repeats the one
before). Each indicator is scaled by its class log-count ratio, rows are scaled to
length 1, and a linear hinge-loss model is fitted by dual coordinate descent on a
bounded sample of labelled documents (`bound`). A fifth of the sample is kept
apart to turn margins into probabilities.

Results in odd cases: null and empty texts have no n-gram and get the score of
the bias alone; repeated rows get equal scores; without labelled rows every score
is 0.5; a column named like the
score is replaced, other columns pass through unread.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from tabmend.llm.labelled import sample, scored

BITS, BOUND, REMEMBERED = 18, 8000, 400_000


def _shape(word: str) -> str:
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :][:3]
    if not core:
        kind = "p"
    elif core.isdigit():
        kind = "9"
    elif not any(c.isalpha() for c in core):
        kind = "s"
    elif len(core) > 1 and core.isupper():
        kind = "U"
    else:
        kind = "T" if core[:1].isupper() else "l"
    return kind + tail + ("L" if len(core) > 30 else "")


def ngram_features():
    """A function from a text to the sorted distinct ids of its n-grams."""
    known: dict[str, tuple[int, int]] = {}
    grams: dict[tuple, int] = {}
    mask = (1 << BITS) - 1

    def features(text: str) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        if len(grams) > REMEMBERED:
            grams.clear()
        words = text.split()
        shapes, found, last = [], set(), None
        for word in words:
            got = known.get(word)
            if got is None:
                code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
                got = known[word] = (code & mask, zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")))
            shapes.append(-got[1] - 1 if word == last else got[1])
            last = word
        found.update(known[word][0] for word in set(words))
        for n in (1, 2, 3, 4):
            for gram in set(zip(*(shapes[j:] for j in range(n)), strict=False)):
                at = grams.get(gram)
                if at is None:
                    at = grams[gram] = zlib.crc32(repr(gram).encode()) & mask
                found.add(at)
        out = np.fromiter(found, np.int32, len(found))
        out.sort()
        return out

    return features


class NaiveBayesSupportVectors:
    """The first id past the hash range is the bias."""

    def __init__(self, cost: float = 4.0, smoothing: float = 1.0, epochs: int = 20) -> None:
        self.cost, self.smoothing, self.epochs = cost, smoothing, epochs
        self.w, self.bias, self.slope, self.shift = np.zeros(1 << BITS), 0.0, 1.0, 0.0

    def fit(self, y: np.ndarray, rows: list[np.ndarray]) -> NaiveBayesSupportVectors:
        if not len(y):
            return self
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        apart = order[: len(y) // 5] if len(y) >= 50 else order
        self._machine(y, rows, order[len(y) // 5 :] if len(y) >= 50 else order, rng)
        self._probabilities(np.array([self.margin(rows[i]) for i in apart]), y[apart])
        return self

    def _machine(self, y: np.ndarray, rows: list[np.ndarray], use: np.ndarray, rng) -> None:
        counts = [np.full(1 << BITS, self.smoothing) for _ in range(2)]
        for i in use:
            counts[y[i]][rows[i]] += 1
        totals = [int((y[use] == c).sum()) + 2 * self.smoothing for c in (0, 1)]
        self.ratio = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
        self.ratio[counts[0] + counts[1] - 2 * self.smoothing < 3] = 0
        scaled = {i: self.row(rows[i]) for i in use}
        weight = [self.cost * len(use) / (2 * max(1, int((y[use] == c).sum()))) for c in (0, 1)]
        alpha = dict.fromkeys(use.tolist(), 0.0)
        self.w = np.zeros(1 << BITS)
        self.bias = 0.0
        for _ in range(self.epochs):
            most = 0.0
            for i in rng.permutation(use).tolist():
                ids, x = scaled[i]
                sign = 1.0 if y[i] else -1.0
                gradient = sign * (float(self.w[ids] @ x) + self.bias) - 1
                new = min(max(alpha[i] - gradient / (float(x @ x) + 1.0), 0.0), weight[y[i]])
                step = new - alpha[i]
                if step:
                    alpha[i] = new
                    self.w[ids] += step * sign * x
                    self.bias += step * sign
                    most = max(most, abs(step))
            if most < 1e-3:
                break

    def row(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.ratio[ids]
        return ids, x / max(float(np.sqrt(x @ x)), 1e-9)

    def margin(self, ids: np.ndarray) -> float:
        if not hasattr(self, "ratio"):
            return 0.0
        ids, x = self.row(ids)
        return float(self.w[ids] @ x) + self.bias

    def _probabilities(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Platt's sigmoid, by Newton steps on softened targets."""
        up, down = int(y.sum()), int(len(y) - y.sum())
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = p * (1 - p) + 1e-9
            m = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
            step = np.linalg.solve(m, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(float(a), 1e-3), float(b)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def quality_scores(df: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "score", bound: int = BOUND) -> DataFrame:
    """df with the probability that each text is good. docs, labels: labelled documents to learn from, of which at most `bound` are used."""
    y, rows = sample(docs, labels, "quality", ngram_features, bound, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(NaiveBayesSupportVectors().fit(y, rows))
    return scored(df, ngram_features, lambda: model.value.score, text_col, out)
