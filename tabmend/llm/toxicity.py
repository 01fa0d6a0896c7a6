"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four and five
letters, hashed to 2^18 ids. The machine adds a weight for each term and, for
each pair of terms, the product of their factors, so it learns what only two
terms together say. It is fitted by AdaGrad on a bounded sample of labelled
documents (`bound`). Terms in fewer than MIN_DOCS of them, or whose share among
toxic texts differs from the rest by under MIN_Z standard errors, carry nothing.

Results in odd cases: null and empty texts get the score of a text without terms;
repeated rows get equal scores; without labelled rows every score is 0; labels of
one class give scores near that class; a column named like the
score is replaced, other columns pass through unread.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmend.llm.labelled import sample, scored

BITS, FACTORS, MIN_DOCS, MIN_Z = 18, 4, 3, 2.5
BOUND = 8000
#: Words whose ids a task remembers.
REMEMBERED = 400_000


def term_features():
    """A function from a text to the sorted distinct ids of its terms."""
    words, known, mask = re.compile(r"\w+"), {}, (1 << BITS) - 1

    def ids_of(word: str) -> tuple[int, ...]:
        own = {zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask}
        own |= {zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "surrogatepass")) & mask for n in (4, 5) if len(word) >= n}
        return tuple(own)

    def features(text: str) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        found: set[int] = set()
        for word in set(words.findall(text.lower())):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = ids_of(word)
            found.update(ids)
        out = np.fromiter(found, np.int32, len(found))
        out.sort()
        return out

    return features


class FactorizationMachine:
    """Logistic loss, AdaGrad in small batches; a fixed seed makes fits repeatable."""

    def __init__(self, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, batch: int = 64) -> None:
        self.epochs, self.rate, self.l2, self.batch = epochs, rate, l2, batch
        self.bias, self.w, self.v = -20.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)

    def fit(self, y: np.ndarray, rows: list[np.ndarray]) -> FactorizationMachine:
        if not len(y):
            return self
        seen = self._telling(y, rows)
        rng = np.random.default_rng(7)
        self.v = (rng.normal(0, 0.01, self.v.shape) * seen[:, None]).astype(np.float32)
        rows = [r[seen[r]] for r in rows]
        share = np.clip(y.mean(), 1 / (len(y) + 1), len(y) / (len(y) + 1))
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(self.w.shape, 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), self.batch):
                take = order[at : at + self.batch]
                ids = np.concatenate([rows[i] for i in take])
                owner = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
                own, place = np.unique(ids, return_inverse=True)
                vi = self.v[ids]
                sums = np.stack([np.bincount(owner, vi[:, f], len(take)) for f in range(FACTORS)], 1)
                squares = np.bincount(owner, (vi * vi).sum(1), len(take))
                z = self.bias + np.bincount(owner, self.w[ids], len(take)) + 0.5 * ((sums * sums).sum(1) - squares)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]
                each = g[owner]
                dw = np.bincount(place, each, len(own)) / len(take) + self.l2 * self.w[own]
                dv = np.stack([np.bincount(place, each * (sums[owner, f] - vi[:, f]), len(own)) for f in range(FACTORS)], 1) / len(take) + self.l2 * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= self.rate * dw / np.sqrt(gw[own])
                self.v[own] -= self.rate * 0.5 * dv / np.sqrt(gv[own])
                gb += g.mean() ** 2
                self.bias -= self.rate * g.mean() / np.sqrt(gb)
        self.w[~seen] = 0
        return self

    @staticmethod
    def _telling(y: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        count = np.bincount(np.concatenate(rows), minlength=1 << BITS)
        toxic = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y)] or [np.empty(0, np.int32)]), minlength=1 << BITS)
        up, n = max(1, int(y.sum())), len(y)
        down = max(1, n - up)
        share = (count + 0.5) / (n + 1)
        z = (toxic / up - (count - toxic) / down) / np.sqrt(share * (1 - np.minimum(share, 0.999)) * (1 / up + 1 / down))
        return (count >= MIN_DOCS) & (np.abs(z) >= MIN_Z)

    def score(self, ids: np.ndarray) -> float:
        v = self.v[ids]
        sums = v.sum(0)
        z = self.bias + float(self.w[ids].sum()) + 0.5 * float((sums * sums).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_scores(df: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "score", bound: int = BOUND) -> DataFrame:
    """df with the probability that each text is toxic. docs, labels: labelled documents to learn from, of which at most `bound` are used."""
    y, rows = sample(docs, labels, "toxic", term_features, bound, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(FactorizationMachine().fit(y, rows))
    return scored(df, term_features, lambda: model.value.score, text_col, out)


def decided(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.withColumn("predicted", F.when(F.col(score) >= threshold, 1).otherwise(0))
