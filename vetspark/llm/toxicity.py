"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import adam, measured_sample

#: Labelled documents learnt from, at most; terms that get weights; factors of each; bits of a term's hash.
SAMPLE, TERMS, FACTORS, HASH_BITS = 6_000, 768, 4, 24
#: Beginnings of words that count as terms of their own, by length: compounds share them.
BEGINNINGS = (4, 5, 6)
#: Words whose terms a worker keeps.
KEPT_WORDS = 300_000

_WORDS = re.compile(r"[^\W\d_]+")


def hashed(word: str) -> tuple[int, ...]:
    """Hashes of a word's terms: itself and its beginnings."""
    mask = (1 << HASH_BITS) - 1
    return tuple({xxhash.xxh32_intdigest(t) & mask for t in ("=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n))})


@dataclass
class Machine:
    """bias + x.w + sum over pairs <v_i, v_j> x_i x_j, for the terms that a text holds."""

    place: dict[int, int]  # hash of a term -> its weights
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # (terms, factors)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def terms(self, text: str) -> set[int]:
        words, known = set(_WORDS.findall(text.lower())), self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = tuple(self.place[h] for h in hashed(w) if h in self.place)
        return set(chain.from_iterable(map(known.__getitem__, words)))

    def score(self, text: str) -> float:
        at = list(self.terms(text))
        v = self.factor[at]
        z = self.bias + self.weight[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: list[np.ndarray], y: np.ndarray, steps: int = 150, l2: float = 2e-4, seed: int = 5) -> Machine:
    """Learn from documents given as hashes of their terms.

    The ``TERMS`` terms with the largest chi-square against the label get
    weights.  Both labels weigh the same in all.  If a label is missing, the machine gives its smoothed share.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    empty = Machine({}, float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    if len(set(y.tolist())) < 2:
        return empty
    terms, at, all_ = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    ones = np.bincount(at[np.repeat(y == 1, [len(d) for d in docs])], minlength=len(terms))
    del at
    n, p = len(y), y.sum()
    expected = all_ * (p / n)
    chi = np.where(all_ >= 3, (ones - expected) ** 2 / np.maximum(expected * (1 - p / n) * (1 - all_ / n), 1e-9), 0)
    best = np.lexsort((terms, -chi))[:TERMS]
    best = best[chi[best] > 0]
    place = {int(h): i for i, h in enumerate(terms[best])}
    x = np.zeros((n, len(best)))
    for i, d in enumerate(docs):
        x[i, [place[h] for h in d.tolist() if h in place]] = 1
    share = np.where(y == 1, 0.5 / p, 0.5 / (n - p))
    k = len(best)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        v = w[k + 1 :].reshape(k, FACTORS)
        sums = x @ v
        z = w[0] + x @ w[1 : k + 1] + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * share
        gx = x.T @ g
        gv = x.T @ (g[:, None] * sums) - gx[:, None] * v
        return 0.0, np.concatenate([[g.sum()], gx, gv.ravel()]) + l2 * w

    start = np.concatenate([np.zeros(k + 1), np.random.default_rng(seed).normal(0, 0.02, k * FACTORS)])
    w = adam(loss, start, steps)
    return Machine(place, float(w[0]), w[1 : k + 1], w[k + 1 :].reshape(k, FACTORS))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """Fit the machine on at most ``sample`` labelled documents outside the held-out fifth; their terms are hashed on the executors.

    Bounds of what is learnt, never of what is scored: ``sample`` documents, and those of :func:`measured_sample` on the characters and lines of a
    document and of all.
    """

    def terms(t: str) -> bytes:
        return np.array(sorted(set(chain.from_iterable(map(hashed, set(_WORDS.findall(t.lower())))))), np.int32).tobytes()

    rows = measured_sample(docs, labels, label, sample, terms, doc_id, text)
    return fit([np.frombuffer(t, np.int32) for t in rows["m"]], rows["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for every row: the whole text's toxicity, 1 from ``threshold`` on.

    Null texts score like empty ones, by the bias alone; repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array((shared.value.score(t.as_py()) for t in b.column(1)), pa.float64(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
