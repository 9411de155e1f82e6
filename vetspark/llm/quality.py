"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import adam, measured_sample

#: Labelled documents learnt from, at most, and lines that a learnt chain may have: longer documents are learnt in pieces.
SAMPLE, CHAIN_LINES = 4_000, 100
#: Bins of each measure of a line; rows, and characters of text, that a worker measures at a time.
BINS, ROWS, AT_A_TIME = 11, 1_000, 1_000_000

_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 mark, 0 other
for _b in range(256):
    _c = chr(_b) if _b < 128 else ""
    _CLASS[_b] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isprintable() and _c.strip() else 0


def measure(lines: list[str]) -> np.ndarray:
    """Eight measures of every line, (lines, 8)."""
    raw = [x.encode() for x in lines]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum(sizes)
    count = []
    for k in (1, 2, 3, 4):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        count.append(total[ends] - total[ends - sizes])
    upper, lower, digit, mark = count
    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    again = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(words))
    some, size = np.maximum(n, 1), np.maximum(sizes, 1)
    return np.stack([np.log1p(n), sizes / some, upper / np.maximum(upper + lower, 1), mark / size, digit / size, distinct / some, again / some, mark / some], axis=1)


@dataclass
class Crf:
    """Two labels, bad (0) and good (1); ``good`` weighs a line's features for good, ``step[a, b]`` label a before b."""

    edges: np.ndarray  # (measures, BINS - 1)
    good: np.ndarray
    step: np.ndarray  # (2, 2)

    def features(self, m: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """One-hot bins of a line's measures and of its neighbours' in the same document, and a constant."""
        return _features(self.edges, m, first, last)

    def marginals(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(good) of every line, chains side by side."""
        return _forward_backward(x @ self.good, self.step, starts, sizes)[0]


def _features(edges: np.ndarray, m: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    bins = np.stack([np.searchsorted(e, m[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    hot = np.zeros((len(m), edges.shape[0], BINS), np.float32)
    np.put_along_axis(hot, bins[:, :, None], 1, axis=2)
    hot = hot.reshape(len(m), -1)
    before, after = np.roll(hot, 1, axis=0), np.roll(hot, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([hot, before, after, np.ones((len(m), 1), np.float32)], axis=1)


def _forward_backward(score: np.ndarray, step: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected steps (2, 2) and log Z of chains at ``starts``; at position t, all chains longer than t move at once."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    longest, z = int(sizes.max(initial=0)), 0.0
    going = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # chains with more than t lines
    emit = np.stack([np.zeros_like(score), score], axis=1)
    expected = np.zeros((2, 2))
    for t in range(longest):
        at = starts[: going[t]] + t
        alpha[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(alpha[at - 1, 0, None] + step[0], alpha[at - 1, 1, None] + step[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: going[t + 1]] + t
        ahead = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
    ends = starts + sizes - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1]) if len(ends) else np.zeros(0)
    z = float(log_z.sum())
    of = np.empty(len(score))
    of[:] = np.repeat(log_z[np.argsort(order)], sizes[np.argsort(order)]) if len(score) else 0
    for t in range(longest - 1):
        at = starts[: going[t + 1]] + t
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] += np.exp(alpha[at, a] + step[a, b] + emit[at + 1, b] + beta[at + 1, b] - of[at]).sum()
    return np.exp(alpha[:, 1] + beta[:, 1] - of), expected, z


def _edges(m: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Where the bins of each measure end: three quartiles of the good lines', three of the bad, and four even steps over its range."""
    quartiles = [np.quantile(m[label == k], (0.25, 0.5, 0.75), axis=0) for k in (0, 1)]
    even = np.linspace(m.min(axis=0), m.max(axis=0), BINS - 5)[1:-1]
    return np.sort(np.concatenate([*quartiles, even]), axis=0).T


def fit(measures: list[np.ndarray], y: np.ndarray, steps: int = 120, l2: float = 1e-3) -> Crf | float:
    """Learn from documents' lines, each labelled as its document; a constant score if a label is missing."""
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    pieces = [(m[a : a + CHAIN_LINES], label) for m, label in zip(measures, y, strict=True) for a in range(0, len(m), CHAIN_LINES)]
    m = np.concatenate([p for p, _ in pieces])
    sizes = np.array([len(p) for p, _ in pieces])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    label = np.repeat([v for _, v in pieces], sizes)
    edges = _edges(m, label)
    x = _features(edges, m, starts, starts + sizes - 1).astype(np.float64)
    pairs = np.diag([float((sizes[[v == k for _, v in pieces]] - 1).sum()) for k in (0, 1)])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        step = w[-4:].reshape(2, 2)
        score = x @ w[:-4]
        p, expected, z = _forward_backward(score, step, starts, sizes)
        grad = np.concatenate([x.T @ (p - label), (expected - pairs).ravel()]) / len(sizes) + 2 * l2 * w
        return (z - score @ label - (pairs * step).sum()) / len(sizes) + l2 * w @ w, grad

    w = adam(loss, np.zeros(x.shape[1] + 4), steps)
    return Crf(edges, w[:-4], w[-4:].reshape(2, 2))


def score_texts(model: Crf | float, texts: list[str]) -> np.ndarray:
    """Mean P(good) of each text's lines, weighed by their characters (an empty line by 1)."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    lines = [t.split("\n") for t in texts]
    sizes = np.array([len(x) for x in lines], np.int64)
    flat = [x for own in lines for x in own]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    p = model.marginals(model.features(measure(flat), starts, starts + sizes - 1), starts, sizes)
    weight = np.maximum(np.fromiter(map(len, flat), np.int64, len(flat)), 1)
    return np.clip(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def in_parts(texts: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together, one at least."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Crf | float:
    """Fit the field on at most ``sample`` labelled documents outside the held-out fifth; their lines are measured on the executors.

    Bounds of what is learnt, never of what is scored: ``sample`` documents, in chains of ``CHAIN_LINES`` lines, and those of :func:`measured_sample` on
    the characters and lines of a document and of all.
    """
    rows = measured_sample(docs, labels, label, sample, lambda t: measure(t.split("\n")).astype(np.float32).tobytes(), doc_id, text)
    return fit([np.frombuffer(m, np.float32).reshape(-1, 8).astype(np.float64) for m in rows["m"]], rows["y"].to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], at: int, shared) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time with the scores of their texts in column ``at``."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            b = whole.slice(k, ROWS)
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b, np.concatenate([score_texts(shared.value, part) for part in in_parts(texts, AT_A_TIME)])


def score_quality(docs: DataFrame, model: Crf | float, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row: the whole text's quality, 1 from ``threshold`` on.

    Null texts score like empty ones, which are one empty line; repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, scores in _scored(batches, 1, shared):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Crf | float, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, scores in _scored(batches, at, shared):
            yield b.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(of, docs.schema)
