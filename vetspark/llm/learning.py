"""Bounded samples of labelled documents, and a small optimiser, for the classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out

#: Labelled documents of more characters or lines are scored, but not learnt from: part of the bound on what is learnt.
LEARN_CHARS, LEARN_LINES = 200_000, 2_000
#: Characters and lines that are learnt from in all: the sample ends before the document that would pass them.
SAMPLE_CHARS, SAMPLE_LINES = 40_000_000, 100_000


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.filter(F.length("text") <= LEARN_CHARS)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to ``rows`` labelled documents in hash order, without their texts: (h, id, t, y double, chars, lines), where ``t`` is a hash of the text.

    Only ids outside the held-out fifth come.  Labels other than 0 and 1, and
    nulls, are none; documents of more than ``LEARN_CHARS`` characters or ``LEARN_LINES`` lines aren't learnt from; of several labels of an id the largest counts.  Repeated
    documents come as often as they are there, within the bound.
    """
    own = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter("id is not null and y in (0, 1)")
    own = own.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(rows)
    chars = F.length("text")
    lines = chars - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    keys = _texts(docs, doc_id, text).join(F.broadcast(own), "id").select("h", "id", F.xxhash64("text").alias("t"), "y", chars.alias("chars"), lines.alias("lines"))
    return keys.filter(F.col("lines") <= LEARN_LINES).orderBy("h", "id", "t").limit(rows)


def measured_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, measure: Callable[[str], bytes], doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """What ``measure`` makes of the texts of :func:`labelled_sample`, on the executors: (y, h, m), ordered by h and m.

    The sample ends before the document with which it would have more than ``SAMPLE_CHARS`` characters or ``SAMPLE_LINES`` lines.  Documents are
    chosen by keys alone, at most ``rows`` on the driver; texts never move, and copies of a document are measured once in a task.
    """
    sample = labelled_sample(docs, labels, label, rows, doc_id, text)
    keys = sample.collect()
    chars, lines = (np.cumsum([r[c] for r in keys]) for c in ("chars", "lines"))
    taken = Counter(r[:4] for r in keys[: int(((chars <= SAMPLE_CHARS) & (lines <= SAMPLE_LINES)).sum())])
    schema = f"id {sample.schema['id'].dataType.simpleString()}, t long, k int"
    chosen = docs.sparkSession.createDataFrame([(i, t, k) for k, (_, i, t, _) in enumerate(taken)], schema)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            new = b[~b["k"].isin(seen)].drop_duplicates("k")
            seen.update(new["k"].tolist())
            yield pd.DataFrame({"k": new["k"], "m": [measure(t) for t in new["text"]]})

    texts = _texts(docs, doc_id, text).withColumn("t", F.xxhash64("text"))
    found = texts.join(F.broadcast(chosen), ["id", "t"]).select("k", "text").mapInPandas(of, "k int, m binary").groupBy("k").agg(F.first("m").alias("m")).collect()
    of_key = {r.k: bytes(r.m) for r in found}
    out = [(y, h, of_key[k]) for k, ((h, _, _, y), n) in enumerate(taken.items()) for _ in range(n)]
    return pd.DataFrame(out, columns=["y", "h", "m"]).astype({"y": float, "h": "int64"}).sort_values(["h", "m"], kind="stable")


def adam(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    """Minimise ``loss`` (value, gradient) by full-batch Adam."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        _, g = loss(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w
