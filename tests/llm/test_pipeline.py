"""The pipeline's stages on the small tables."""

import pytest

import corpus_pipeline as pipeline
from tests.compare import DATA
from vetspark.llm.common import materialise


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA)))
    return out


def test_columns_and_order(outputs):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "encoding"]
    assert all(df.columns == outputs[0].columns for df in outputs[:-1])


def test_decisions_take_effect(spark, outputs):
    raw, good, lines, distinct, mix, encoded = (df.toPandas() for df in outputs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    clean = set(labels[(labels.quality == 1)].doc_id)
    assert len(clean & set(good.doc_id)) >= 0.95 * len(clean) and len(good) < len(raw)
    assert set(lines.doc_id) == set(good.doc_id)
    assert lines.text.str.len().sum() < good.text.str.len().sum() and (lines.n_chars == lines.text.str.len()).all()
    assert distinct.doc_id.is_unique and distinct.text.is_unique and (distinct.text == "").sum() <= 1
    assert set(mix.doc_id) <= set(distinct.doc_id) and mix.groupby("doc_id").size().max() <= 2
    words = distinct.text.str.split().str.len()
    assert mix.text.str.split().str.len().sum() == pytest.approx(1.5 * words.sum(), abs=40)
    assert len(encoded) == len(mix) and (encoded.n_tokens == encoded.ids.str.len()).all()


def test_run_equals_the_stages(spark, outputs):
    import hashlib

    want = sorted((r.doc_id, r.n_tokens, hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in outputs[-1].collect())
    assert sorted(tuple(r) for r in pipeline.run(spark, DATA).collect()) == want


def components_at(texts, similarity=0.8, words=5):
    """Smallest row of every row's group: all pairs of word-shingle sets compared."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(sets)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) / len(a | b) >= similarity:
                i, j_ = sorted((top(i), top(j)))
                root[j_] = i
    return [top(i) for i in range(len(texts))]


def test_near_dedup_equals_brute_force(outputs):
    docs = outputs[2].toPandas().sort_values("doc_id").reset_index(drop=True)
    first = components_at(docs.text)
    assert sorted(outputs[3].toPandas().doc_id) == sorted(docs.doc_id[sorted(set(first))])


def test_near_dedup_links_copies_with_edited_words(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = [(0, ""), (1, " \n"), (2, "too short"), (3, "TOO  short")]
    for size in (45, 60, 150, 400):
        for _ in range(5):
            base = [word() for _ in range(size)]
            rows.append((len(rows), " ".join(base)))
            for edits in (1, 1, 2, size // 40, size // 25):
                copy = list(base)
                for i in rng.sample(range(size), edits):
                    copy[i] = word()
                rows.append((len(rows), " ".join(copy)))
    first = components_at([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in pipeline.without_near_duplicates(spark, docs, DATA).collect())
    assert kept == sorted(set(first)) and 24 < len(kept) < 100
