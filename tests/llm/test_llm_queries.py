"""The subpackage's queries against SQL or brute force on the small tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from tests.compare import DATA, both
from vetspark.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", list(q.SQL))
def test_same_as_sql(spark, name):
    mine, theirs = both(spark, q.QUERIES[name], q.SQL[name])
    assert mine == theirs


def test_thirteen_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == [*range(1, 14)]


@pytest.mark.parametrize(("name", "label"), [("op4_quality", "quality"), ("op6_toxicity", "toxic")])
def test_classifiers_on_held_out_rows(spark, name, label):
    data = "/root/testdata/sf0.01"
    found = q.QUERIES[name](spark, data).toPandas()
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    assert len(found) == 1000 and found.score.between(0, 1).all()
    both_ = found.merge(labels, on="doc_id")
    held = both_[both_.held_out]
    assert (held.predicted == held[label]).mean() >= 0.9
    assert set(found[found.held_out].doc_id) == {i for i in found.doc_id if __import__("zlib").crc32(str(i).encode()) % 5 == 0}


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    found = {r.doc_id: r for r in q.op7_bpe(spark, DATA).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_simhash_equals_brute_force(spark, docs):
    fp = {}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[i] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    up = {i: i for i in fp}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op8_simhash(spark, DATA).collect()}
    assert found == {i: (f"{fp[i]:016x}", top(i)) for i in ids}


def test_nearest_recall(spark):
    data = "/root/testdata/sf0.1"
    found = q.op10_ann(spark, data).toPandas()
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    hits = total = 0
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
        own = found[found.query_id == i].sort_values("rank")
        assert own["rank"].tolist() == [*range(1, 11)] and i not in set(own.vec_id)
        np.testing.assert_allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits, total = hits + len(set(own.vec_id) & set(ids[best])), total + 10
    assert hits / total >= 0.9


def test_chat_reads_back_control_strings(spark):
    row = q.op9_chat_formatting(spark, DATA).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars) == (2, len(said)) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
