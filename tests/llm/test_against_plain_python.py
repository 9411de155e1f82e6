"""Scores and stages against versions in plain Python, without numpy or Spark."""

import bisect
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.compare import DATA
from vetspark.llm import ann, linededup, mixing, quality, queries, simhash, toxicity
from vetspark.llm.common import hidden, materialise, shared_dir, skew_join

DOCS = "doc_id long, text string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------------ quality


def plain_measures(line):
    size, words = max(len(line.encode()), 1), line.split()
    n = max(len(words), 1)
    ascii_ = [c for c in line if ord(c) < 128]
    upper, lower, digit = (sum(f(c) for c in ascii_) for f in (str.isupper, str.islower, str.isdigit))
    mark = sum(c.isprintable() and not c.isspace() and not c.isalnum() for c in ascii_)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(len(words)), len(line.encode()) / n, upper / max(upper + lower, 1), mark / size, digit / size, len(set(words)) / n, again / n, mark / n]


def plain_quality(model, text):
    """Mean chance of good over a text's lines: all labellings' weights by forward and backward sums."""
    lines = (text or "").split("\n")
    edges, good, step = model.edges.tolist(), model.good.tolist(), model.step.tolist()
    bins = [[bisect.bisect_right(e, x) for e, x in zip(edges, plain_measures(line), strict=True)] for line in lines]
    block = len(edges) * quality.BINS

    def line_score(i):
        s = good[-1]
        for at, j in ((0, i), (1, i - 1), (2, i + 1)):
            if 0 <= j < len(lines):
                s += sum(good[at * block + k * quality.BINS + b] for k, b in enumerate(bins[j]))
        return s

    emit = [(0.0, line_score(i)) for i in range(len(lines))]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward = [emit[0]]
    for e in emit[1:]:
        last = forward[-1]
        forward.append(tuple(e[y] + add(last[0] + step[0][y], last[1] + step[1][y]) for y in (0, 1)))
    backward = [(0.0, 0.0)]
    for e in reversed(emit[1:]):
        ahead = backward[0]
        backward.insert(0, tuple(add(step[y][0] + e[0] + ahead[0], step[y][1] + e[1] + ahead[1]) for y in (0, 1)))
    z = add(*forward[-1])
    weight = [max(len(line), 1) for line in lines]
    return sum(w * math.exp(f[1] + b[1] - z) for w, f, b in zip(weight, forward, backward, strict=True)) / sum(weight)


TEXTS = [
    None, "", "\n\n", "One line of text, good enough.", "BUY NOW!! BUY NOW!!\nBUY NOW!! 99 99", "größe ÄÖÜ straße\n12 34 56\n\na a a a b", " \t\x1c x", "l\n" * 150, " ".join(f"w{i}" for i in range(3000)),
]


def test_quality_equals_plain_python(spark):
    rng = random.Random(1)
    words = ["alpha", "beta.", "GAMMA", "d4", "e!", "of", "the"]
    texts = ["\n".join(" ".join(rng.choice(words[: 3 + 2 * (k % 3)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for k in range(90)]
    docs = frame(spark, texts + TEXTS)
    model = quality.learn(docs, spark.createDataFrame([(i, i % 3 % 2) for i in range(90)], "doc_id long, quality int"))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(docs, model).collect()}
    for i, t in enumerate(texts + TEXTS):
        assert got[i][0] == pytest.approx(plain_quality(model, t), abs=1e-6) and got[i][1] == (got[i][0] >= 0.3)


# ------------------------------------------------------------------ toxicity


def plain_toxicity(model, text):
    """The bias, the weight of every term, and the product of the factors of every two."""
    words = {w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()}
    at = sorted({model.place[h] for w in words for h in toxicity.hashed(w) if h in model.place})
    z = model.bias + sum(float(model.weight[i]) for i in at)
    for x, i in enumerate(at):
        for j in at[x + 1 :]:
            z += sum(float(a) * float(b) for a, b in zip(model.factor[i], model.factor[j], strict=True))
    return 1 / (1 + math.exp(-z))


def test_toxicity_equals_a_double_loop(spark):
    rng = random.Random(2)
    words = [f"{a}{b}word" for a in "abcde" for b in "vwxyz"] + ["insult", "folk"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(300)]
    docs = frame(spark, texts + TEXTS)
    model = toxicity.learn(docs, spark.createDataFrame([(i, int("insult" in t and "folk" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int"))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()}
    assert model.factor.any()
    for i, t in enumerate(texts + TEXTS):
        assert got[i][0] == pytest.approx(plain_toxicity(model, t), abs=1e-9) and got[i][1] == (got[i][0] >= 0.5)


# ------------------------------------------------------------------ pipeline


def test_stages_equal_brute_force(spark):
    """quality, line dedup, mixing and encoding; near_dedup is compared in test_pipeline."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA)))
    raw, good, lines, distinct, mix, ids = (df.toPandas() for df in out)

    model = quality.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {i: plain_quality(model, t) for i, t in zip(raw.doc_id, raw.text, strict=True)}
    assert all(abs(s - 0.3) > 1e-6 for s in scores.values()) and set(good.doc_id) == {i for i, s in scores.items() if s >= 0.3}

    def run(sql, documents):
        with duckdb.connect() as db:
            db.register("documents", documents)
            return db.sql(sql).fetchall()

    want = {i: sha for i, _, sha in run(queries.SQL["op1_line_dedup"], good)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(lines.doc_id, lines.text, strict=True)} == want

    taken = {r[0]: r[-1] for r in run(queries.SQL["op5_mixing"], distinct)}
    want = []
    for i, t in zip(distinct.doc_id, distinct.text, strict=True):
        words = t.split()
        whole, rest = divmod(taken[i], len(words)) if words else (0, 0)
        want += [(i, t)] * whole + ([(i, " ".join(words[:rest]))] if rest else [])
    assert sorted(zip(mix.doc_id, mix.text, strict=True)) == sorted(want)

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encoded = sorted((i, tok.encode(t, add_special_tokens=False).ids) for i, t in want)
    assert sorted((i, list(x)) for i, x in zip(ids.doc_id, ids.ids, strict=True)) == encoded


# ------------------------------------------------------------------ names and folders


CLASHES = ["__id", "__hash", "__runs", "__h", "__n", "__k", "__copy", "__cut", "__part", "__here", "__source", "__cut_here", "key", "place", "size"]


def test_inputs_may_have_any_column_names(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    df = frame(spark, [long, "own words\n" + long, long + " y", None, "", "a b c"])
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(100 + i))
    for out in (linededup.drop_repeated_lines(df), simhash.keep_one(df), mixing.take_mix(df)):
        rows = out.collect()
        assert out.columns == df.columns and rows and all(r[c] == 100 + i for r in rows for i, c in enumerate(CLASHES))
    assert hidden("k", df) == "__k_" and skew_join(df, df.select("doc_id", F.lit(1).alias("one")), ["doc_id"]).columns == [*df.columns, "one"]
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 7, 7, 7) for i in range(30)], "vec_id long, embedding array<double>, tree int, row int, query int")
    assert ann.nearest(vectors, F.col("vec_id") % 10 == 0).count() == 30


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    def session(master, folder=None, had=None):
        context = Fake(master=master, getCheckpointDir=lambda: had, setCheckpointDir=lambda d: None)
        return Fake(conf=Fake(get=lambda k, d: folder), sparkContext=context)

    for master in ("local-cluster[3,2,1000]", "yarn", "spark://a:7077", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs:/x")) == "hdfs:/x" and shared_dir(session(master, None, "hdfs:/y")) == "hdfs:/y"


def test_fingerprints_carry_line_dedup(spark, monkeypatch):
    """Selected lines are fewer than lines, each window selects one, and without them nothing is found."""
    rng = random.Random(9)
    pool = [" ".join(f"p{i}q{j}" for j in range(8)) for i in range(60)]
    texts = ["\n".join(rng.choice(pool) for _ in range(40)) for _ in range(30)] + ["\n".join(pool)] * 2
    docs = frame(spark, texts)
    selected = linededup.fingerprints(docs)
    assert selected.count() < 0.6 * linededup._lines(docs, "doc_id", "text").count()
    assert linededup.repeated_runs(docs).count() > 0
    monkeypatch.setattr(linededup, "fingerprints", lambda *a: selected.filter("doc_id % 2 = 0"))
    assert all(r.doc_id % 2 == 0 for r in linededup.repeated_runs(docs).collect())


# ------------------------------------------------------------------ repeated rows


def test_repeated_rows_are_taken_together(spark):
    rows = [(7, "one two three", "s", 13)] * 40 + [(i, "a b c d", "s", 7) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, DOCS)
    decided = mixing.mix_sources(docs).toPandas()
    assert len(decided) == 70 and abs(decided.taken.sum() - decided.target.iloc[0]) <= 0.5  # the decision itself is exact
    copies = {r["count"] for r in mixing.take_mix(docs).filter("doc_id = 7").groupBy("text").count().collect()}
    assert copies <= {40, 80}  # texts: whole groups only


def test_repeated_ids_are_documents_of_their_own(spark):
    from vetspark.llm import search

    docs = frame(spark, ["x y z", "x y", "p q"]).unionByName(spark.createDataFrame([(1, "x y z w", "s", 7), (1, "x y", "s", 3)], DOCS))
    asked = spark.createDataFrame([(9, "x y")], "query_id long, text string")
    found = search.bm25_topk(docs, asked, k=10).orderBy("rank").collect()
    assert [r.doc_id for r in found].count(1) == 3 and {r.doc_id for r in found} == {0, 1} and [r["rank"] for r in found] == [1, 2, 3, 4]
