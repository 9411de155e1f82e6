"""Each operator on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetspark.llm import ann, bpe, chat, graph, linededup, lm, mixing, quality, search, simhash, toxicity

DOCS = "doc_id long, text string, source string, n_chars long, key long, size string, h int, score double, __k int"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))


def frame(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    return spark.createDataFrame([(i, t, s, len(t) if t is not None else None, 1, "x", 2, 0.5, 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, a long text, repeated rows."""
    a = "\n".join(f"line {i} " + " ".join(f"t{i}x{j}" for j in range(20)) for i in range(6))
    rows = [(1, a, "s1"), (1, a, "s1"), (2, None, "s1"), (3, "", None), (None, "alone here", None), (None, a, "s2"), (4, LONG, "s2"), (5, " \n\t ", "s2"), (6, "extra\n" + a + "\n\nlast", "s3"), (1, "other text", "s3")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# ------------------------------------------------------------------ line dedup


def brute_lines(texts, least=50):
    """Lines that stay, by trying all runs."""
    lines = [[(p, x.strip(" \t\x0b\x0c\r")) for p, x in enumerate(t.split("\n"))] for t in texts]
    lines = [[(p, x) for p, x in own if x] for own in lines]
    gone = [set() for _ in texts]
    seen: dict[tuple, tuple] = {}
    spans = []
    for d, own in enumerate(lines):
        for i in range(len(own)):
            for j in range(i, len(own)):
                if sum(len(x.split()) for _, x in own[i : j + 1]) >= least:
                    run = tuple(x for _, x in own[i : j + 1])
                    spans.append((run, d, own[i][0], own[j][0]))
                    seen[run] = min(seen.get(run, (d, own[i][0], own[j][0])), (d, own[i][0], own[j][0]))
    for run, d, a, b in spans:
        first = seen[run]
        if (d, a) != first[:2] and not (d == first[0] and a <= first[2]):
            gone[d] |= {*range(a, b + 1)}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"p{i}q{j}" for j in range(rng.choice((1, 5, 20, 30, 60)))) for i in range(12)]
    texts = ["\n".join(rng.choice([*pool, "", "  "]) if rng.random() < 0.8 else f"own {d} {k}" for k in range(rng.randint(0, 14))) for d in range(40)]
    out = linededup.drop_repeated_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    worded = lambda texts: [[x for x in t.split("\n") if x.strip()] for t in texts]  # noqa: E731  lines without words go with the window around them
    assert worded(r.text for r in out.orderBy("doc_id").collect()) == worded(brute_lines(texts))


def test_line_dedup_odd_rows(odd, none):
    out = linededup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and linededup.drop_repeated_lines(none).count() == 0
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert rows[2, "s1"].text is None and rows[6, "s3"].text == "extra\n\nlast" and rows[6, "s3"].n_chars == 11
    assert rows[4, "s2"].text == LONG and rows[None, "s2"].text == ""
    kept = lambda df: {x for r in df.filter("text is not null").collect() for x in r.text.split("\n")}
    assert kept(out) | {""} == kept(odd) | {""}  # every line stays somewhere


# ------------------------------------------------------------------ search


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(30_000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(700)]
    texts[10] = texts[11] = texts[12]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    asked = docs.filter("doc_id % 50 = 0 or doc_id = 10").select(F.col("doc_id").alias("query_id"), "text")
    found = {}
    for r in search.bm25_topk(docs, asked, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    bags = [Counter(t.lower().split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    n, average = len(texts), sum(map(Counter.total, bags)) / len(texts)
    for i in (*range(0, 700, 50), 10):
        scores = []
        for j, b in enumerate(bags):
            if j != i and (shared := bags[i].keys() & b.keys()):
                s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / average)) for w in shared)
                scores.append((-round(s, 9), j))
        best = [(j, -s) for s, j in sorted(scores)[:5]]
        assert [j for j, _ in found.get(i, [])] == [j for j, _ in best]
        np.testing.assert_allclose([s for _, s in found.get(i, [])], [s for _, s in best], atol=1e-7)


def test_blocks_are_skipped_and_shards_agree(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    speak = lambda lang, n: " ".join(f"{lang}{min(300, int(rng.paretovariate(0.5)))}" for _ in range(n))
    texts = [speak("ab"[i % 2], rng.randint(0, 40)) for i in range(4000)]
    texts[9:21:2] = [texts[7]] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    terms = np.unique(np.concatenate([search.terms_of(t) for t in texts]))
    own = np.searchsorted(terms, np.unique(search.terms_of(texts[7])))
    q = search.Queries(np.array([7]), np.array([0, len(own)]), own, terms, np.ones(len(terms)))
    found = []
    for tokens in (10**9, 9_000):
        monkeypatch.setattr(search, "SHARD_TOKENS", tokens)
        rows = [r for b in search._build(iter([batch])) for r in b.to_pylist()]
        assert (len(rows) > 5) == (tokens == 9_000)
        best, ids, scored = np.full((1, 5), -np.inf), np.zeros((1, 5), np.int64), 0
        for r in rows:
            for part in search._parts(r, q, 20.0):
                scored += part.search(own, np.zeros(len(own), np.int64), q.ids, best, ids)
        found.append((best.tolist(), ids.tolist()))
        assert tokens == 9_000 or scored < len(texts) * 0.8
    assert found[0] == found[1] and found[0][1] == [[9, 11, 13, 15, 17]]


def test_rare_words_do_not_keep_blocks_open():
    """What a query's rare words add to a block is worked out, not bounded by what they add anywhere in the part: two languages share them here."""
    import pyarrow as pa

    rng = random.Random(9)
    often = lambda lang: f"{lang}{min(400, int(rng.paretovariate(0.4)))}"
    texts = [" ".join([often("ab"[i % 2]) for _ in range(30)] + [f"r{rng.randint(0, 3000)}" for _ in range(10)]) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    bags = [Counter(t.split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log1p((4000 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    hashes = {w: int(search.terms_of(w)[0]) for w in df}
    asked = [sorted((hashes[w], idf[w]) for w in bags[i]) for i in range(0, 4000, 100)]
    q = search._queries(pa.table({"query_id": pa.array(range(0, 4000, 100), pa.int64()), "term": [[t for t, _ in x] for x in asked], "idf": [[w for _, w in x] for x in asked]}))
    best, ids = np.full((40, 5), -np.inf), np.zeros((40, 5), np.int64)
    shards = [r for b in search._build(iter([batch])) for r in b.to_pylist()]
    query = np.repeat(np.arange(40), np.diff(q.start))
    for r in shards:
        for part in search._parts(r, q, 40.0):
            part.search(q.at, query, q.ids, best, ids)
    for at in range(0, 40, 4):
        i = int(q.ids[at])
        scores = sorted((-round(sum(idf[w] * b[w] * 2.2 / (b[w] + 1.2) for w in bags[i].keys() & b.keys()), 9), j) for j, b in enumerate(bags) if j != i)[:5]
        assert ids[at].tolist() == [j for _, j in scores]
        np.testing.assert_allclose(best[at], [-s for s, _ in scores], atol=1e-8)
    scored = sum(part.search(q.at, query, q.ids, best.copy(), ids.copy()) for r in shards for part in search._parts(r, q, 40.0))
    assert scored < 0.7 * 40 * 4000


def test_words_are_cut_at_ascii_white_space_only():
    import pyarrow as pa

    texts = ["", " ", "a", " A b\tB\x0bc\x0cd\re \n", "\x1cx\x85y\u00a0z \u2003w", "İI Ää\x00q  q", "\n\n", "end "]
    sizes, at, hashes = search._words(pa.array(texts))
    cut = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [*map(len, cut)]
    assert hashes[at].tolist() == [h for t in texts for h in search.terms_of(t).tolist()]


def test_query_blocks_and_parts_agree(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i, " ".join(f"w{min(90, int(rng.paretovariate(0.6)))}" for _ in range(rng.randint(0, 30))), "s") for i in range(300)])
    asked = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    whole = sorted(map(tuple, search.bm25_topk(docs, asked, k=4).collect()))
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(search, "TOGETHER", 3)
    assert sorted(map(tuple, search.bm25_topk(docs, asked, k=4).collect())) == whole and len(whole) > 100


def test_search_odd_rows(odd, none):
    queries = odd.select(F.col("doc_id").alias("query_id"), "text")
    out = search.bm25_topk(odd, queries, k=3).collect()
    assert {r.query_id for r in out} <= {1, 6, 4} and all(r.doc_id != r.query_id for r in out)
    assert search.bm25_topk(none, queries).count() == 0 and search.bm25_topk(odd, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


# ------------------------------------------------------------------ language model


def brute_lm(texts, order, alpha=0.4):
    grams, where, followed = Counter(), {}, Counter()
    for d, t in enumerate(texts):
        seq = [None, *t.split()]
        for m in range(1, order + 1):
            for i in range(m - 1, len(seq)):
                g = tuple(seq[i - m + 1 : i + 1])
                grams[g] += 1
                where.setdefault(g, set()).add(d)
                followed[g] += i < len(seq) - 1
    n = sum(len(t.split()) for t in texts)

    def score(g):
        if len(g) == 1:
            return grams[g] / n
        return grams[g] / followed[g[:-1]] if len(where[g]) > 1 else alpha * score(g[1:])

    out = []
    for t in texts:
        seq = (None, *t.split())
        out.append(sum(math.log(score(seq[max(0, i - order + 1) : i + 1])) for i in range(1, len(seq))))
    return out


@pytest.mark.parametrize(("order", "segment"), [(1, 200), (2, 200), (3, 200), (4, 200), (1, 17), (2, 17), (3, 17), (4, 5)])
def test_lm_equals_brute_force(spark, monkeypatch, order, segment):
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    rng = random.Random(7)
    texts = [" ".join(f"w{min(40, int(rng.paretovariate(0.6)))}" for _ in range(rng.randint(0, 30))) for _ in range(120)]
    # long texts, in pieces: words and runs that only they hold, at places far apart
    texts[50] = " ".join([*("own a b own".split() * 20), *texts[3].split(), *("own a b c".split() * 15)])
    texts[90] = " ".join(f"w{k % 7} x{k % 3}" for k in range(90))
    texts[91] = texts[90]
    out = {r.doc_id: r for r in lm.score_documents(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), order=order, segment_tokens=segment).collect()}
    assert len(out) == len(texts)
    for i, s in enumerate(brute_lm(texts, order)):
        assert out[i].n_words == len(texts[i].split()) and out[i].log_score == pytest.approx(s, abs=1e-9), i


def test_lm_rows_in_another_order_are_no_wrong_scores(spark):
    texts = [f"a{i % 9} b{i % 4} c{i} d" for i in range(60)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])

    def mixed(batches):
        for b in batches:
            order = list(range(b.num_rows))
            random.SystemRandom().shuffle(order)
            yield b.take(order)

    spark.conf.set("spark.sql.exchange.reuse", "false")  # as if segments were made again between counting and scoring
    try:
        with pytest.raises(Exception, match="write them first"):
            lm.score_documents(docs.coalesce(1).mapInArrow(mixed, docs.schema), segment_tokens=40).collect()
        out = lm.score_documents(docs.repartition(3, F.rand()).mapInArrow(mixed, docs.schema), segment_tokens=40)
        got = {r.doc_id: r.log_score for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert [got[i] for i in range(60)] == pytest.approx(brute_lm(texts, 2), abs=1e-9)


def test_lm_shuffles_the_documents_once(spark):
    out = lm.score_documents(frame(spark, [(1, "a b", "s"), (2, "a b c", "s")]))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2  # the segments, and their n-grams


def test_lm_odd_rows(odd, none):
    out = lm.score_documents(odd).collect()
    assert len(out) == odd.count() and lm.score_documents(none).count() == 0
    empty = [r for r in out if r.n_words == 0]
    assert len(empty) == 3 and all(r.log_score == 0 and r.mean_log_score is None for r in empty)
    twice = [r.log_score for r in out if r.doc_id == 1 and r.n_words > 2]
    assert len(twice) == 2 and twice[0] == twice[1] < 0


# ------------------------------------------------------------------ classifiers


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    score, step = rng.normal(size=8), rng.normal(size=(2, 2))
    p, expected, z = quality._forward_backward(score, step, np.array([0, 3, 4]), sizes)
    at, want_p, want_e, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(score[at + k] for k in range(n) if y[k]) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        want_p += (good / total).tolist()
        want_e += pairs / total
        want_z += math.log(total)
        at += n
    np.testing.assert_allclose(p, want_p)
    np.testing.assert_allclose(expected, want_e)
    assert z == pytest.approx(want_z)


def labelled(spark, texts):
    return frame(spark, [(i, t, "s") for i, (t, _) in enumerate(texts)]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, y int")


def test_quality_learns_and_takes_odd_rows(spark, odd, none):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choice(("alpha", "beta", "of", "gamma")) + str(rng.choice("abcd")) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(rng.choice(("SPAM!!", "BUY!!")) for _ in range(12)) for _ in range(4))
    docs, labels = labelled(spark, [(good(), 1) if k % 2 else (bad(), 0) for k in range(120)])
    model = quality.learn(docs, labels, "y")
    out = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert all(out[k].predicted == k % 2 for k in range(120))
    assert quality.keep_good(docs, model).count() == 60 and quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_quality(odd, model).count() == odd.count() and quality.score_quality(none, model).count() == 0
    assert quality.keep_good(none, model).count() == 0
    assert quality.learn(docs, labels.filter("y = 1"), "y") > 0.9 and quality.learn(none, labels, "y") == 0.5


def test_toxicity_learns_a_pair(spark, odd, none):
    rng = random.Random(4)
    words = [f"{chr(97 + k % 26)}{k}x" for k in range(40)]
    texts = []
    for k in range(600):
        a, b = k % 2, k // 2 % 2  # only both words together are toxic
        own = [*rng.sample(words, 3), *["insult"] * a, *["folk"] * b]
        texts.append((" ".join(own), a * b))
    docs, labels = labelled(spark, texts)
    model = toxicity.learn(docs, labels, "y")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([out[k].predicted == y for k, (_, y) in enumerate(texts)]) > 0.97
    assert toxicity.score_toxicity(odd, model).count() == odd.count() and toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.learn(none, labels, "y").score("x") == 0.5


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark, [("text", 1)] * 50)
    import zlib

    from vetspark.llm.learning import labelled_sample

    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    assert labelled_sample(docs, labels, "y", 100).count() == n and labelled_sample(docs, labels, "y", 7).count() == 7


def test_samples_are_bounded_by_lines_and_characters(spark, monkeypatch):
    from vetspark.llm import learning

    texts = [(i, "\n".join([f"line {i}"] * (1 + i % 3)), "s") for i in range(60)]
    docs = frame(spark, [*texts, *texts[:20], *texts[:20], (60, "long\n" * 3_000, "s"), (61, "x" * 300_000, "s")])  # copies come as often as they are there
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, y int")
    every = learning.labelled_sample(docs, labels, "y", 1000).collect()
    assert len(every) > 60 and not {60, 61} & {r.id for r in every} and [(r.h, r.id) for r in every] == sorted((r.h, r.id) for r in every)
    for name, bound, of in (("SAMPLE_LINES", 40, "lines"), ("SAMPLE_CHARS", 200, "chars")):
        monkeypatch.setattr(learning, name, bound)
        want, held = [], 0
        for r in every:
            if (held := held + r[of]) > bound:
                break
            want.append((r.y, r.h, "\n".join([f"line {r.id}"] * (1 + r.id % 3)).encode()))
        got = learning.measured_sample(docs, labels, "y", 1000, str.encode)
        assert list(got.itertuples(index=False, name=None)) == sorted(want, key=lambda x: x[1:])
        monkeypatch.undo()


# ------------------------------------------------------------------ mixing


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("empty", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weight, left = {"a": 3, "b": 1, "c": 2, "empty": 3, None: 1}, 1.5 * 1160
    cap, want = {"a": 20, "b": 2000, "c": 200, "empty": 0, None: 100}, {}
    while True:
        level = left / sum(w for s, w in weight.items() if s not in want)
        full = [s for s, w in weight.items() if s not in want and level * w > cap[s]]
        if not full:
            break
        for s in full:
            want[s] = cap[s]
            left -= cap[s]
    want |= {s: level * w for s, w in weight.items() if s not in want}
    assert got == pytest.approx(want)


def test_mixing(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "WORDS_PER_RANGE", 40)
    docs = frame(spark, [(i, " ".join(["w"] * (i % 13)), f"s{i % 3 if i % 2 else 0}") for i in range(300)])
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == 300 and (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    for _, own in out.groupby("source"):
        assert own["size"].sum() == own.source_size.iloc[0] and abs(own.taken.sum() - own.target.iloc[0]) <= 0.5
        order = own.sort_values(["key", "doc_id"])
        assert (order.rank_words == order["size"].cumsum() - order["size"]).all()
    assert mixing.mix_sources(docs.repartition(7)).toPandas().sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist()
    taken = mixing.take_mix(docs)
    words = {r.doc_id: r.n for r in taken.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in out.itertuples() if r.taken} and taken.columns == docs.columns
    assert taken.filter("n_chars != length(text)").count() == 0
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0 and mixing.take_mix(none).count() == 0
    assert mixing.take_mix(odd).filter("text is null or text = ''").count() == 0


# ------------------------------------------------------------------ BPE


def test_bpe_odd_texts_equal_the_library(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(1)
    chars = "aaabcthe  \n\t'sl é!!..12\x1c\x85​中ñß😀́Ⅷ½　"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [t + "<|endoftext|>" + t for t in texts[:20]] + ["a" * 3000, "don't 're", " lead", "trail ", "  two  spaces  "]
    out = {r.doc_id: r for r in bpe.round_trip(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == tok.decode(ids, skip_special_tokens=False) == t
    assert bpe.round_trip(odd).count() == odd.count() and bpe.round_trip(none).count() == 0
    assert all(r.ids == [] and r.decoded == "" for r in bpe.round_trip(odd.filter("coalesce(text, '') = ''")).collect())


def test_bpe_batches_agree_whatever_is_kept(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    texts = [f"some words number {i} and don't {i * 7} repeat" for i in range(60)]
    whole = [x.tolist() for x in bpe.Bpe(spec).encode_batch(texts)]
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    small = bpe.Bpe(spec)
    assert [x.tolist() for t in texts for x in small.encode_batch([t])] == whole and 0 < len(small.chunks) <= 5


# ------------------------------------------------------------------ near duplicates


def test_masks_cover_every_pair_of_bits():
    for r in (1, 2):
        masks = simhash.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for bits in combinations(range(64), r):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_close_links_connect_what_is_close(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b for b in base}
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    links = simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
    assert {x: roots.get(x, x) for x in fps} == {x: top(x) for x in fps}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 600)], "a long, b long")
    assert {r.node: r.root for r in graph.components(links).collect()} == {**{i: 0 for i in range(1, 201)}, 700: 600}
    assert graph.components(links.limit(0)).count() == 0


def test_near_duplicates_odd_rows(spark, odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in out if r.doc_id in (2, 3, 5)} == {2}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    assert sorted((r.doc_id, r.text[:5] if r.text else r.text) for r in kept.filter("doc_id is not null").collect() if r.doc_id in (1, 2, 3, 4, 5)) == [(1, "line "), (1, "other"), (2, None), (4, "w0 w1")]


# ------------------------------------------------------------------ chat


def test_escape_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\n", "<<SYS>><</SYS>>", "<\\s>", "<<|turn|>", "a\nb", "", "[[INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_branches_are_ranked_and_formatted(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 5.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 4.0), (2, 1, 9, "user", "orphan", None), (None, 1, None, None, None, None)]
    tree += [(3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (4, 1, 2, "user", "x", 0.0), (4, 2, 1, "user", "y", 0.0), (4, 3, 1, "user", "leaf", 0.0)]  # cycles
    nodes = spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")
    every = {(r.tree, r.leaf): r.n for r in chat.branch_paths(nodes, best=None).groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()}
    assert every == {(1, 2): 2, (1, 5): 4, (2, 1): 1, (None, 1): 1}
    best = chat.branch_paths(nodes)
    out = {r.tree: r for r in chat.format_paths(best, nodes).select("tree", "leaf", "formatted", "loss", chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert out[1].leaf == 5 and out[1].said == "highend" and len(out[1].loss) == 2 and out[2].said == ""
    turn = lambda r, t: f"<|turn|>{r}<|text|>{t}<|end|>\n"
    assert out[1].formatted == turn("user", "q") + turn("assistant", "high") + turn("user", "more") + turn("assistant", "end")
    assert chat.branch_paths(nodes.limit(0)).count() == 0


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "assistant", "z"), (2, None, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, node int")
    out = {r.tree: r for r in chat.format_conversations(df).select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [tuple(t) for t in out[1].t] == [("user", ""), ("", "x"), ("assistant", "b"), ("assistant", "b")] and out[1].said == "bb"
    assert out[None].said == "z" and out[2].said == LONG and chat.format_conversations(df.limit(0)).count() == 0


def test_a_deep_reply_chain(spark):
    n = 300
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)], "tree long, node long, parent long, role string, text string, score double")
    assert [(r.node, r.depth) for r in chat.branch_paths(nodes).orderBy("depth").collect()] == [(i, i) for i in range(n)]


# ------------------------------------------------------------------ nearest neighbours


def test_nearest_equals_brute_force_when_all_leaves_are_searched(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:70] = x[0]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [math.nan] + [1.0] * 7, "c"), (903, [None] + [1.0] * 7, "c"), (904, [math.inf] + [1.0] * 7, "c"), (None, [1.0] * 8, "c"), (905, [1.0], "c")]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>, key string")
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, effort=1, power=1, leaf=16).toPandas()
    y = x.astype(np.float64)
    for i in range(0, 400, 50):
        d = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(400), d)) if j != i][:10]
        own = found[found.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == best and np.allclose(own.score, d[best], rtol=1e-13)
    assert set(found.query_id) == set(range(0, 400, 50))


@pytest.mark.parametrize("n", [600, 4_000, 16_000])
def test_recall_on_vectors_without_structure(n):
    """The forest alone, in one process: recall stays while the share of the rows that are compared falls."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.fit(x[: ann.SAMPLE], n)
    leaves, recall, compared = forest.leaves(x), [], []
    for i in range(0, n, n // 40):
        hit = np.zeros(n, bool)
        for t, leaf in forest.visit(x[i], ann.searched(*forest.shape, 0.9, 0.7)):
            hit |= leaves[:, t] == leaf
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = 9
        recall.append(hit[np.argsort(d)[:10]].mean())
        compared.append(hit.mean())
    assert np.mean(recall) >= 0.9 and (n < 10_000 or np.mean(compared) < 0.6)


def test_a_large_leaf_is_split(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 8)), 0.001 * rng.normal(size=(300, 8)) + 5])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 30 == 0, effort=1, power=1).collect()))
    monkeypatch.setattr(ann, "GROUP_ROWS", 40)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 30 == 0, effort=1, power=1).collect())) == whole and len(whole) == 120


def test_nearest_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0 and ann.nearest(df.filter("vec_id = 1"), F.col("vec_id") == 0).count() == 0
