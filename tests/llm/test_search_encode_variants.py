"""Ranked search, the transducer and spelling variants against plain Python and the library; every edge of their inputs."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.compare import DATA
from vetspark.llm import fst, queries, ranked, variants

DOCS = "doc_id long, text string, ids string, rank int, score long, word string, `__k` int"


def frame(spark, rows):
    """Documents with columns whose names clash with results and intermediate ones."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in rows], DOCS)


# ------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_ranks(docs, items, k=10):
    cut = [(i, TERM.findall((t or "").translate(ASCII_LOWER))) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    tf = [(i, len(w), Counter(w)) for i, w in cut]
    df = Counter(t for _, _, c in tf for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i] += Counter(TERM.findall((t or "").translate(ASCII_LOWER)))
    out = set()
    for item, terms in asked.items():
        found = []
        for i, size, own in tf:
            if i is None or not size:
                continue
            m = 25 + 75 * size * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t, q in terms.items() if t in own)
            if s > 0:
                found.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


WORDS = ["the", "of", "Ärger", "naïve", "x1", "and", "zeta", "日本", "omega", "pi", "THE", "Of"]


def texts(seed, n, size=30):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + r.choice(("", "", ",", "-", "_")) for _ in range(r.randrange(size))) for _ in range(n)]


def ranks(spark, docs, items, **more):
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    return {tuple(r) for r in ranked.rank_documents(frame(spark, docs), asked, **more).select("item_id", "rank", "doc_id", "score").collect()}


def test_ranks_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ROW_DOCS", 7)
    monkeypatch.setattr(ranked, "ROW_BYTES", 200)
    monkeypatch.setattr(ranked, "TABLE", 300)
    docs = [*enumerate(texts(1, 60)), (100, None), (101, ""), (102, " -- "), (None, "the of omega"), (7, "the zeta"), (7, "the zeta"), (103, "pi " * 5000), (104, "zeta " * 3)]
    items = [*enumerate(texts(2, 12)), (20, "the the the of"), (21, None), (22, "!?"), (23, "nowhere"), (None, "the"), (3, "zeta zeta"), (24, "zeta")]
    assert ranks(spark, docs, items) == plain_ranks(docs, items)
    assert ranks(spark, docs, items, k=1) == plain_ranks(docs, items, 1) and ranks(spark, docs, items, k=100) == plain_ranks(docs, items, 100)


def test_ranks_come_from_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 3)
    docs, items = [*enumerate(texts(3, 20))], [*enumerate(texts(4, 8))]
    assert ranked.sharing_graphs(spark.createDataFrame(items, "item_id long, text string")).count() > 1
    assert ranks(spark, docs, items) == plain_ranks(docs, items)


def test_empty_sides_rank_nothing(spark):
    assert ranks(spark, [], [(1, "the")]) == set() and ranks(spark, [(1, "the")], []) == set() and ranks(spark, [(1, None)], [(1, "the")]) == set()


def expanded(g, part):
    n = len(g.leaves)
    return [g.leaves[part]] if part < n else [leaf for p in g.nodes[part - n] for leaf in expanded(g, p)]


def test_items_share_sums():
    common = [(b"the", 1), (b"of", 1), (b"and", 2)]
    items = [(i, [*common, (f"own{i}".encode(), 1), (f"pair{i // 2}".encode(), 1), (f"twin{i // 2}".encode(), 1)]) for i in range(10)] + [(10, []), (11, [(b"the", 2)])]
    g = ranked.mine(items)
    assert [sorted(x for p in own for x in expanded(g, p)) for own in g.items] == [sorted(own) for _, own in items]
    assert g.additions() < sum(len(own) - 1 for _, own in items if own) // 2
    plan, r = ranked.Plan(g), np.random.default_rng(1)
    at = {t: k for t, k in plan.terms.items()}
    impact = r.integers(0, 9, (len(at), 5))
    term, doc = np.nonzero(impact)
    want = [[sum(n * int(impact[at[t], d]) for t, n in own) for d in range(5)] for _, own in items]
    assert plan.scores(term, doc, impact[term, doc], 5).tolist() == want


# ------------------------------------------------------------ transducer


@pytest.fixture(scope="module")
def ranks_of():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks_of):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of, special_tokens={})


def encoded(machine, text):
    return [int(x) for _, tokens, _ in fst.encode_texts(machine, [text]) for x in tokens]


def test_byte_bpe_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_byte_bpe(spark, DATA).collect()}
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
    assert got == want


@pytest.mark.parametrize(("together", "states"), [(1_000_000, 80_000), (50, 5), (300, 40)])
def test_machine_equals_the_library_on_odd_texts(library, ranks_of, monkeypatch, together, states):
    monkeypatch.setattr(fst, "TOGETHER", together)
    monkeypatch.setattr(fst, "STATES", states)
    machine, r = fst.Transducer(ranks_of), random.Random(states)
    chars = " \n\t'strevmlld  ab1?!é😀中  \x1c\x85́Ω9.,-'"
    for size in [0, 1, 2, 3, 7, 60, 500] * 60:
        text = "".join(r.choice(chars) for _ in range(size))
        assert encoded(machine, text) == library.encode_ordinary(text)
    for text in ("a" * 3000, " " * 700, "\n" * 300 + "x", "'s't're'll'D'm", "the " * 200 + "\n\n", "<|endoftext|>"):
        assert encoded(machine, text) == library.encode_ordinary(text)


def test_words_are_cut_as_the_library_cuts_all_characters(library, ranks_of):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(5).shuffle(every)
    text = "".join(every[:200_000])
    assert encoded(fst.Transducer(ranks_of), text) == library.encode_ordinary(text)


def test_tokens_that_merges_never_make(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    enc = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = fst.Transducer(ranks)
    for text in ("abc", "abcabc", "xyz", "axyz", "bcab abc xyz bc", "aabbcc"):
        assert encoded(machine, text) == enc.encode_ordinary(text)


def test_encoding_and_decoding_of_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "tie"), (3, "tie"), (None, "no id"), (4, "日本 " * 300_000), (5, "x" * 1_200_000)]
    got = fst.round_trip(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.decoded, r.decoded_well_formed) for r in got) == sorted((i or 0, t or "", True) for i, t in rows)
    by_id = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got}
    assert by_id == {i: library.encode_ordinary(t or "") for i, t in rows}
    lists = fst.encode(frame(spark, rows[:5]))
    assert lists.columns == ["doc_id", "ids"] and {tuple(r.ids) for r in lists.collect()} == {tuple(by_id[i]) for i, _ in rows[:5]}
    assert fst.round_trip(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, [0xC3]), (2, [0x80]), (3, None), (4, [ord("é".encode()[0:1]), 65])], "n int, ids array<int>").withColumn("decoded", F.lit(1))
    out = fst.decode(odd.withColumn("ids", F.transform("ids", lambda b: b.cast("int"))), out="text_")
    assert out.columns == ["n", "ids", "decoded", "text_", "text__well_formed"] and {r.n: r.text_ for r in out.collect()}[3] == ""


def test_streaming_decode_equals_decoding_at_once():
    r, lead = random.Random(3), (65, 0x80, 0xBF, 0xC2, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xEF)
    for _ in range(3000):
        data, stream, out, at = bytes(r.choice(lead) for _ in range(r.randrange(14))), fst.Utf8Stream(), "", 0
        while at < len(data):
            to = at + r.randrange(1, 4)
            out += stream.feed(data[at:to])
            at = to
        out += stream.finish()
        assert out == data.decode("utf-8", "replace")
        assert stream.well_formed == (data.decode("utf-8", "ignore").encode() == data)
    table, text = fst.utf8_machine(), "aé中😀߿ࠀ￿\U0010ffff"
    state = 0
    for byte in text.encode():
        state = table[state][byte]
        assert state != fst.BAD
    assert state == 0


# ------------------------------------------------------ spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=5, seen=3, every=97):
    count = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if every and h % every == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= seen}
    holes, found, form = defaultdict(set), {}, {}
    for w in words:
        for i in range(len(w) if len(w) < 1000 else 0):
            holes[w[:i] + w[i + 1 :]].add(w)
    long = [w for w in words if len(w) >= 1000]
    for w, n in words.items():
        close = {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1 :]]} | holes[w] | {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) < 1000 else long
        own = [x for x in close if x in words and near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
        found[w] = len(own)

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, found[w], words[form[w]] if w in form else None) for w, n in words.items()}


def got_variants(df, **more):
    return {tuple(r) for r in variants.spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_plain_python(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


@pytest.mark.parametrize("symbols", [None, 1, 2, 30])
def test_variants_of_edge_rows(spark, monkeypatch, symbols):
    monkeypatch.setattr(variants, "TOGETHER", 100)
    monkeypatch.setattr(variants, "HELD", 10)
    r = random.Random(9)
    base = ["colour", "color", "colours", "größe", "grösse", "größen", "aaaaa", "aaaaaa", "aaaaaaa", "àéîõü", "abcde", "abxde", "abcdé"]
    rows = [(k, " ".join(r.choice(base) + r.choice((" ", "1", "×", "·", "ĀB")) for _ in range(60))) for k in range(12)]
    rows += [(50, None), (51, ""), (None, "colour " * 9), (52, "Colour COLOUR"), (52, "Colour COLOUR"), (53, "longest" * 4000 + " "), (54, "longest" * 4000), (55, "longest" * 4000), (56, ("longest" * 4000 + "x ") * 7), (57, "日" * 400)]
    assert got_variants(frame(spark, rows), symbols=symbols) == plain_variants(rows)
    assert got_variants(frame(spark, rows), symbols=symbols, every=0, seen=1, least=1) == plain_variants(rows, 1, 1, 0)


def test_no_words_no_variants(spark):
    assert got_variants(frame(spark, [])) == set() and got_variants(frame(spark, [(1, "one two"), (2, None)])) == set()


def test_forms_are_followed_to_the_end(spark):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(37)] + [("v", "w30")]
    got = dict(map(tuple, variants.follow(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w37" for w, _ in chain} and variants.follow(spark.createDataFrame([], "word string, form string")).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_neighbourhoods_are_whole_and_without_repeats(symbols):
    words = ["abcab", "aaaaa", "zyxwvu", "b", "abba"]
    table = variants.letter_symbols(symbols, np.bincount([ord(c) for w in words for c in w], minlength=256))
    reduced = ["".join(chr(96 + int(table[ord(c)])) for c in w) for w in words]
    power = [pow(variants.BASE, k, 1 << 64) for k in range(20)]
    code = lambda w: sum((ord(c) - 96) * p for c, p in zip(w, power, strict=False)) % (1 << 64)
    letters = [chr(97 + s) for s in range(symbols)]
    got = [[] for _ in words]
    for place, codes in variants._Reduced(words, table).neighbours(symbols):
        for p, c in zip(place.tolist(), codes.tolist(), strict=True):
            got[p].append(c)
    for w, own in zip(reduced, got, strict=True):
        edits = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        assert sorted(own) == sorted(map(code, edits))
