"""Exact top-k search by BM25 over a sharded inverted index with block maxima."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, skew_join

#: Documents that a task holds while it puts texts alike together; tokens of a shard, and times as many that are held; documents of a part, which are scored together, and of a block, for which maxima are kept.
SHARD_DOCS, SHARD_TOKENS, HELD, PART_DOCS, BLOCK_DOCS = 16_384, 2_000_000, 4, 4096, 64
#: A term that so many documents of a part hold is kept as a full row there, the commonest so many at most; the rest are lists.  Queries that are scored together, and postings that are added up at once.
FULL_ROW, FULL_ROWS, TOGETHER, POSTINGS = 128, 1024, 256, 100_000
#: Bytes of text that are cut into words together.
CUT_BYTES = 8_000_000
#: Commonest terms by which texts are told apart, how often a set of them is cut in two, and texts that aren't cut any more.
TELLING, CUTS, UNCUT = 256, 4, 64
#: Queries, and their terms, that are sent to all shards at a time: a bounded broadcast.
BLOCK_QUERIES, BLOCK_TERMS = 6_000, 2_000_000
#: Scores are rounded to this many decimals, so that equal texts tie whatever the order of summation.
DECIMALS = 9
SLACK = 1e-6
NO_ID = -(2**63)
K1, B = 1.2, 0.75


def terms_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, in order with repeats."""
    words = text.encode().lower().split() if text else []
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


SHARD = "ids binary, sizes binary, terms binary, starts binary, docs binary, tf binary"


def _alike(x: np.ndarray) -> np.ndarray:
    """Numbers of texts, next to each other for texts alike: halves of halves, cut by the sign along the direction in which they differ most."""
    code = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0)]
    while todo:
        at, cuts = todo.pop()
        if cuts == CUTS or len(at) <= UNCUT:
            continue
        y = x[at] - x[at].mean(axis=0)
        v = y[np.argmax(np.einsum("ij,ij->i", y, y))]
        for _ in range(6):
            v = y.T @ (y @ v)
            v /= max(float(np.linalg.norm(v)), 1e-30)
        right = y @ v > 0
        code[at[right]] += 1 << (CUTS - 1 - cuts)
        todo += [(half, cuts + 1) for half in (at[~right], at[right]) if 0 < len(half) < len(at)]
    return code


def _directions(text: np.ndarray, term: np.ndarray, n_texts: int, telling: np.ndarray) -> np.ndarray:
    """A row of length 1 for each text: how often it holds the telling terms; ``telling`` has a term's column or -1."""
    at = telling[term]
    some = at >= 0
    x = np.log1p(np.bincount(text[some] * TELLING + at[some], minlength=n_texts * TELLING).astype(np.float32)).reshape(n_texts, TELLING)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]


def _columns(n: np.ndarray) -> np.ndarray:
    """For terms that occur ``n`` times: the places of the commonest among them, -1 for the others."""
    out = np.full(len(n), -1, np.int64)
    top = np.argsort(-n, kind="stable")[:TELLING]
    out[top] = np.arange(len(top))
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], …, starts[0] + sizes[0] - 1, starts[1], …"""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _shard(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
    """Postings of some documents: for each term, ascending, its documents and how often they hold it; words are places in ``terms``."""
    key, tf = np.unique(words.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    arrays = [ids, sizes.astype(np.int32), terms[term[starts]], np.append(starts, len(term)).astype(np.int32), doc.astype(np.uint16), tf.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["ids", "sizes", "terms", "starts", "docs", "tf"])


def _shards(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shards of some documents, which are numbered so that texts alike, and of them those alike in size, share blocks; ``terms`` ascend."""
    telling, ends, x = _columns(np.bincount(words, minlength=len(terms))), np.cumsum(sizes), []
    for a in range(0, len(ids), 1024):
        n = sizes[a : a + 1024]
        x.append(_directions(np.repeat(np.arange(len(n)), n), words[ends[a] - n[0] : ends[a] - n[0] + n.sum()], len(n), telling))
    by = np.lexsort((ids, sizes, _alike(np.concatenate(x))))
    ids, sizes, starts = ids[by], sizes[by], (ends - sizes)[by]
    ends, a = np.cumsum(sizes), 0
    while a < len(ids):
        z = min(a + PART_DOCS, max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + SHARD_TOKENS, "right"))))
        yield _shard(ids[a:z], sizes[a:z], words[_spread(starts[a:z], sizes[a:z])], terms)
        a = z


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: how many words each has, all words as places in a list, and the hashes of that list."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = cut.flatten().dictionary_encode()
    known, at = words.dictionary.cast(pa.binary()).to_pylist(), words.indices.to_numpy()
    sizes = np.diff(cut.offsets.to_numpy())
    if b"" in known:  # beside white space at an end
        some = at != known.index(b"")
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[some], minlength=len(texts))
        at = at[some]
    return sizes.astype(np.int64), at, np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)).view(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    words: list[np.ndarray] = []
    known: list[np.ndarray] = []

    def shards() -> Iterator[pa.RecordBatch]:
        terms, rank = np.unique(np.concatenate(known), return_inverse=True)
        yield from _shards(np.concatenate(ids), np.concatenate(sizes), rank.astype(np.int32)[np.concatenate(words)], terms)
        for held in (ids, sizes, words, known):
            held.clear()
        pa.default_memory_pool().release_unused()

    for b in batches:
        ends, a = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while a < b.num_rows:
            z = min(a + SHARD_DOCS - sum(map(len, ids)), max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CUT_BYTES, "right"))))
            n, at, hashes = _words(b.column(1).slice(a, z - a))
            ids.append(b.column(0).slice(a, z - a).to_numpy())
            sizes.append(n)
            words.append(at + np.int32(sum(map(len, known))))
            known.append(hashes)
            a = z
            if sum(map(len, words)) >= HELD * SHARD_TOKENS or sum(map(len, ids)) == SHARD_DOCS:
                yield from shards()
    if ids:
        yield from shards()


@dataclass
class Queries:
    """Some queries at a time: query i has the terms ``at[start[i]:start[i + 1]]``, places in ``terms``, each weighing ``idf``."""

    ids: np.ndarray
    start: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    idf: np.ndarray


def _queries(rows: pa.Table) -> Queries:
    """From (query_id, term array, idf array); queries alike are neighbours."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return Queries(*(np.zeros(n, t) for n, t in ((0, np.int64), (1, np.int64), (0, np.int64), (0, np.int64), (0, np.float64))))
    term, idf = (rows.column(c).chunk(0) for c in ("term", "idf"))
    terms, first, at = np.unique(term.flatten().to_numpy(), return_index=True, return_inverse=True)
    n, weight = np.diff(term.offsets.to_numpy()), idf.flatten().to_numpy()[first]
    by = np.lexsort((n, _alike(_directions(np.repeat(np.arange(len(n)), n), at, len(n), _columns(-weight)))))
    at = at[_spread((np.cumsum(n) - n)[by], n[by])]
    return Queries(rows.column("query_id").to_numpy()[by], np.append(0, np.cumsum(n[by], dtype=np.int64)), at, terms, weight)


class _Part:
    """Up to ``PART_DOCS`` neighbouring documents of a shard, for some queries: impacts of the postings of their terms, and maxima.

    Frequent terms are rows of ``full``, with single precision in ``rough`` and the maxima of their blocks in ``block_max``; the postings of the others are lists
    (``doc``, ``impact``, from ``start``), with one maximum for the part.
    """

    def __init__(self, ids: np.ndarray, n_terms: int, here: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        self.ids, self.width = ids, math.ceil(len(ids) / BLOCK_DOCS) * BLOCK_DOCS
        n = np.bincount(term, minlength=len(here))
        least = FULL_ROW if len(n) <= FULL_ROWS else max(FULL_ROW, int(np.partition(n, len(n) - FULL_ROWS - 1)[len(n) - FULL_ROWS - 1]) + 1)
        frequent = n >= least
        self.row = np.full(n_terms, -1, np.int32)
        self.row[here[frequent]] = np.arange(frequent.sum())
        full = frequent[term]
        self.full = np.zeros((int(frequent.sum()), self.width))
        self.full[self.row[here[term[full]]], doc[full]] = impact[full]
        self.rough = self.full.astype(np.float32)
        self.block_max = self.rough.reshape(len(self.full), self.width // BLOCK_DOCS, BLOCK_DOCS).max(axis=2)
        self.n = np.zeros(n_terms, np.int64)
        self.n[here] = np.where(frequent, 0, n)
        self.start = np.cumsum(self.n) - self.n
        self.doc, self.impact = doc[~full].astype(np.int64), impact[~full]
        self.max = np.zeros(n_terms)
        some = np.flatnonzero(self.n)
        if len(some):
            self.max[some] = np.maximum.reduceat(self.impact, self.start[some])
        self.by_id = np.argsort(ids, kind="stable")

    def _rest(self, rows: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the lists of the terms ``at`` add to the documents, for the queries ``rows``: exact."""
        out = np.zeros((len(rows), self.width))
        start, n, place = self.start[at], self.n[at], np.searchsorted(rows, query) * self.width
        cut = np.searchsorted(query, np.append(rows, np.iinfo(np.int64).max))
        total = np.append(0, np.cumsum(n))[cut]
        a = 0
        while a < len(rows):
            z = max(a + 1, int(np.searchsorted(total, total[a] + POSTINGS, "right")) - 1)
            own = slice(cut[a], cut[z])
            postings = _spread(start[own], n[own])
            cell = np.repeat(place[own] - a * self.width, n[own]) + self.doc[postings]
            out[a:z] = np.bincount(cell, self.impact[postings], minlength=(z - a) * self.width).reshape(z - a, self.width)
            a = z
        return out

    def search(self, at: np.ndarray, query: np.ndarray, own: np.ndarray | None, best: np.ndarray, best_ids: np.ndarray) -> int:
        """Improve the best scores (descending) and ids of some queries in place; query ``query[i]``, ascending, has the term ``at[i]``.

        What lists add is exact.  A block's bound is the most that they add to a document of it and the sum of its frequent terms' maxima.  Where that doesn't reach a query's k-th
        best score so far, no document of the block can be among its best: there is no pivot in it, and the block is skipped.  A query without such a
        score gets one from its most promising block.  In the other blocks products in single precision, rounded up, choose the documents that are scored.
        Returns how many documents weren't skipped, over all queries.
        """
        k = best.shape[1]
        least = np.maximum(best[:, -1] - SLACK, 0)
        row = self.row[at]
        f, lists = np.flatnonzero(row >= 0), np.flatnonzero(self.n[at])
        row, n_rows = row[f], np.bincount(query[f], minlength=len(best))
        error = (int(n_rows.max(initial=0)) + 4) * 2.0**-23
        asks = np.zeros((len(best), len(self.full)), np.float32)
        asks[query[f], row] = 1 + error
        bound = asks @ self.block_max
        rows = np.flatnonzero(bound.max(axis=1) + np.bincount(query[lists], self.max[at[lists]], minlength=len(best)) > least)
        if not len(rows):
            return 0
        if len(rows) < len(best):
            some = np.zeros(len(best), bool)
            some[rows] = True
            lists = lists[some[query[lists]]]
        rest = self._rest(rows, query[lists], at[lists])
        rest[:, len(self.ids) :] = -np.inf
        rest[:, np.flatnonzero(self.ids == NO_ID)] = -np.inf
        if own is not None:
            low, high = (np.searchsorted(self.ids[self.by_id], own[rows], side) for side in ("left", "right"))
            for i in np.flatnonzero(low < high).tolist():
                rest[i, self.by_id[low[i] : high[i]]] = -np.inf
        used = np.flatnonzero(asks.any(axis=0))
        bound, least, asks = bound[rows] + rest.reshape(len(rows), -1, BLOCK_DOCS).max(axis=2), least[rows], asks[np.ix_(rows, used)]
        for i in np.flatnonzero(least == 0).tolist() if k <= BLOCK_DOCS else ():
            docs = slice((block := int(bound[i].argmax())) * BLOCK_DOCS, (block + 1) * BLOCK_DOCS)
            kth = np.partition(asks[i] @ self.rough[used, docs] + rest[i, docs], BLOCK_DOCS - k)[BLOCK_DOCS - k]
            least[i] = max(0, kth * (1 - 2 * error) - SLACK)
        open_ = bound > least[:, None]
        upper = np.full((len(rows), self.width), -np.inf)
        for a, z in np.flatnonzero(np.diff(open_.any(axis=0), prepend=False, append=False)).reshape(-1, 2).tolist():
            some, docs = np.flatnonzero(open_[:, a:z].any(axis=1)), slice(a * BLOCK_DOCS, z * BLOCK_DOCS)
            if len(some) == len(rows):
                np.add(asks @ self.rough[used, docs], rest[:, docs], out=upper[:, docs])
            else:
                upper[some, docs] = asks[some] @ self.rough[used, docs] + rest[some, docs]
        found = upper > least[:, None]
        many = np.flatnonzero(np.count_nonzero(found, axis=1) > k)
        if len(many):
            found[many] &= upper[many] >= (np.partition(upper[many], self.width - k, axis=1)[:, self.width - k] * (1 - 2 * error) - SLACK)[:, None]
        i, doc = np.divmod(np.flatnonzero(found), self.width)
        if len(i):
            n = n_rows[rows[i]]
            terms = row[_spread((np.cumsum(n_rows) - n_rows)[rows[i]], n)]
            s = rest[i, doc] + np.bincount(np.repeat(np.arange(len(i)), n), self.full[terms, np.repeat(doc, n)], minlength=len(i))
            there = s > 0
            i, doc, s = rows[i[there]], doc[there], np.round(s[there], DECIMALS)
            some, i = np.unique(i, return_inverse=True)
            every = np.concatenate((np.repeat(np.arange(len(some)), k), i))
            s, ids = np.concatenate((best[some].ravel(), s)), np.concatenate((best_ids[some].ravel(), self.ids[doc]))
            order = np.lexsort((ids, -s, every))
            top = order[np.searchsorted(every[order], np.arange(len(some)))[:, None] + np.arange(k)]
            best[some], best_ids[some] = s[top], ids[top]
        return int(np.count_nonzero(open_)) * BLOCK_DOCS


def _parts(shard: dict, q: Queries, average: float) -> Iterator[_Part]:
    """A shard's part, if it has any words; shards have ``PART_DOCS`` documents at most."""
    ids, size = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["sizes"], np.int32)
    terms, starts = np.frombuffer(shard["terms"], np.int64), np.frombuffer(shard["starts"], np.int32).astype(np.int64)
    if not len(terms) or not len(q.terms):
        return
    at = np.minimum(np.searchsorted(terms, q.terms), len(terms) - 1)
    here = np.flatnonzero(terms[at] == q.terms)
    n = starts[at[here] + 1] - starts[at[here]]
    postings = _spread(starts[at[here]], n)
    doc, impact = np.frombuffer(shard["docs"], np.uint16)[postings], np.frombuffer(shard["tf"], np.int32)[postings].astype(np.float64)
    del postings
    short = K1 * (1 - B + B * size / average)
    impact *= (K1 + 1) / (impact + short[doc])
    impact *= np.repeat(q.idf[here], n)
    yield _Part(ids, len(q.terms), here, np.repeat(np.arange(len(here), dtype=np.int32), n), doc, impact)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text", skip_own: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of every query, exactly.

    Score: sum over the query's distinct words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average size)) with
    k1 1.2, b 0.75 and idf ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the average size are
    those of all ``docs``.  Scores are rounded to 9 decimals; ties go to the smaller id; documents that share no
    word aren't results.  Words are runs of anything but ASCII white space, A-Z lower-cased.  With ``skip_own`` a query
    doesn't find the document of its own id.

    Every task indexes its documents in shards; nothing but word counts and results is shuffled.  Queries
    go to all shards in blocks of bounded size, one after the other.  A shard holds texts alike, numbered so that they share blocks, and skips, for each query,
    the blocks whose maxima don't reach the query's k-th best score, which a task carries from shard to shard; the tasks' bests are merged by query.

    Ids are whole numbers.  Null and empty texts count as documents and are never found; rows without id count and aren't
    found either; rows that repeat an id are documents of their own.  Queries that repeat an id are one, with all their words.  No rows give no rows.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), t.alias("text"))
    n_docs = rows.count()
    index = materialise(rows.coalesce(max(1, math.ceil(n_docs / SHARD_DOCS))).mapInArrow(_build, SHARD), "search-index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                terms, df = np.frombuffer(r["terms"], np.int64), np.diff(np.frombuffer(r["starts"], np.int32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], names=["term", "df"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(r["sizes"], np.int32).sum(dtype=np.int64)) for r in b.to_pylist()], pa.int64())], names=["size"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.unique(terms_of(x.as_py())) for x in b.column(1)]
            ids = pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in terms]), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(terms) if terms else [], pa.int64())], names=["query_id", "term"])

    total = index.select("sizes").mapInArrow(lengths, "size long").agg(F.sum("size")).first()[0] or 0
    average = max(total, 1) / max(n_docs, 1)
    df = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("query_id"), F.col(f"`{query_text}`").cast("string").alias("text")).filter("query_id is not null")
    asked = asked.mapInArrow(words, "query_id long, term long").distinct()
    weighed = skew_join(asked, df, ["term"]).withColumn("idf", F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = materialise(weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms")), "search-queries")
    n_queries, n_terms = weighed.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES), math.ceil(n_terms / BLOCK_TERMS))

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def search(shared) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best, ids = np.full((len(q.ids), k), -np.inf), np.zeros((len(q.ids), k), np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    for part in _parts(b.slice(i, 1).to_pylist()[0], q, average):
                        for a in range(0, len(q.ids), TOGETHER):
                            s = slice(a, a + TOGETHER)
                            at = q.at[q.start[a] : q.start[min(a + TOGETHER, len(q.ids))]]
                            part.search(at, np.repeat(np.arange(len(q.ids[s])), np.diff(q.start[a : a + TOGETHER + 1])), q.ids[s] if skip_own else None, best[s], ids[s])
            there = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q.ids, k).reshape(best.shape)[there], ids[there], best[there])], names=["query_id", "doc_id", "score"])

        found = index.mapInArrow(of, "query_id long, doc_id long, score double").withColumn("rank", F.row_number().over(best_first))
        return found.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    out = None
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(_queries(weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "terms.term", "terms.idf").toArrow()))
        found = materialise(search(shared), "search-found")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
