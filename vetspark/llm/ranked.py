"""Ranked search for many items at once: what items share is added up once.

Items are sums over their terms.  Term sets that several items hold are mined and become nodes of a sharing graph; for some documents at a time
every node's partial scores are worked out once, and items are put together from them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .fst import spread

#: Items, and terms of theirs, that share a graph and are sent to all tasks at a time: a bounded broadcast.
BLOCK_ITEMS, BLOCK_TERMS = 512, 300_000
#: Documents of a row of postings, and bytes of text that are cut into terms together; numbers of a table of partial scores.
ROW_DOCS, ROW_BYTES, TABLE = 1024, 2_000_000, 4_000_000
#: Bytes of terms, A-Z lower-cased; all others are blanks.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
#: Fixed values of the score, all whole numbers.
WEIGHT, SCALE, TF, LENGTH, FLAT, SLOPE = 1_000, 1_000_000_000, 1_000, 8, 25, 75


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms in order, with repeats."""
    return text.encode().translate(TERMS).split() if text else []


# ------------------------------------------------------- sharing graph


@dataclass
class Graph:
    """Sums that build on each other.

    Leaf i is ``leaves[i]``: a term and how often an item holds it.  Node k, numbered on from the leaves, is the sum of
    ``nodes[k]``, earlier ones; item ``ids[i]`` is the sum of ``items[i]``.
    """

    leaves: list[tuple[bytes, int]] = field(default_factory=list)
    nodes: list[list[int]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)

    def additions(self) -> int:
        """How many additions a document takes."""
        return sum(len(x) - 1 for x in chain(self.nodes, self.items) if x)


def mine(items: list[tuple[int, list[tuple[bytes, int]]]]) -> Graph:
    """The sharing graph of some items, each a set of (term, times).

    Terms that exactly the same items hold are one set.  Each item then lists its sets, those of many items first, and the pair of
    neighbours that most lists hold becomes a set of its own, as long as two lists share one: linear in the lists at every round,
    no pairs within an item but its neighbours.
    """
    g = Graph(ids=[i for i, _ in items])
    holders: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for at, (_, own) in enumerate(items):
        for leaf in own:
            holders[leaf].append(at)
    g.leaves = sorted(holders)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for i, leaf in enumerate(g.leaves):
        alike[tuple(holders[leaf])].append(i)

    def node(parts: list[int]) -> int:
        g.nodes.append(parts)
        return len(g.leaves) + len(g.nodes) - 1

    lists: list[list[int]] = [[] for _ in items]
    for held, leaves in sorted(alike.items(), key=lambda x: (-len(x[0]), x[1])):
        one = leaves[0] if len(leaves) == 1 else node(leaves)
        for at in held:
            lists[at].append(one)
    while True:
        count = Counter(p for own in lists for p in set(pairwise(own)))
        made: dict[tuple[int, int], int] = {}
        for at, own in enumerate(lists):
            out, i = [], 0
            while i < len(own):
                pair = (own[i], own[i + 1]) if i + 1 < len(own) else None
                n = count[pair] if pair else 0
                if n < 2 or i + 2 < len(own) and count[own[i + 1], own[i + 2]] > n:
                    out.append(own[i])
                    i += 1
                    continue
                if pair not in made:
                    made[pair] = node([*pair])
                out.append(made[pair])
                i += 2
            lists[at] = out
        if not made:
            break
    g.items = lists
    return g


class Plan:
    """A graph ready to be worked out for tables of documents: nodes by level, each level at once."""

    def __init__(self, g: Graph) -> None:
        self.ids = np.array(g.ids, np.int64)
        place: dict[bytes, int] = {}
        self.leaf_term = np.array([place.setdefault(t, len(place)) for t, _ in g.leaves], np.int64)
        self.times = np.array([n for _, n in g.leaves], np.int64)
        self.terms = place
        n = len(g.leaves)
        level = [0] * n
        for parts in g.nodes:
            level.append(1 + max(level[p] for p in parts))
        by_level: dict[int, list[int]] = defaultdict(list)
        for k in range(n, n + len(g.nodes)):
            by_level[level[k]].append(k)
        flat = lambda groups: (np.array([*chain.from_iterable(groups)], np.int64), np.cumsum([0, *map(len, groups)])[:-1])
        self.levels = [(np.array(ks), *flat([g.nodes[k - n] for k in ks])) for _, ks in sorted(by_level.items())]
        self.size = n + len(g.nodes)
        self.some = np.array([i for i, own in enumerate(g.items) if own], np.int64)
        self.parts, self.first = flat([own for own in g.items if own])
        order = np.argsort(self.leaf_term, kind="stable")
        self.by_term, self.n_leaves = order, np.bincount(self.leaf_term, minlength=len(place))
        self.first_leaf = np.cumsum(self.n_leaves) - self.n_leaves

    def docs_at_a_time(self) -> int:
        return max(8, TABLE // max(1, self.size + len(self.parts)))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores of every item for documents 0 to ``n_docs``, from postings: a term, a document that holds it, what one mention of it adds."""
        table = np.zeros((self.size, n_docs), np.int64)
        n = self.n_leaves[term]
        leaf = self.by_term[spread(self.first_leaf[term], n)]
        table[leaf, np.repeat(doc, n)] = np.repeat(impact, n) * self.times[leaf]
        for ks, parts, first in self.levels:
            table[ks] = np.add.reduceat(table[parts], first, axis=0)
        out = np.zeros((len(self.ids), n_docs), np.int64)
        if len(self.some):
            out[self.some] = np.add.reduceat(table[self.parts], self.first, axis=0)
        return out


# ------------------------------------------------------------ postings

POSTINGS = "ids binary, sizes binary, doc binary, term binary, tf binary"


class _Postings:
    """Collects documents; gives the postings of some terms of up to ``ROW_DOCS`` of them as one row."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.get, self.n_terms = terms.get, max(1, len(terms))
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.keys: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.waiting: list[tuple[int, list[bytes]]] = []
        self.held = 0

    def _count(self) -> None:
        n = np.fromiter((len(w) for _, w in self.waiting), np.int64, len(self.waiting))
        at = np.fromiter(map(self.get, chain.from_iterable(w for _, w in self.waiting), repeat(-1)), np.int64, int(n.sum()))
        doc = np.repeat(np.fromiter((d for d, _ in self.waiting), np.int64, len(self.waiting)), n)
        keys, tf = np.unique((doc * self.n_terms + at)[at >= 0], return_counts=True)
        self.keys.append(keys)
        self.tf.append(tf)
        self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        """One document; a long text is cut between terms."""
        data = text.encode().translate(TERMS) if text else b""
        self.ids.append(doc_id)
        self.sizes.append(0)
        at = 0
        while at < len(data):
            end = len(data) if len(data) - at <= ROW_BYTES else data.find(b" ", at + ROW_BYTES)
            words = data[at : end if end > 0 else len(data)].split()
            at = end if end > 0 else len(data)
            self.sizes[-1] += len(words)
            self.waiting.append((len(self.ids) - 1, words))
            self.held += sum(map(len, words)) + len(words)
            if self.held >= ROW_BYTES:
                self._count()

    def row(self) -> pa.RecordBatch:
        self._count()
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        tf = np.bincount(back, np.concatenate(self.tf), len(keys)).astype(np.int64)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        sizes = np.where(known, self.sizes, -1 - np.array(self.sizes, np.int64))  # a document without id counts, but is never found
        arrays = [ids, sizes.astype(np.int64), (keys // self.n_terms).astype(np.uint16), (keys % self.n_terms).astype(np.int32), tf.astype(np.int32)]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[c.split()[0] for c in POSTINGS.split(", ")])


def _read(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("sizes", np.int64), ("doc", np.uint16), ("term", np.int32), ("tf", np.int32)))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Whole-number weights of terms by how many documents hold them; 0 for terms that none holds."""
    found = (math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist())
    return np.fromiter(found, np.int64, len(df))


def _blocks(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(block, item_id, terms): items dealt to blocks of bounded size, terms with how often an item holds them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Counter(terms_of(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array([*own], pa.binary()), pa.array([*own.values()], pa.int64())], names=["item_id", "term", "n"])

    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("item_id is not null")
    terms = rows.mapInArrow(words, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    whole = materialise(terms.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms")), "items")
    n_items, n_terms = whole.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n = max(1, math.ceil(n_items / BLOCK_ITEMS), math.ceil(n_terms / BLOCK_TERMS))
    return whole.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))


GRAPH = "block int, terms array<binary>, times array<long>, nodes array<array<int>>, ids array<long>, items array<array<int>>"


def sharing_graphs(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per block of items: its sharing graph, mined where the block is."""

    def of(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["item_id"])
        g = mine([(r["item_id"], [(x["term"], x["n"]) for x in r["terms"]]) for r in rows])
        row = {"block": rows[0]["block"], "terms": [t for t, _ in g.leaves], "times": [n for _, n in g.leaves], "nodes": g.nodes, "ids": g.ids, "items": g.items}
        types = {"block": pa.int32(), "terms": pa.list_(pa.binary()), "times": pa.list_(pa.int64()), "nodes": pa.list_(pa.list_(pa.int32())), "ids": pa.list_(pa.int64()), "items": pa.list_(pa.list_(pa.int32()))}
        return pa.Table.from_pylist([row], pa.schema(types))

    return _blocks(items, item_id, text).groupBy("block").applyInArrow(of, GRAPH)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0; ties go to the smaller id.

    Terms are runs of anything but the ASCII characters that are no letters or digits, A-Z lower-cased.  With N the documents that have a term, L all their terms, n a
    document's, df the documents that hold a term and tf how often one does: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 25 + (75 n N div L), and
    its score sums w ((1000000000 tf) div (1000 tf + 8 m)) over an item's terms with repeats, in 64-bit whole numbers.

    Items share a sharing graph in blocks of bounded size, one block after the other.  For each, tasks keep the postings of the
    block's terms, the counts over all documents come from those, and every task works the graph out for some documents at a time
    and keeps the best of each item.  Null texts have no terms; documents without id count, but aren't found; documents that
    repeat an id are documents of their own.  Items that repeat an id are one, with all their terms; items without id or terms give no rows, nor does an empty table.
    """
    spark = docs.sparkSession
    graphs = materialise(sharing_graphs(items, item_id, item_text), "graphs")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    totals, out = None, None
    for (block,) in sorted(graphs.select("block").collect()):
        row = graphs.filter(F.col("block") == block).first()
        plan = Plan(Graph([(bytes(t), n) for t, n in zip(row.terms, row.times, strict=True)], row.nodes, row.ids, row.items))
        shared = spark.sparkContext.broadcast(plan)
        postings = _postings(rows, shared)
        if totals is None:
            totals = _totals(postings)
        shared_weights = spark.sparkContext.broadcast(weights(_df(postings, len(plan.terms)), totals[0]))
        found = materialise(_search(postings, shared, shared_weights, totals, k), "ranked", postings)
        shared.destroy()
        shared_weights.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _postings(rows: DataFrame, shared) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Postings(shared.value.terms)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(i, t.as_py())
                if len(held.ids) == ROW_DOCS:
                    yield held.row()
        if held.ids:
            yield held.row()

    return materialise(rows.mapInArrow(of, POSTINGS), "postings")


def _totals(postings: DataFrame) -> tuple[int, int]:
    """(documents that have terms, terms of all documents)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for x in b.column(0):
                size = np.frombuffer(x.as_buffer(), np.int64)
                size = np.where(size < 0, -1 - size, size)
                n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found = postings.select("sizes").mapInArrow(of, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def _df(postings: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of a block: counted by task, then summed by term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for x in b.column(0):
                df += np.bincount(np.frombuffer(x.as_buffer(), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    found = postings.select("term").mapInArrow(of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class _Best:
    """The best documents of each item so far, best first."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.ids, self.k = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), k

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        item, doc = np.nonzero((score >= self.score[:, -1:]) & (score > 0))
        if not len(item):
            return
        rows, at = np.unique(item, return_inverse=True)
        every = np.concatenate((np.repeat(np.arange(len(rows)), k), at))
        s, i = np.concatenate((self.score[rows].ravel(), score[item, doc])), np.concatenate((self.ids[rows].ravel(), ids[doc]))
        order = np.lexsort((i, -s, every))
        top = order[np.searchsorted(every[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        self.score[rows], self.ids[rows] = s[top], i[top]


def _search(postings: DataFrame, shared, shared_weights, totals: tuple[int, int], k: int) -> DataFrame:
    n_docs, length = totals

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value, shared_weights.value
        best, step = _Best(len(plan.ids), k), plan.docs_at_a_time()
        for b in batches:
            for r in range(b.num_rows):
                ids, size, doc, term, tf = _read(b.slice(r, 1).to_pylist()[0])
                tf = tf.astype(np.int64)
                m = FLAT + SLOPE * np.maximum(size, 0) * n_docs // max(1, length)
                impact = weight[term] * (SCALE * tf // (TF * tf + LENGTH * m[doc]))
                cut = np.searchsorted(doc, np.arange(0, len(ids) + step, step))
                for at, (a, z) in zip(range(0, len(ids), step), pairwise(cut.tolist()), strict=False):
                    score = plan.scores(term[a:z], doc[a:z].astype(np.int64) - at, impact[a:z], min(step, len(ids) - at))
                    score[:, size[at : at + step] < 0] = 0
                    best.take(score, ids[at : at + step])
        there = best.score > 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(plan.ids, k).reshape(there.shape)[there], best.ids[there], best.score[there])], names=["item_id", "doc_id", "score"])

    order = F.desc("score"), "doc_id"
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)  # a first merge in many tasks
    found = postings.mapInArrow(of, "item_id long, doc_id long, score long").withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return found.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
