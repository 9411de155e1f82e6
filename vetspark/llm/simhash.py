"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hidden, materialise, skew_join
from .graph import components

BITS = 64
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16


def shingles(text: str | None, words: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, ``CHUNK`` at a time; repeats count.

    A-Z are lower-cased; shingles are joined by single spaces.  Fewer words than a shingle are one shingle.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist() if len(found) >= words else [len(joined)])
        yield np.array([hash_of(joined[a:b], seed) for a, b in spans], dtype=">u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Majority bits of hashes as a signed 64-bit number; 0 for none."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for part in hashes:
        n += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of a text's word shingles, as a signed 64-bit number; no words, or null, give 0."""
    return majority(shingles(text, words, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every row's whole text, as a long; a null text hashes like an empty one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((fingerprint(t.as_py(), words, seed) for t in batch.column(2)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["doc_id", "text_hash", "fp"])

    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 bit masks, one of which keeps none of any ``radius`` bits.

    Bit i gets a nonzero vector of radius + 1 bits, all in turn; mask v keeps the
    bits whose vector has an odd product with v.  Any ``radius`` vectors leave a v that is even with all of
    them, so fingerprints that differ in those bits alone agree under mask v.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**BITS if x >= 2 ** (BITS - 1) else x


def close_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect the distinct values ``fp`` of ``fps`` at ``radius`` (1 or 2) or fewer differing bits.

    Every pair within the radius shares a bucket of some mask: the masks find who has a partner, and which bits may differ.  Buckets with
    one fingerprint end there.  Comparing all pairs of a bucket would grow with the square of a hot one, so links are made another way.  Members of the others meet halfway: each is
    listed under itself and under itself with one bit changed that the bucket leaves open; two meet if and
    only if they differ in two bits at most.  One meeting place has at most 65 members, however
    large the bucket, and each is linked to the smallest of them.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    shared = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1").select("mask", "bits")
    open_bits = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("mask") + 1)
    members = skew_join(rows, shared, ["mask", "bits"]).groupBy("fp").agg(F.bit_or(open_bits).alias("open"))
    flips = F.filter(F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)]), lambda b: b.bitwiseAND(F.col("open")) != 0)
    bit = members.select("fp", F.explode(flips).alias("b"))
    if radius == 1:  # the two ends of a changed bit meet under the smaller and the bit
        meets = bit.select("fp", F.struct(F.least("fp", F.col("fp").bitwiseXOR(F.col("b"))), "b").alias("place"))
    else:
        meets = bit.select("fp", F.col("fp").bitwiseXOR(F.col("b")).alias("place")).unionByName(members.select("fp", F.col("fp").alias("place")))
    met = meets.groupBy("place").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).filter("a != b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, first) for every row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id``
    is the smallest id that a row's fingerprint reaches over links, its own included (null ids come
    last); ``first`` holds that id and its smallest text hash.  Equal
    fingerprints are one node.  Texts without words (null, empty) have
    fingerprint 0 and link like any other.  Repeated rows stay.  No rows give no rows.
    """
    rows = materialise(fingerprints(docs, doc_id, text, words, seed), "simhash")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    own = materialise(rows.groupBy("fp").agg(F.min(who).alias("first")), "simhash-distinct")
    root = components(close_links(own, radius)).withColumnRenamed("node", "fp")
    # a root's own row isn't among the linked nodes
    linked = materialise(skew_join(own, root.unionByName(root.select(F.col("root").alias("fp"), "root").distinct()), ["fp"]), "simhash-linked")
    best = linked.groupBy("root").agg(F.min("first").alias("least"))
    ids = skew_join(linked.select("fp", "root"), best, ["root"]).select("fp", "least")
    named = skew_join(own, ids, ["fp"], "left").select("fp", F.coalesce("least", "first").alias("first"))
    return skew_join(rows, named, ["fp"]).select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def meeting_places(hashes: np.ndarray, fp: int, masks: list[int], bands: int, rows: int, seed: int) -> list[int]:
    """Signed keys under which a set of distinct shingle hashes is listed: ``fp`` under every mask, and ``bands`` of ``rows`` smallest hashes."""
    draw = np.random.default_rng(seed).integers(0, 2**64, (2, bands * rows), np.uint64)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None]
        np.minimum(least, ((part ^ draw[0]) * (draw[1] | np.uint64(1))).min(axis=0), out=least)
    keys = [(fp & m) % 2**BITS for m in masks]
    places = [k.to_bytes(8, "big") for k in keys] + [least[i : i + rows].tobytes() for i in range(0, bands * rows, rows)]
    return [_signed(xxhash.xxh64_intdigest(k, i)) for i, k in enumerate(places)]


def _set_of(text: str | None, words: int, seed: int) -> tuple[int, np.ndarray, int]:
    """A text's node (a hash of its set of shingles, 0 for none), its distinct shingle hashes in order, and its fingerprint."""
    parts = list(shingles(text, words, seed))
    if not parts:
        return 0, np.zeros(0, np.uint64), 0
    distinct = np.unique(np.concatenate(parts).astype(np.uint64))
    return _signed(xxhash.xxh64_intdigest(distinct.tobytes(), seed)), distinct, majority(parts)


#: Numbers of 64 bits of a set's map, in which every shingle hash marks one bit.
MAP_LONGS = 16


def set_map(distinct: np.ndarray) -> list[int]:
    """The map of a set of shingle hashes: a bit that one map has and another lacks stands for a shingle, at least, that one set has and the other lacks."""
    at = (distinct * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    bits = np.zeros(MAP_LONGS * 64, bool)
    bits[at.astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def can_be_similar(na: Column, a: list[Column], nb: Column, b: list[Column], similarity: float) -> Column:
    """False only for sets that can't reach a Jaccard similarity: by their sizes, and by the bits that one's map has and the other's lacks."""
    lacking = lambda x, y: sum((F.bit_count(i.bitwiseAND(F.bitwise_not(j))) for i, j in zip(x[1:], y[1:], strict=True)), F.bit_count(x[0].bitwiseAND(F.bitwise_not(y[0]))))
    sized = F.least(na, nb) / F.greatest(na, nb) >= similarity
    common = F.least(na - lacking(a, b), nb - lacking(b, a))
    return sized & (common / (na + nb - common) >= similarity)


#: Bits of the map by which texts that meet others are picked before they are dealt out.
MAP_BITS = 1 << 24


def similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5, radius: int = 2,
    bands: int = 24, rows: int = 5, stars: int = 3, seed: int = 42,
) -> DataFrame:
    """(node, component, first) for every distinct set of word shingles: texts linked where the Jaccard similarity is ``similarity`` or more.

    Sets meet that agree in a SimHash fingerprint's bits under a covering mask (all within
    ``radius`` bits), or in a band of ``rows`` smallest hashes; two sets of similarity s meet in no band with
    probability (1 - s^rows)^bands, 7 in 100,000 at 0.8.  Every link is confirmed on the whole sets.  In
    ``stars`` rounds each meeting place compares its members with one of them, first with the one that meets the most texts; then all pairs that meet and aren't yet in
    one component are compared, but for those that sizes and bit maps of the sets show to be less alike: an upper bound of what they share, so that no link is lost.  ``first`` is the component's smallest (no_id, doc_id, text_hash).
    Texts without words are one node.  No rows give no rows.
    """
    masks = covering_masks(radius)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = [], []
            for x in batch.column(2):
                node, distinct, fp = _set_of(x.as_py(), words, seed)
                nodes.append(node)
                places.append(meeting_places(distinct, fp, masks, bands, rows, seed) if len(distinct) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "places"])

    listed = materialise(source.mapInArrow(list_places, f"doc_id {id_type}, text_hash long, node long, places array<long>"), "similar")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    own = materialise(listed.groupBy("node").agg(F.min(who).alias("first")), "similar-distinct")
    at = listed.select("node", F.explode("places").alias("place")).distinct()
    shared = at.groupBy("place").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("place")
    members = materialise(skew_join(at, shared, ["place"]), "similar-members")

    # one text of each member; a map of bits leaves most others out before anything is dealt
    wanted = skew_join(own, members.select("node").distinct(), ["node"]).select(F.xxhash64("first.doc_id", "first.text_hash").alias("h"))
    bit = F.pmod("h", F.lit(MAP_BITS))
    found = wanted.groupBy(F.floor(bit / 8).cast("int").alias("byte")).agg(F.bit_or(F.pow(F.lit(2), bit % 8).cast("int")).alias("bits")).toPandas()
    marks = np.zeros(MAP_BITS // 8, np.uint8)
    marks[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    shared_marks = docs.sparkSession.sparkContext.broadcast(marks)

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((shared_marks.value[b // 8] >> (b % 8).astype(np.uint8)) & 1 == 1))
            sets = [_set_of(x.as_py(), words, seed)[:2] for x in batch.column(1)]
            columns = [pa.array([n for n, _ in sets], pa.int64()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64())), pa.array([set_map(s) for _, s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "set", "map"])

    picked = source.select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(MAP_BITS)).alias("bit"), "text").mapInArrow(read_sets, "node long, set array<long>, map array<long>")
    sets = materialise(skew_join(picked, members.select("node").distinct(), ["node"]).dropDuplicates(["node"]), "similar-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = skew_join(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("x")), ["a"])
        both = skew_join(both, sets.select(F.col("node").alias("b"), F.col("set").alias("y")), ["b"])
        nx, ny, common = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
        both = both.filter(F.least(nx, ny) / F.greatest(nx, ny) >= similarity)
        return both.filter(common / (nx + ny - common) >= similarity).select("a", "b")

    links, root, left = None, None, members.withColumn("component", F.col("node"))
    for turn in range(stars + 1):
        mixed = left.groupBy("place").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
        left = skew_join(left, mixed.select("place", "n"), ["place"])
        if turn == 0:  # the text that meets the most others: copies of one text are more like it than like each other
            met = left.groupBy("node").agg(F.sum("n").alias("met"))
            left = skew_join(left, met, ["node"])
        else:
            left = left.withColumn("met", F.lit(0).cast("long"))
        left = materialise(left.drop("n"), "similar-left")
        rank = F.struct("met", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")
        centres = left.groupBy("place").agg(F.max(rank).alias("centre"))
        left = skew_join(left.drop("met"), centres, ["place"])
        if turn < stars:
            pairs = left.filter(F.col("component") != F.col("centre.component")).select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        else:
            mapped = skew_join(left.select("place", "node", "component"), sets.select("node", F.size("set").alias("n"), *[F.col("map")[i].alias(f"m{i}") for i in range(MAP_LONGS)]), ["node"])
            x, y = (mapped.select("place", *[F.col(c).alias(f"{c}_{side}") for c in mapped.columns if c != "place"]) for side in "ab")
            maps = [[F.col(f"m{i}_{side}") for i in range(MAP_LONGS)] for side in "ab"]
            pairs = x.join(y, "place").filter("component_a < component_b").filter(can_be_similar(F.col("n_a"), maps[0], F.col("n_b"), maps[1], similarity))
            pairs = pairs.withColumnsRenamed({"node_a": "a", "node_b": "b"}).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = materialise(confirmed(pairs.distinct()), "similar-links")
        links = new if links is None else links.unionByName(new)
        root = components(links)
        named = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
        left = skew_join(left.select("place", "node"), named, ["node"], "left").select("place", "node", F.coalesce("root", "node").alias("component"))

    joined = materialise(skew_join(own, named, ["node"], "left").select("node", F.coalesce("root", "node").alias("component"), "first"), "similar-named")
    best = joined.groupBy("component").agg(F.min("first").alias("first"))
    return skew_join(joined.select("node", "component"), best, ["component"]).select("node", "component", "first")


def _keep_first(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each ``first`` (doc_id, text_hash) of ``found``."""
    d, h, own, n = (hidden(x, docs) for x in ("id", "hash", "h", "n"))
    keep = found.select("first").distinct().select(F.col("first.doc_id").alias(d), F.col("first.text_hash").alias(h))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    kept = marked.join(keep.hint("merge"), (F.col(own) == F.col(h)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(d)), "left_semi")
    kept = kept.withColumn(n, F.row_number().over(Window.partitionBy(own, F.col(f"`{doc_id}`")).orderBy(own)))
    return kept.filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every group of near duplicates, with the columns of ``docs``: the one with the smallest id.

    Null ids come last; among rows of that id the smallest text hash stays, and one row of those that repeat both.
    """
    return _keep_first(docs, near_duplicates(docs, doc_id, text, **options), doc_id, text)


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """As ``keep_one``, for the groups of ``similar``."""
    return _keep_first(docs, similar(docs, doc_id, text, **options), doc_id, text)
