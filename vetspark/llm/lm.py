"""Language-model scores by stupid backoff over tables of n-gram counts."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, in_fixed_order, n_words

#: Tokens and documents of a segment, whose n-grams a task holds at a time, and tokens for each hash part of the count table, about.
SEGMENT_TOKENS, SEGMENT_DOCS, PART_TOKENS = 750_000, 100_000, 2_000_000
#: The lowest bits of a segment's number count the pieces of one long text, from 1; 0 stands for whole texts.
PIECE_BITS = 12
#: Stands before a text's first word.
START = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values one to one, so that n-grams are told apart by all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in an ascending array, -1 where it isn't there."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


@dataclass
class Grams:
    """The distinct n-grams of one order in a segment; ``tokens[at[i]:at[i + 1]]`` are the tokens where the i-th ends."""

    order: int
    gram: np.ndarray
    tokens: np.ndarray
    at: np.ndarray


class Segment:
    """Some texts as one row of tokens: for each text that has words START and its words.  ``packed``: texts on lines, words between spaces.

    Or one piece of a long text: ``starts`` with START or with the last ``lead`` words of the piece before, which are contexts and
    count in that piece only; ``ends`` where the text ends.
    """

    def __init__(self, packed: bytes, starts: bool = True, lead: int = 0, ends: bool = True) -> None:
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        place[b""]  # START: no word is empty
        codes, sizes = [], []
        for t in zstandard.decompress(packed).split(b"\n")[:-1]:
            words = t.split(b" ") if t else []
            sizes.append(len(words))
            if words:
                codes.append(np.fromiter(map(place.__getitem__, (b"", *words) if starts else words), np.int32, len(words) + starts))
        self.sizes = np.array(sizes, np.int64)
        held = self.sizes + (starts & (self.sizes > 0))
        self.sizes -= lead
        self.code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        self.hash = _mix(np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place)))
        self.hash[0] = START
        self.doc = np.repeat(np.arange(len(held), dtype=np.int32), held)
        self.place = (np.arange(len(self.code)) - np.repeat(np.cumsum(held) - held, held)).astype(np.int32)
        self.last = np.append(self.place[1:] == 0, ends)[: len(self.code)]
        self.lead = lead
        self.here = np.bincount(self.code[lead:], minlength=len(self.hash))

    def orders(self, highest: int) -> Iterator[Grams]:
        """From 2 up."""
        word = self.hash[self.code]
        gram = word
        for m in range(2, highest + 1):
            gram = _mix(np.roll(gram, 1) * np.uint64(0xD6E8FEB86659FD93) + word)
            tokens = np.flatnonzero(self.place >= m - 1).astype(np.int32)
            own = gram[tokens]
            by = np.argsort(own, kind="stable")
            tokens, own = tokens[by], own[by]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
            yield Grams(m, own[at], tokens, np.append(at, len(own)))

    def counts(self, highest: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each order: n-grams, occurrences, occurrences that a word follows (0 for the highest order, which is no context), texts (2 stands for more)."""
        n = len(self.hash)
        first, last = np.zeros(n, np.int32), np.zeros(n, np.int32)
        first[self.code[::-1]], last[self.code] = self.doc[::-1], self.doc
        here = self.here
        some = slice(None) if here[0] else slice(1, None)
        followed = here - np.bincount(self.code[self.last], minlength=n) if highest > 1 else np.zeros_like(here)
        yield self.hash[some], here[some], followed[some], (1 + (first != last))[some]
        for g in self.orders(highest):
            here = np.diff(np.concatenate(([0], np.cumsum(g.tokens >= self.lead)))[g.at]) if self.lead else np.diff(g.at)
            ends = np.concatenate(([0], np.cumsum(self.last[g.tokens])))[g.at] if g.order < highest else here
            texts = 1 + (self.doc[g.tokens[g.at[:-1]]] != self.doc[g.tokens[g.at[1:] - 1]])
            yield g.gram, here, here - np.diff(ends) if g.order < highest else np.zeros_like(here), texts


def _pieces(text: bytes, tokens: int) -> Iterator[list[bytes]]:
    """The words of a text, ``tokens`` at a time."""
    if len(text) < 2 * tokens:
        yield text.split()
        return
    words = (m.group() for m in re.finditer(WORD.encode(), text))
    while own := list(islice(words, tokens)):
        yield own


def _pack(order: int, tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) as segments: a number of their own, the ids, and the words of the texts, compressed.

    A text of more than ``tokens`` words becomes pieces, a segment each, that begin with the ``order`` - 1 words before them.
    """
    tokens = max(tokens, order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0

        def segment(ids: list[pa.Array], texts: list[bytes], piece: int = 0, ends: bool = True) -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            words = zstandard.compress(b"\n".join(texts) + b"\n", 3)
            number = (task << 24 | count) << PIECE_BITS | piece
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ends]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([words], pa.binary())], names=["segment", "ends", "ids", "words"])

        for b in batches:
            begin = 0
            for i, t in enumerate(b.column(1)):
                pieces = _pieces(t.as_py().encode(), tokens)
                words, more = next(pieces, []), next(pieces, None)
                if texts and (more or held + len(words) > tokens or len(texts) == SEGMENT_DOCS):
                    yield segment([*ids, b.column(0).slice(begin, i - begin)], texts)
                    ids, texts, held, count, begin = [], [], 0, count + 1, i
                if not more:
                    texts.append(b" ".join(words))
                    held += len(words)
                    continue
                piece, lead = 1, []
                while words:
                    yield segment([b.column(0).slice(i, 1)], [b" ".join(lead + words)], piece, not more)
                    piece, lead = piece + 1, words[len(words) - order + 1 :]
                    words, more = more, next(pieces, None)
                count, begin = count + 1, i + 1
            ids.append(b.column(0).slice(begin))
        if texts:
            yield segment(ids, texts)

    return of


def _segment(number: int, ends: bool, words: bytes, order: int) -> Segment:
    piece = number % (1 << PIECE_BITS)
    return Segment(words, piece <= 1, order - 1 if piece > 1 else 0, ends)


def _list(x: np.ndarray, kind: pa.DataType, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x, kind))


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums, modulo 2^64, of the runs of x, none empty, between ascending offsets."""
    return np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)


def _slots(own: Segment, order: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """A segment's n-grams as they are dealt out: slot, the places that it has, and the counts of its order.

    A slot holds those of one order that come once (its number is even), which need no counts, or the others.
    """
    for m, counts in enumerate(own.counts(order), 1):
        once = (counts[1] == 1) & (counts[2] == int(m < order))
        yield 2 * m, np.flatnonzero(once), counts
        yield 2 * m + 1, np.flatnonzero(~once), counts


def _dealt(gram: np.ndarray, places: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by part; the parts that have any, and where each begins."""
    part = (gram[places] % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((gram[places], part))
    there, at = np.unique(part[by], return_index=True)
    return places[by], there, np.append(at, len(by))


def _bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, -1 where one is too large, and the large ones."""
    large = x > 126
    return np.where(large, -1, x).astype(np.int8), x[large]


def _counts(small: pa.ListArray, large: pa.ListArray) -> np.ndarray:
    out = small.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out[out < 0] = large.flatten().to_numpy(zero_copy_only=False)
    return out


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.4, order: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row, by stupid backoff of ``order`` over all ``docs``.

    A word's context are the ``order`` - 1 tokens before it, or as many as there are with the start.  It scores
    count(context and word) / count(context, followed by any word) if two documents or more have the two together; else ``alpha`` times
    the score with a context shorter by one; without context, count(word) / tokens.  Scores are
    natural logarithms, summed over a text.  Words are runs of anything but ASCII white space; n-grams are
    told apart by 64 bits of a hash.

    Every task packs its documents into segments of ``segment_tokens`` words at most; a longer text takes several, each with the words before it as context.  A segment's distinct n-grams, with their counts there, are
    dealt out by hash; exploded and summed they are the count table, partitioned by hash, of the n-grams that two documents share.  In each part
    the table is joined to the segments' n-grams, and the counts go back to the segments, in the order in which the n-grams came, to score their documents.
    Other n-grams have no counts elsewhere.  An n-gram has one row for each segment at most, however often it occurs: a word that all segments hold
    has tokens / ``segment_tokens`` rows in its part.

    Segments are made anew if an executor is lost, so their rows have to come in the same order: rows that come straight from files do, others are
    written first.  A sum of each slot's n-grams goes back with their counts, and a segment whose n-grams aren't those that were counted is an error, never a wrong score.

    Null and empty texts have 0 words, log_score 0 and a null mean.  Every row is a document of its own, also
    if it repeats another's id or text.  No rows give no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = in_fixed_order(rows, "lm-rows")
    tokens = rows.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    parts = max(1, math.ceil(tokens / PART_TOKENS))
    dealt = rows.mapInArrow(_pack(order, segment_tokens), f"segment long, ends boolean, ids array<{id_type}>, words binary").repartition("segment")
    log_alpha, log_tokens = math.log(alpha), math.log(max(tokens, 1))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, ends, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                for slot, places, counts in _slots(_segment(segment, ends, words.as_py(), order), order):
                    places, there, at = _dealt(counts[0], places, parts)
                    columns = [pa.array(np.full(len(there), segment)), pa.array(there), pa.array(np.full(len(there), slot, np.int32)), _list(counts[0][places].view(np.int64), pa.int64(), at)]
                    kept = at if slot % 2 else at * 0
                    yield pa.RecordBatch.from_arrays([*columns, *(_list(x[places[: kept[-1]]], t, kept) for x, t in zip(counts[1:], (pa.int32(), pa.int32(), pa.int8()), strict=True))], names=names)
                pa.default_memory_pool().release_unused()

    names = ["segment", "part", "slot", "gram", "n", "followed", "texts"]
    packed = dealt.mapInArrow(explode, "segment long, part long, slot int, gram array<long>, n array<int>, followed array<int>, texts array<tinyint>").repartition("part")
    ngrams = packed.select("segment", "part", "slot", F.inline(F.arrays_zip("gram", "n", "followed", "texts")))
    usual = (F.col("slot") < 2 * order).cast("int")  # n-grams that come once are followed once, but for the highest order
    sums = {"n": F.lit(1), "followed": usual}
    sums = [F.sum(F.coalesce(c, x)).alias(c) for c, x in sums.items()]
    # every column is used, so that both readers of what is dealt out share one shuffle
    table = ngrams.groupBy("part", "gram").agg(*sums, F.max(F.coalesce("texts", F.lit(1))).alias("texts"), F.min("segment").alias("first"), F.max("segment").alias("last"))
    # texts are whole in a segment, or have all its pieces to themselves
    text = [F.shiftright(c, PIECE_BITS) for c in ("first", "last")]
    # a word of one long text's pieces only isn't shared, but its count is that of all of them
    table = table.withColumn("shared", (F.col("texts") > 1) | (text[0] != text[1])).filter("shared or first != last").select("part", "gram", "n", "followed", "shared")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one part: the counts of the segments' n-grams, in their order, 0 for those that no other document has."""
        gram, n, followed, shared = (right.column(c).to_numpy() for c in ("gram", "n", "followed", "shared"))
        by = np.argsort(gram)
        gram, n, followed, shared = gram[by], n[by], followed[by], shared[by]
        grams = left.column("gram").combine_chunks()
        offsets = grams.offsets.to_numpy()
        own = grams.flatten().to_numpy()
        check = _sums(own, offsets - offsets[0])
        at = _find(gram, own)
        del own
        if not shared.all():
            words = np.repeat(left.column("slot").to_numpy() < 4, np.diff(offsets))
            at = np.where((at >= 0) & (words | shared[at]), at, -1)
        columns = []
        for x in (n, followed):
            small, large = _bytes(np.where(at >= 0, x[at], 0) if len(x) else np.zeros(len(at), np.int64))
            columns += [_list(small, pa.int8(), offsets - offsets[0]), _list(large, pa.int64(), np.concatenate(([0], np.cumsum(small < 0)))[offsets - offsets[0]])]
        return pa.Table.from_arrays([left.column("segment"), left.column("part"), left.column("slot"), pa.array(check), *columns], names=["segment", "part", "slot", "check", "n", "n_large", "followed", "followed_large"])

    back = packed.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(look_up, "segment long, part long, slot int, check long, n array<tinyint>, n_large array<long>, followed array<tinyint>, followed_large array<long>")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        segment, ends, words = (left.column(c)[0].as_py() for c in ("segment", "ends", "words"))
        own = _segment(segment, ends, words, order)
        right = right.sort_by([("slot", "ascending"), ("part", "ascending")]).combine_chunks()
        pa.default_memory_pool().release_unused()
        slots = right.column("slot").to_numpy()
        shared: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each order
        for slot, places, counts in _slots(own, order):
            n, followed = shared.setdefault(slot // 2, (np.zeros(len(counts[0]), np.int64), np.zeros(len(counts[0]), np.int64)))
            begin, end = np.searchsorted(slots, (slot, slot + 1))
            some = right.slice(begin, end - begin)
            places, there, at = _dealt(counts[0], places, parts)
            if not np.array_equal(some.column("part").to_numpy(), there) or not np.array_equal(some.column("check").to_numpy(), _sums(counts[0][places].view(np.int64), at)):
                raise RuntimeError("a segment's texts aren't those whose n-grams were counted: the rows changed or came in another order when a task ran again; write them first")
            for x, c in ((n, "n"), (followed, "followed")):
                if len(places):
                    x[places] = _counts(*(some.column(k).chunk(0) for k in (c, f"{c}_large")))
        here = own.here
        words = slice(None) if here[0] else slice(1, None)
        count = here.copy()
        count[words] = np.where(shared[1][0] > 0, shared[1][0], here[words])
        backed = np.minimum(own.place, order - 1)  # orders above the first that a token has
        value = backed * log_alpha + (np.log(np.maximum(count, 1)) - log_tokens)[own.code]
        below, below_of = shared[1][1], own.code - (0 if here[0] else 1)  # how often a token's n-gram of the order below is followed
        for g in own.orders(order):
            n, followed = shared[g.order]
            times = np.diff(g.at)
            hit = np.flatnonzero(n)
            context = below_of[g.tokens[g.at[hit]] - 1]
            where = g.tokens[np.repeat(n > 0, times)]
            value[where] = np.repeat(np.log(n[hit]) - np.log(below[context]), times[hit]) + (backed[where] - (g.order - 1)) * log_alpha
            below, below_of = followed, np.full(len(own.code), -1)
            below_of[g.tokens] = np.repeat(np.arange(len(times)), times)
        value[own.code == 0] = 0  # START
        value[: own.lead] = 0
        total = np.bincount(own.doc, value, minlength=len(own.sizes)).astype(np.float64)
        places = pa.array(np.arange(len(total), dtype=np.int32))
        text = pa.array(np.full(len(total), segment >> PIECE_BITS))
        return pa.Table.from_arrays([text, places, left.column("ids").combine_chunks().flatten(), pa.array(own.sizes), pa.array(total)], names=names_out)

    names_out = ["text", "place", "doc_id", "n_words", "log_score"]
    types = [pa.int64(), pa.int32(), to_arrow_type(rows.schema["doc_id"].dataType), pa.int64(), pa.float64()]
    none = pa.table([pa.array([], t) for t in types], names=names_out)
    scored = dealt.groupBy("segment").cogroup(back.groupBy("segment")).applyInArrow(score, f"text long, place int, doc_id {id_type}, n_words long, log_score double")
    # pieces of a long text are put together; all other rows are alone
    whole = scored.groupBy("text", "place").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score")
    return whole.select("doc_id", "n_words", "log_score", mean)
