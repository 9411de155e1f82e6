"""Spelling variants: words that differ by one letter, grouped under the commonest form.

Letters are reduced to a few symbols, so that words one edit apart have reduced words at most one edit apart; the whole one-edit
neighbourhood of every reduced word meets the reduced vocabulary, and what meets is verified on the words themselves.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join
from .fst import spread

#: Distinct words that a worker counts before it hands them on; characters, and neighbours, that are worked on together.
HELD, TOGETHER, NEIGHBOURS = 200_000, 1_000_000, 500_000
#: One in so many runs loses a letter.
EVERY = 97
#: Latin-1 bytes of runs, A-Z lower-cased; all others are blanks.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Any odd numbers; a reduced word's code is its symbols' sum, each times a power of the first.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def shortened(run: bytes, h: int) -> bytes:
    """A run, in Latin-1, without the letter that ``h`` picks."""
    k = h % len(run)
    return run[:k] + run[k + 1 :]


class _Counter:
    """Counts the words of texts; ``every`` 0 leaves all runs as they are."""

    def __init__(self, every: int) -> None:
        self.every = every
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[bytes, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.n = np.zeros(0, np.int64)
        self.crc: list[int] = []
        self.size: list[int] = []

    def _add(self, at: np.ndarray) -> None:
        more = np.bincount(at, minlength=len(self.n))
        more[: len(self.n)] += self.n
        self.n = more

    def count(self, ids: list[str], texts: list[str]) -> None:
        """Count some texts.  The checksum of id and run is that of the id, carried over as many zeros as the run is long, changed by the run's own."""
        words = [t.encode("latin-1", "replace").translate(RUNS).split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.place[w] for own in words for w in own), np.int64, int(n.sum()))
        if not self.every or not len(at):
            return self._add(at)
        for w in [*self.place][len(self.crc) :]:
            utf8 = w if w.isascii() else w.decode("latin-1").encode()
            self.crc.append(zlib.crc32(utf8))
            self.size.append(len(utf8))
        size = np.array(self.size, np.int64)[at]
        doc = np.repeat(np.arange(len(texts)), n)
        most = int(size.max()) + 1
        pairs, which = np.unique(doc * most + size, return_inverse=True)
        heads = [zlib.crc32(f"{i}:".encode()) for i in ids]
        zeros = [bytes(k) for k in range(min(most, 100))]
        carried = np.fromiter((zlib.crc32(z := zeros[k] if k < len(zeros) else bytes(k), heads[d]) ^ zlib.crc32(z) for d, k in (divmod(p, most) for p in pairs.tolist())), np.int64, len(pairs))
        h = carried[which] ^ np.array(self.crc, np.int64)[at]
        cut = np.flatnonzero(h % self.every == 0)
        runs = [w for own in words for w in own] if len(cut) else []
        for i in cut.tolist():
            at[i] = self.place[shortened(runs[i], int(h[i]))]
        for w in [*self.place][len(self.crc) :]:
            utf8 = w if w.isascii() else w.decode("latin-1").encode()
            self.crc.append(zlib.crc32(utf8))
            self.size.append(len(utf8))
        self._add(at)

    def take(self, least: int) -> pa.RecordBatch:
        """(word, n) of the words of ``least`` letters or more that were counted; starts anew."""
        found = [(w.decode("latin-1"), n) for w, n in zip(self.place, self.n.tolist(), strict=True) if n and len(w) >= least]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])


def _texts(text: str) -> Iterator[str]:
    """A long text in pieces that end where no run does."""
    at = 0
    while len(text) - at > TOGETHER:
        end = at + TOGETHER
        while end < len(text) and (text[end - 1].isalpha() or "À" <= text[end - 1] <= "ÿ"):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, every: int = EVERY) -> DataFrame:
    """(word, n): how often each word of ``least`` letters or more stands in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Where ``every`` divides the CRC-32 h of ``<doc_id>:<run>``, the run
    loses its letter number h modulo its length, which plants misspellings; 0 plants none.  Null texts have no words; a null id
    counts as an empty one; repeated rows count as often as they come.  Tasks count before anything is shuffled.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, ids, texts, held = _Counter(every), [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in _texts(t.as_py()):
                    ids.append(i)
                    texts.append(piece)
                    held += len(piece)
                    if held >= TOGETHER:
                        counter.count(ids, texts)
                        ids, texts, held = [], [], 0
                        if len(counter.place) >= HELD:
                            yield counter.take(least)
        counter.count(ids, texts)
        yield counter.take(least)

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: DataFrame) -> np.ndarray:
    """How often each Latin-1 letter stands in the words of a vocabulary, each word once: 256 numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n)], names=["letter", "n"])

    out = np.zeros(256, np.int64)
    for r in words.select("word").mapInArrow(of, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        out[r.letter] = r.n
    return out


def letter_symbols(symbols: int, counts: np.ndarray) -> np.ndarray:
    """The symbol, from 1, of every Latin-1 letter: common letters first, each to the symbol that the fewest letters of the vocabulary have so far."""
    out, load = np.ones(256, np.uint64), [0] * symbols
    for letter in sorted(range(256), key=lambda c: (-int(counts[c]), c)):
        s = min(range(symbols), key=lambda k: (load[k], k))
        load[s] += int(counts[letter]) + 1
        out[letter] = s + 1
    return out


def mixed(code: np.ndarray) -> np.ndarray:
    """Codes of any reduced words, spread evenly, as signed numbers."""
    code = (code ^ code >> np.uint64(31)) * np.uint64(MIX)
    return (code ^ code >> np.uint64(29)).view(np.int64)


class _Reduced:
    """Reduced words of a batch, end to end: ``symbol`` of each letter, ``before`` and ``total`` the sums of a word's symbols times their powers."""

    def __init__(self, words: list[str], table: np.ndarray) -> None:
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.symbol = table[letters]
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(letters)) - self.start[self.word]
        power = np.full(int(self.size.max(initial=0)) + 2, BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        sums = np.append(np.uint64(0), np.cumsum(self.symbol * self.power[self.at]))
        self.before = sums[:-1] - sums[self.start[self.word]]
        self.total = sums[self.start + self.size] - sums[self.start]
        self.first = self.at == 0
        self.last = np.append(np.uint64(0), self.symbol[:-1])
        self.last[self.first] = 0

    def neighbours(self, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word's place, code): each word's reduced word itself and all its distinct one-edit neighbours, each once."""
        every, up = np.arange(len(self.size)), np.uint64(BASE)
        down = np.uint64(pow(BASE, -1, 1 << 64))
        total, at = self.total[self.word], self.power[self.at]
        yield every, self.total
        gone = self.symbol != self.last  # of a run of one symbol the first goes
        yield self.word[gone], (self.before + (total - self.before - self.symbol * at) * down)[gone]
        shifted = self.before + (total - self.before) * up
        for c in range(1, symbols + 1):
            c = np.uint64(c)
            other = self.symbol != c
            yield self.word[other], (total + (c - self.symbol) * at)[other]
            new = self.last != c  # before a run of the same symbol, not inside it
            yield self.word[new], (shifted + c * at)[new]
            end = np.full(len(self.size), True)
            end[self.word[self.at == self.size[self.word] - 1]] = self.symbol[self.at == self.size[self.word] - 1] != c
            yield every[end], (self.total + c * self.power[self.size])[end]


def reduced_codes(words: DataFrame, table: np.ndarray) -> DataFrame:
    """(code, word, n) of rows (word, n): the code of each word's reduced word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = mixed(_Reduced(b.column(0).to_pylist(), table).total)
            yield pa.RecordBatch.from_arrays([pa.array(codes), b.column(0), b.column(1)], names=["code", "word", "n"])

    return words.select("word", "n").mapInArrow(of, "code long, word string, n long")


def neighbour_codes(words: DataFrame, symbols: int, table: np.ndarray) -> DataFrame:
    """(code, id) of rows (id, word): the codes of the whole one-edit neighbourhood of each word's reduced word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
            at = 0
            while at < len(own):
                to, held = at, 0
                while to < len(own) and (to == at or held < NEIGHBOURS // symbols):
                    held += len(own[to])
                    to += 1
                for place, code in _Reduced(own[at:to], table).neighbours(symbols):
                    for k in range(0, len(place), NEIGHBOURS):
                        yield pa.RecordBatch.from_arrays([pa.array(mixed(code[k : k + NEIGHBOURS])), pa.array(ids[at:to][place[k : k + NEIGHBOURS]])], names=["code", "id"])
                at = to

    return words.select("id", "word").mapInArrow(of, "code long, id long")


def symbols_for(n_words: int) -> int:
    """How many symbols letters are reduced to: so many that words of seven letters have more reduced words than there are words."""
    return max(4, math.ceil(max(n_words, 1) ** (1 / 7)))


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, near, near_n): every two words of ``words`` (id, word, n; distinct words) that differ by exactly one inserted, deleted or replaced letter, both ways.

    Letters are shared out so that each symbol is about as common as any other, and few words meet by chance.
    A neighbour's code comes once for each word, and a word has one code, so every pair comes once.
    """
    table = letter_symbols(symbols, letter_counts(words))
    near = reduced_codes(words, table).select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = neighbour_codes(words, symbols, table).join(near.hint("shuffle_hash"), "code").drop("code")
    own = words.select("id", "word", "n")
    return met.join(own.hint("shuffle_hash"), "id").filter((F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where following forms from a word ends.

    Reach doubles each round: a word's end so far is replaced by that one's end so far.  Forms never form rings.
    """
    ends = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        further = materialise(skew_join(ends, on, ["root"], "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "forms", ends)
        moved = further.filter("moved").limit(1).count()
        ends = further
        if not moved:
            return further.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, seen: int = 3, times: int = 2, every: int = EVERY, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``least`` letters or more that stands ``seen`` times or more in all texts.

    ``n_near``: how many words are one letter away; ``form``: the commonest of them (ties: the smallest by code points), if it is ``times`` times as
    common as the word or more, else null, as is ``form_n``; ``root``: where forms lead from the word in the end, the word itself if it has none.  Words as in :func:`word_counts`.

    ``symbols``: how many letters are reduced to, any number gives the same rows; by the vocabulary's size if none.  A word's neighbourhood is worked out in pieces,
    so that very long words cost time in proportion.  No texts, or none with such words, give no rows; other columns are ignored.
    """
    counted = word_counts(docs, doc_id, text, least, every).filter(F.col("n") >= seen)
    words = materialise(counted.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_words(words, symbols or symbols_for(words.count()))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = skew_join(words.select("word", "n"), best, ["word"], "left")
    common = -F.col("best.less") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    known = materialise(known, "near", words)
    roots = follow(known.filter("form is not null"))
    return skew_join(known, roots, ["word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
