"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

:mod:`.bpe` encodes by a trie of distinct words and follows a tokenizer file with special tokens; here the ranks of a
vocabulary are compiled into a machine that reads bytes and writes tokens, as the rank-file libraries encode.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import bpe
from .common import tokenizer_file

#: Letters and numbers that Unicode 16 added to 15.1, first and last code point of each range.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: White space of Unicode, first and last code point of each range.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: What follows an apostrophe in the contractions of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters that are cut into words together; what a worker keeps at most: the machine's states, its readings' moves, words with their tokens; tokens decoded at a time.
TOGETHER, STATES, MOVES, WORDS, TOKENS = 1_000_000, 220_000, 700_000, 450_000, 65_536
#: Marks of words that were read before: a word is kept from its second reading on, so that words that come once don't fill the memory.
MARKS = 1 << 23


@cache
def classes() -> np.ndarray:
    """The class of every code point: other, letter, number or white space."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, value in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE, SPACE)):
        for first, last in ranges:
            out[first : last + 1] = value
    return out


def word_starts(text: str, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of several joined texts start, and where runs of letters, numbers or others do.

    ``borders``: where each text, never an empty one, starts.  A word is what a match of the vocabulary's pattern takes: a contraction, or a
    run of letters, numbers or other characters with the space before it, or white space: all of a run at a text's end, else all but its last
    character, which stands alone if it isn't a space.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    n = len(code)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[borders] = True
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[borders] = first_of_text[n] = True
    starts = np.zeros(n + 1, bool)
    run = np.flatnonzero(new)
    white = kind[run] == SPACE
    end = np.append(run[1:], n)
    starts[run[white]] = True
    inner = end[white & ~first_of_text[end]] - 1  # the last character of white space before something else
    starts[inner] = True
    solid = run[~white]
    joined = (solid > 0) & (code[np.maximum(solid, 1) - 1] == 32) & ~first_of_text[solid]
    starts[solid[~joined]] = True
    quote = solid[~joined & (code[solid] == 39)]
    rest = {c: np.array([*map(ord, c)], np.uint32) for c in CONTRACTIONS}
    for letters in rest.values():
        last = quote + len(letters)
        fits = last < n
        for i, c in enumerate(letters, 1):
            at = np.minimum(quote + i, n - 1)
            fits &= (code[at] == c) & ~first_of_text[at]
        starts[quote[fits] + 1] = False
        starts[last[fits] + 1] = True
    return np.flatnonzero(starts[:n]), solid


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``TOGETHER`` characters, cut where a word starts whatever follows, and not after white space, whose words depend on what follows."""
    at = 0
    while len(text) - at > TOGETHER:
        size, cut = TOGETHER, 0
        while not cut and at + size < len(text):
            words, solid = word_starts(text[at : at + size], np.zeros(1, np.int64))
            sure = words[words <= solid[-1]].tolist() if len(solid) else []
            cut = next((w for w in reversed(sure) if w and classes()[ord(text[at + w - 1])] != SPACE), 0)
            size *= 2
        if not cut:
            break
        yield text[at : at + cut]
        at += cut
    if at < len(text):
        yield text[at:]


class Merges(bpe.Bpe):
    """Which tokens can stand next to each other, from ranks alone: a token comes from the one pair of earlier tokens that can stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.made, self.merge, self.spines, self.fitting = {}, {}, ({}, {}), {}
        for t, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i], rank), ranks.get(t[i:], rank)
                if a < rank and b < rank and self.fits(a, b):
                    self.made[rank], self.merge[a << 32 | b] = (rank, a, b), rank
                    break
            self.fitting.clear()  # the next token's pairs may be judged otherwise once this one is made


class Transducer:
    """Reads bytes, writes the tokens of their encoding.

    Undetermined, a state is (the last token written, a place in the trie of tokens): reading a byte goes down the trie, and where a token ends
    there that can follow the last one, it may be written.  Of a prefix's readings exactly one ends in a token.  Determinised, a state is the
    set of readings that still go on, each with the tokens that it has written and the others haven't; what all have
    written is put out, so that a token comes once no reading doubts it, which is bounded by how long tokens are.  States
    and steps are made when they are first needed.  Beyond ``STATES`` all are forgotten but the current one, which costs time only.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        merges = Merges(ranks)
        self.ranks, self.fits = ranks, merges.fits
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t, rank in ranks.items():
            if len(t) > 1 and rank not in merges.made:
                continue  # no merge makes it: only a word that is this token comes out as it
            node = 0
            for byte in t:
                if (down := self.child.get(node << 8 | byte)) is None:
                    down = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = down
            self.token[node] = rank
        self.words: dict[str, tuple[int, ...]] = {}
        self.marks = bytearray(MARKS)
        self.moves: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._forget()

    def _forget(self) -> None:
        for known in (self.states, self.number, self.steps):
            known.clear()
        self.start = self._state(((0, ()),))

    def _state(self, readings: tuple) -> int:
        if (found := self.number.get(readings)) is None:
            found = self.number[readings] = len(self.states)
            self.states.append(readings)
        return found

    def _move(self, place: int, byte: int) -> tuple[int, int]:
        """Where a reading goes, and the token that it may write there, -1 where neither is; ``place`` is the last token, plus one, and the node."""
        last, node = place >> 24, place & 0xFFFFFF
        on = t = -1
        if (down := self.child.get(node << 8 | byte)) is not None:
            if self.inner[down]:
                on = last << 24 | down
            t = self.token[down]
            if t >= 0 and last and not self.fits(last - 1, t):
                t = -1
        if len(self.moves) >= MOVES:
            self.moves.clear()
        self.moves[place << 8 | byte] = on, t
        return on, t

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        readings = self.states[state]
        if len(self.states) >= STATES:
            self._forget()
            state = self._state(readings)
        done, on, get = None, [], self.moves.get
        for place, ahead in readings:
            down, t = get(place << 8 | byte) or self._move(place, byte)
            if t >= 0 and done is None:
                done = (t + 1 << 24, (*ahead, t))
            if down >= 0:
                on.append((down, ahead))
        if done is None:
            raise ValueError("the vocabulary lacks a byte")
        on.append(done)
        sure: tuple[int, ...] = ()
        if on[0][1]:  # else the oldest reading hasn't written what the others have
            low, high, n = min(x[1] for x in on), max(x[1] for x in on), 0
            while n < len(low) and low[n] == high[n]:
                n += 1
            if n:
                sure, on = low[:n], [(place, ahead[n:]) for place, ahead in on]
        made = self.steps[state << 8 | byte] = self._state(tuple(on)), sure
        return made

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word; a word that is a token is that token, as in the rank-file libraries."""
        state, out, get = self.start, [], self.steps.get
        for byte in word:
            state, sure = get(state << 8 | byte) or self._step(state, byte)
            if sure:
                out += sure
        out += self.states[state][-1][1]  # the reading that ends in a token comes last
        if len(out) > 1 and word in self.ranks:
            return [self.ranks[word]]
        return out

    def encode_words(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        """The tokens of words, each read by the machine unless it is one of the first ``WORDS`` that this worker has read twice."""
        known, marks, out = self.words, self.marks, []
        for w in words:
            if (found := known.get(w)) is None:
                found = tuple(self.encode(w.encode("utf-8", "surrogatepass")))
                if len(known) < WORDS and len(w) < 100:
                    if marks[at := hash(w) % MARKS]:
                        known[w] = found
                    marks[at] = 1
            out.append(found)
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], …, starts[0] + sizes[0] - 1, starts[1], …"""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode_together(machine: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, how many each has); each distinct word goes through the machine once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.any():
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    text = "".join(texts)
    first = np.cumsum(sizes) - sizes
    at, _ = word_starts(text, first[sizes > 0])
    cut = [*at.tolist(), len(text)]
    place: defaultdict[str, int] = defaultdict()
    place.default_factory = place.__len__
    words = np.fromiter(map(place.__getitem__, [text[a:b] for a, b in pairwise(cut)]), np.int32, len(at))
    found = machine.encode_words(place)
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
    sized = n[words]
    tokens = flat[spread((np.cumsum(n) - n)[words], sized)]
    before = np.append(0, np.cumsum(sized))
    return tokens, np.diff(before[np.searchsorted(at, np.append(first, len(text)))])


def encode_texts(machine: Transducer, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(how many texts, their tokens, how many each has), in order, for a bounded number of characters at a time; a long text comes alone."""
    group: list[str] = []
    held = 0
    for t in texts:
        if group and held + len(t) > TOGETHER:
            yield len(group), *encode_together(machine, group)
            group, held = [], 0
        if len(t) > TOGETHER:
            tokens = np.concatenate([encode_together(machine, [p])[0] for p in pieces(t)])
            yield 1, tokens, np.array([len(tokens)])
        else:
            group.append(t)
            held += len(t)
    if group:
        yield len(group), *encode_together(machine, group)


# ---------------------------------------------------------------- decoding

#: Fixed values, the ranges of well-formed UTF-8: (first and last lead byte, first and last byte after it, bytes still due after that one).
UTF8 = [(0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1), (0xEE, 0xEF, 0x80, 0xBF, 1),
        (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2)]
BAD = -1


@cache
def utf8_machine() -> list[list[int]]:
    """Steps of the machine: by state and byte the next state.  State 0 is between characters; states 1 and 2 await as many bytes of any
    value; the others await a lead byte's first follower."""
    table = [[*range(128)] for _ in range(3 + len(UTF8))]
    for row in table:
        row[:] = [BAD] * 256
    table[0][:128] = [0] * 128
    for due in (1, 2):
        table[due][0x80:0xC0] = [due - 1] * 64
    for state, (first, last, low, high, due) in enumerate(UTF8, 3):
        table[0][first : last + 1] = [state] * (last + 1 - first)
        table[state][low : high + 1] = [due] * (high + 1 - low)
    return table


class Utf8Stream:
    """Text of bytes that come in parts: what a part leaves unfinished waits for the next; ill-formed bytes become U+FFFD, as Python's ``replace`` does."""

    def __init__(self) -> None:
        self.waiting, self.well_formed = b"", True

    def _text(self, data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            self.well_formed = False
            return data.decode("utf-8", "replace")

    def feed(self, part: bytes) -> str:
        data, table = self.waiting + part, utf8_machine()
        self.waiting = b""
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character is at most three bytes, from its lead byte on
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[-back:]:
                    state = table[state][byte] if state != BAD else BAD
                if state > 0:
                    self.waiting, data = data[-back:], data[:-back]
                break
        return self._text(data)

    def finish(self) -> str:
        """The text of what is still waiting, which no byte follows."""
        data, self.waiting = self.waiting, b""
        return self._text(data)


def decode_ids(bytes_of: list[bytes | None], ids: list[int]) -> tuple[str, bool]:
    """(text, whether its bytes were well-formed) of one row's ids, some at a time; an id that the vocabulary lacks raises."""
    stream, out = Utf8Stream(), []
    for at in range(0, len(ids), TOKENS):
        out.append(stream.feed(b"".join(map(bytes_of.__getitem__, ids[at : at + TOKENS]))))
    out.append(stream.finish())
    return "".join(out), stream.well_formed


# ---------------------------------------------------------------- on tables


def read_ranks(file: str) -> dict[bytes, int]:
    """Token bytes and ranks, from the text of a rank file: a token in base 64, a blank and its rank on each line."""
    return {base64.b64decode(t): int(rank) for t, rank in (line.split() for line in file.splitlines() if line.strip())}


class _Vocabulary:
    """The rank file, a fixed text of a few MB, for all workers; each worker reads and compiles it once, and only as far as it needs it."""

    _ranks: dict[int, dict[bytes, int]] = {}
    _machine: dict[int, Transducer] = {}
    _bytes: dict[int, list[bytes | None]] = {}

    def __init__(self, df: DataFrame, path: str) -> None:
        with open(path, encoding="ascii") as f:
            text = f.read()
        self.key, self.text = hash(text), df.sparkSession.sparkContext.broadcast(text)

    def _once(self, known: dict, make):
        if self.key not in known:
            known.clear()
            known[self.key] = make()
        return known[self.key]

    def ranks(self) -> dict[bytes, int]:
        return self._once(_Vocabulary._ranks, lambda: read_ranks(self.text.value))

    def machine(self) -> Transducer:
        return self._once(_Vocabulary._machine, lambda: Transducer(self.ranks()))

    def bytes_of(self) -> list[bytes | None]:
        def make() -> list[bytes | None]:
            out: list[bytes | None] = [None] * (max(self.ranks().values(), default=-1) + 1)
            for t, rank in self.ranks().items():
                out[rank] = t
            return out

        return self._once(_Vocabulary._bytes, make)


def _encoded(vocabulary: _Vocabulary, batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches (doc_id, text), a bounded number of characters at a time."""
    machine = vocabulary.machine()
    for batch in batches:
        at = 0
        for n, tokens, sizes in encode_texts(machine, (x.as_py() or "" for x in batch.column(1))):
            if packed:
                offsets = np.append(0, np.cumsum(sizes * 4)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(tokens.astype("<u4"))])
            else:
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(tokens.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids], names=["doc_id", "ids"])
            at += n


def _decoded(vocabulary: _Vocabulary, column: pa.Array) -> list[pa.Array]:
    """(texts, whether their bytes were well-formed) of ids, packed or as lists."""
    texts, fine, bytes_of = [], [], vocabulary.bytes_of()
    for x in column:
        if not x.is_valid:
            own = []
        elif pa.types.is_binary(x.type):
            own = np.frombuffer(x.as_buffer(), "<u4").tolist()
        else:
            own = x.values.to_numpy(zero_copy_only=False).tolist()
        text, ok = decode_ids(bytes_of, own)
        texts.append(text)
        fine.append(ok)
    return [pa.array(texts, pa.string()), pa.array(fine, pa.bool_())]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, packed: bool = False) -> DataFrame:
    """(doc_id, ids) for every row: the whole text's tokens; null and empty texts have none.

    ``ranks``: path, on the driver, of a rank file; the public 50k one if none.  Words are cut by the pattern of that vocabulary and encoded
    each by itself; there are no special tokens.  ``ids`` is array<int> or, if ``packed``, binary: little-endian unsigned 32-bit
    integers, as training shards hold them.  Texts are taken a million characters at a time, long ones in pieces that are cut between words, so that memory
    doesn't grow with a text beyond the text and its tokens.  Repeated rows and ids stay as they are, null ids too; other columns are ignored; no rows give no rows.
    """
    vocabulary, rows = _Vocabulary(docs, ranks or tokenizer_file("byte_bpe_50k.tiktoken")), _rows(docs, doc_id, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}"
    return rows.mapInArrow(lambda batches: _encoded(vocabulary, batches, packed), schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Adds ``out``, the text of each row's ids, and ``<out>_well_formed``, whether their bytes were UTF-8; ill-formed bytes become U+FFFD.

    ``ids`` is an array or packed, as :func:`encode` makes them; null ids give an empty text.
    """
    vocabulary = _Vocabulary(encoded, ranks or tokenizer_file("byte_bpe_50k.tiktoken"))
    at = encoded.columns.index(ids)
    schema = StructType([*encoded.schema.fields, StructField(out, StringType()), StructField(f"{out}_well_formed", BooleanType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, *_decoded(vocabulary, batch.column(at))], names=schema.names)

    return encoded.mapInArrow(of, schema)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded, decoded_well_formed): every text encoded, packed, and its ids decoded again, in one worker."""
    vocabulary, rows = _Vocabulary(docs, ranks or tokenizer_file("byte_bpe_50k.tiktoken")), _rows(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _encoded(vocabulary, batches, packed=True):
            yield pa.RecordBatch.from_arrays([*b.columns, *_decoded(vocabulary, b.column(1))], names=["doc_id", "ids", "decoded", "decoded_well_formed"])

    return rows.mapInArrow(of, f"doc_id {kind}, ids binary, decoded string, decoded_well_formed boolean")
