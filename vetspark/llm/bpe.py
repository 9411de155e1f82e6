"""Byte-level BPE: encoding by a trie of distinct words, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import tokenizer_file

#: The pattern by which this kind of tokenizer cuts texts into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks of text, and pairs of tokens, that a worker keeps at most; others are worked out again, which costs time only.
KEPT_CHUNKS, KEPT_PAIRS = 400_000, 300_000
#: Marks of chunks seen before: a chunk is kept from its second batch on, so that words that come once don't fill the memory.
MARKS = 1 << 23
NEVER = 1 << 60


def byte_of_char() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary, read from the JSON text of a tokenizer file.

    A token sequence is the encoding of its bytes if and only if every two
    neighbours encode to themselves.  So a prefix's last token is the one that ends
    it and fits the last token of what is before it, and that is all a trie node holds.
    """

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        vocab, back = d["model"]["vocab"], byte_of_char()
        raw = {t: bytes(back[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes_of = {i: raw[t] for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.id_of = {raw[t]: i for t, i in vocab.items()}
        # lengths of the tokens that end in up to three given bytes, long ones first
        ends: dict[bytes, set[int]] = {}
        for t in self.id_of:
            ends.setdefault(t[-3:], {1, 2}).add(len(t))
        self.lengths = {e: tuple(sorted(x, reverse=True)) for e, x in ends.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        self.merge = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = {vocab[a + b]: (k, vocab[a], vocab[b]) for k, (a, b) in reversed([*enumerate(pairs)])}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fitting: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.marks = bytearray(MARKS)

    def spine(self, side: int, token: int) -> list[int]:
        """The tokens at a token's left (0) or right (1) edge from the byte up, each followed by the rank of the merge that ends it."""
        if (found := self.spines[side].get(token)) is None:
            found, end, x = [], NEVER, token
            while x in self.made:
                found += [end, x]
                end, x = self.made[x][0], self.made[x][1 + side]
            found = self.spines[side][token] = [*reversed([*found, end, x])]
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to a, b: no merge across the edge comes first."""
        if (found := self.fitting.get(a << 32 | b)) is not None:
            return found
        right, left, merge, i, j, ok = self.spine(1, a), self.spine(0, b), self.merge.get, 0, 0, True
        while True:
            x_ends, y_ends = right[i + 1], left[j + 1]
            rank = merge(right[i] << 32 | left[j], NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:  # of equal merges the left one comes first
                ok = False
                break
            if x_ends == y_ends == NEVER:
                break
            if x_ends <= y_ends:
                i += 2
            else:
                j += 2
        if len(self.fitting) < KEPT_PAIRS:
            self.fitting[a << 32 | b] = ok
        return ok

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words: in sorted order they are the leaves of their trie, depth first.

        ``last`` and ``start`` hold, for each byte of the path to the current
        word, the last token of the prefix that ends there and where it begins;
        the next word keeps what it shares with this one.
        """
        path, last, start, found = b"", [0], [0], {}
        get, fits, lengths, fitting = self.id_of.get, self.fits, self.lengths.get, self.fitting.get
        for b, w in sorted((w.encode(), w) for w in words):
            n, same, top = len(b), 0, min(len(b), len(path))
            while same < top and b[same] == path[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :]
            for i in range(same + 1, n + 1):
                for size in lengths(b[i - 3 : i] if i > 2 else b[:i], (2, 1)):
                    j = i - size
                    if j < 0 or (t := get(b[j:i])) is None:
                        continue
                    ok = j == 0 or fitting(last[j] << 32 | t)
                    if ok or ok is None and fits(last[j], t):
                        last.append(t)
                        start.append(j)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, at, ids = b, n, []
            while at:
                ids.append(last[at])
                at = start[at]
            found[w] = tuple(reversed(ids))
        return found

    def _sections(self, text: str) -> list[str | list[str]]:
        """A text as special tokens and lists of words, by the pattern as a whole."""
        own, at = [], 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            own += [WORDS.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return [*own, WORDS.findall(text[at:])]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; strings of special tokens are those tokens.

        A text is cut at its spaces.  Where no chunk is empty, begins or ends
        with white space, no word of the pattern reaches over a cut, so that each
        distinct chunk is cut into words and encoded once.  Other texts go through the pattern as a whole.
        Chunks that come in a second batch are kept for later ones, up to ``KEPT_CHUNKS``.
        """
        parts = [t.split(" ") if t and not (self.split_special and self.split_special.search(t)) else None for t in texts]
        kept, marks = self.chunks, self.marks
        new = set(chain.from_iterable(p[1:] for p in parts if p)).difference(kept)
        odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        new -= odd
        cut = {c: (" " + c,) if c.isascii() and c.isalpha() else WORDS.findall(" " + c) for c in new}
        whole = [not p or p[0] == "" or p[0][-1].isspace() or bool(odd) and not odd.isdisjoint(p[1:]) for p in parts]
        first = [self._sections(t or "") if w else [WORDS.findall(p[0])] for t, p, w in zip(texts, parts, whole, strict=True)]
        loose = (w for own in first for x in own if isinstance(x, list) for w in x)
        learnt = self.learn({*chain.from_iterable(cut.values()), *loose})
        kept.update((c, learnt[w[0]] if len(w) == 1 else tuple(chain.from_iterable(map(learnt.__getitem__, w)))) for c, w in cut.items())
        get, out = kept.__getitem__, []
        for own, p, w in zip(first, parts, whole, strict=True):
            ids = chain.from_iterable(chain.from_iterable(map(learnt.__getitem__, x)) if isinstance(x, list) else (self.special[x],) for x in own)
            out.append(np.fromiter(ids if w else chain(ids, chain.from_iterable(map(get, p[1:]))), np.int32))
        for c in new:
            at = hash(c) % MARKS
            if not marks[at] or len(kept) > KEPT_CHUNKS:
                marks[at] = 1
                del kept[c]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def _loaded(spec) -> Bpe:
    """One vocabulary per worker, from the broadcast text of its file."""
    if spec.id not in _LOADED:
        _LOADED.clear()
        _LOADED[spec.id] = Bpe(spec.value)
    return _LOADED[spec.id]


class _Spec:
    def __init__(self, broadcast, key: int) -> None:
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> str:
        return self.broadcast.value


def _share(df: DataFrame, path: str) -> _Spec:
    """The tokenizer file, a fixed text of a few MB, for all workers."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return _Spec(df.sparkSession.sparkContext.broadcast(spec), hash(spec))


#: Characters of text that a worker holds as words at a time; rows that it decodes at a time.
AT_A_TIME, ROWS = 3_000_000, 1_000


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row: the whole text's tokens; null and empty texts have none.

    ``tokenizer``: path, on the driver, of a byte-level BPE file; the public 50k one
    if none.  Repeated rows and ids stay as they are; other columns are ignored.
    """
    spec = _share(docs, tokenizer or tokenizer_file("byte_bpe_50k.json"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec)
        for batch in batches:
            at, n = 0, batch.num_rows
            sizes = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(1)]) if n else []
            while at < n:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_A_TIME)))
                part = batch.slice(at, to - at)
                found = bpe.encode_batch(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])
                at = to

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds ``out``: the text of each row's ids, special tokens as their strings; null ids give an empty text."""
    spec = _share(encoded, tokenizer or tokenizer_file("byte_bpe_50k.json"))
    at = encoded.columns.index(ids)
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids_ = (x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else () for x in batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(bpe.decode, ids_), pa.string(), size=batch.num_rows)], names=schema.names)

    return encoded.mapInArrow(of, schema)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): every text encoded, and its ids decoded again."""
    return decode(encode(docs, doc_id, text, tokenizer), "ids", "decoded", tokenizer)
