"""Column expressions; none that looks at text is a higher-order function, which Spark would interpret."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How umlauts are written without them.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def fold_text(x: Column) -> Column:
    """Lower case without umlauts, so that both spellings of a word agree."""
    out = F.lower(x)
    for umlaut, plain in UMLAUTS.items():
        out = F.replace(out, F.lit(umlaut), F.lit(plain))
    return out


def fold(word: str) -> str:
    """:func:`fold_text` for a constant."""
    out = word.lower()
    for umlaut, plain in UMLAUTS.items():
        out = out.replace(umlaut, plain)
    return out


def word_pattern(words: Iterable[str]) -> str:
    """A pattern that finds any of the words as a whole; its borders are the same in Java and RE2."""
    any_of = "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", w) for w in words)
    return rf"(^|[^\p{{L}}\p{{N}}])({any_of})($|[^\p{{L}}\p{{N}}])"


#: What lies between words.
BETWEEN = r"[^\p{L}\p{N}]+"


def spellings(word: str) -> list[str]:
    """Every way to write a word that :func:`fold` makes the same: each plain spelling as it is or as an umlaut."""
    ends = {len(fold(word)): [""]}
    word = fold(word)
    for i in range(len(word) - 1, -1, -1):
        ends[i] = [word[i] + x for x in ends[i + 1]] + [u + x for u, plain in UMLAUTS.items() if word.startswith(plain, i) for x in ends[i + len(plain)]]
    return ends[0]


def words_of(word: str) -> list[str]:
    """The words that a term of several is made of."""
    return [w for w in re.split(r"[\W_]+", word) if w]


def _single(word: str) -> bool:
    return words_of(word) == [word]


def _any_of(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted(set(words)))).cast("array<string>")


def tokens(x: Column, folded: bool = False) -> Column:
    """The words of a text, in order; with ``folded`` in lower case."""
    return F.split(F.lower(x) if folded else x, BETWEEN)


class Vocabulary:
    """All terms that are looked for in a text, met in one pass over it.

    A text is cut into words once, and those that any term is made of are kept, a short array; what :func:`has_word` asks of them costs no
    further look at the text, except for terms of several words whose words are all there.  Words are met by hash, so that the cost
    doesn't grow with the terms.  Put :meth:`hits` into a column of its own, so that it is worked out once.
    """

    def __init__(self, *terms: Iterable[str]) -> None:
        self.words = sorted({s for of in terms for t in of for w in words_of(fold(t)) for s in spellings(w)})

    def hits(self, x: Column) -> Column:
        """The vocabulary's words that stand in a text, in lower case; none for null."""
        return F.coalesce(F.array_intersect(_any_of(self.words), tokens(x, folded=True)), F.array().cast("array<string>"))


def has_word(x: Column, words: Iterable[str], folded: bool = False, hits: Column | None = None) -> Column:
    """Whether any word stands in the text; false for null text or no words.

    ``hits``: what a :class:`Vocabulary` that knows the words has found in this text, for folded words.  Without it, folded
    words are met with the text's words, others are searched plainly first and then by their pattern.
    """
    words = [*words]
    if not words:
        return F.lit(False)
    if not folded:
        return F.coalesce(reduce(or_, [x.contains(w) for w in words]) & x.rlike(word_pattern(words)), F.lit(False))
    words = sorted({fold(w) for w in words})
    single, several = [w for w in words if _single(w)], [w for w in words if not _single(w)]
    own = tokens(x, folded=True) if hits is None else hits
    found = [F.arrays_overlap(own, _any_of(s for w in single for s in spellings(w)))] if single else []
    for w in several:
        there = F.lower(x).rlike(word_pattern(spellings(w)))
        for part in words_of(w) if hits is not None else ():
            there = F.arrays_overlap(hits, _any_of(spellings(part))) & there
        found.append(there)
    return F.coalesce(reduce(or_, [F.coalesce(f, F.lit(False)) for f in found]), F.lit(False))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def try_int(x: Column) -> Column:
    """A whole number, or null if the text isn't one."""
    return strip(x.cast("string")).try_cast("long")


def to_local(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` of an instant that is given as UTC wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def iso_offset(ts: Column, tz: str) -> Column:
    """ISO 8601 text in ``tz`` with its offset, whatever the session's zone."""
    utc, local = ts.cast("timestamp_ntz"), to_local(ts, tz)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, hours, F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def end_time(start: Column, playoff: Column, regular_minutes: int = 150, playoff_minutes: int = 180) -> Column:
    """When an event ends: 2.5 hours after its start, 3 in playoffs."""
    return start + F.when(F.coalesce(playoff, F.lit(False)), F.expr(f"interval {playoff_minutes} minutes")).otherwise(F.expr(f"interval {regular_minutes} minutes"))


def pair_key(a: Column, b: Column) -> Column:
    """Both names folded, in either order the same; null if one is null or blank."""
    a, b = strip(fold_text(a)), strip(fold_text(b))
    return F.when((a != "") & (b != ""), F.array_join(F.sort_array(F.array(a, b)), "|"))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` as the array a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def event_key(df: DataFrame, event_id: str) -> Column:
    """What tells a row from others: its id, or without one the hash of its content, so that equal rows without id are one."""
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != event_id]), {"ignoreNullFields": "false"}), 256)
    return F.coalesce(F.concat(F.lit("id "), F.col(f"`{event_id}`").cast("string")), F.concat(F.lit("row "), content))
