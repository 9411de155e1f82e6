"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hidden, materialise, n_words

#: Per-source tables up to this many rows (about 100 bytes each) are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000
#: Words of a source in one sorting range, on average.
WORDS_PER_RANGE = 500_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_SOURCES else df


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Target of every source: (source, source_size, weight, target).

    ``sizes`` has one row per source (source, source_size).  Sources in order
    of code points, null last, weigh ``weights`` in turn.  They share ``share``
    times the total size by weight; a target stops at ``max_epochs`` times its
    source's size and the excess is shared again by weight.  The level at which
    that ends is found in closed form: with the sources ordered by the level at
    which each is full, it is the level of the first that isn't filled by it.
    A source of size 0 has target 0; no rows give no rows.  The windows here
    span one short row per source, never documents.
    """
    by_name = (F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_full = Window.orderBy("full_at", *by_name).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", *by_name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    full = F.lit(float(max_epochs)) * F.col("source_size")
    return (
        sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(Window.orderBy(*by_name)) - 1) % len(weights) + 1).cast("int")))
        .withColumn("full_at", full / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(full).over(by_full), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_full), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_stop", F.first(F.when(F.col("_level") <= F.col("full_at"), F.col("_level")), ignorenulls=True).over(everything))
        .select("source", "source_size", "weight", F.least(full, F.coalesce("_stop", F.lit(float("inf"))) * F.col("weight")).alias("target"))
    )


def _key(seed: int, doc_id: str, text: str):
    """60 random bits of a row."""
    row = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How many words a mix takes from every document.

    Every document gets a random key by hash.  The keys of a source are cut
    into ranges of about ``WORDS_PER_RANGE`` words and sorted inside each;
    sums of the ranges, added up per source, and running sums inside a range
    make each document's prefix sum.  A source's target, rounded to whole words, is cut into whole
    epochs, which take every document, and a rest, which takes documents in
    key order up to exactly the rest; the document on the border gives only
    the words that are missing.

    Returns (doc_id, source, key, size, source_size, target, rank_words,
    epochs, extra, taken), a row for every input row: ``taken`` is ``epochs``
    times ``size`` plus ``extra``.  Null text counts 0 words; a null source is
    a source of its own, last in order; repeated rows count as often as they
    come; equal keys are ordered by id.  A document of 0 words gives 0 words.
    No rows give no rows.  Other columns are ignored.
    """
    d, t, s = F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.col(f"`{source}`")
    keyed = materialise(docs.select(d.alias("doc_id"), s.cast("string").alias("source"), n_words(t).alias("size"), _key(seed, doc_id, text).alias("key")), "mix-keys")
    targets = materialise(source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "mix-targets")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_size") / WORDS_PER_RANGE)).cast("long")
    per_source = targets.select(F.col("source").alias("t_source"), "source_size", "target", ranges.alias("ranges"))
    at = F.least(F.floor(F.col("key").cast("double") / F.lit(2.0**60) * F.col("ranges")), F.col("ranges") - 1)
    placed = keyed.join(_small(per_source, targets.count()), F.col("source").eqNullSafe(F.col("t_source"))).withColumn("range", at.cast("long"))

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = materialise(sums.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset")), "mix-offsets")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = running.join(_small(offsets, offsets.count()), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    whole = F.when(F.col("source_size") > 0, F.round("target").cast("long")).otherwise(0)
    return (
        cut.withColumn("rank_words", F.col("offset") + F.col("inside"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("epochs") * F.col("source_size") - F.col("rank_words"))).cast("long"))
        .select("doc_id", "source", "key", "size", "source_size", "target", "rank_words", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))
    )


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", seed: int = 17, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes once for every epoch that takes it whole, and once more
    if the cut takes it again; the one on a source's border then has only its
    first words, joined by single spaces, and its ``n_chars`` counted anew.
    Only the border of each source is joined to the texts, which don't move.
    Rows equal in id and text stand at one place of the order: if the border falls among
    them, all are taken whole.  A null or empty text takes no words and doesn't come.
    """
    m_source, m_cut, m_here, m_part, m_copy, m_cut_here = (hidden(x, docs) for x in ("source", "cut", "here", "part", "copy", "cut_here"))
    decided = mix_sources(docs, doc_id, text, source, seed=seed, **options)
    place = F.struct("key", "doc_id")
    borders = materialise(
        decided.groupBy("source").agg(
            F.max("epochs").alias("epochs"),
            F.max(F.when((F.col("extra") > 0) & (F.col("extra") == F.col("size")), place)).alias("whole"),
            F.max(F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.struct("key", "doc_id", "extra"))).alias("part"),
        ),
        "mix-borders",
    ).select(F.col("source").alias(m_source), F.struct("epochs", "whole", "part").alias(m_cut))
    here = F.struct(_key(seed, doc_id, text).alias("key"), F.col(f"`{doc_id}`").alias("doc_id"))
    out = docs.join(_small(borders, borders.count()), F.col(f"`{source}`").cast("string").eqNullSafe(F.col(m_source))).withColumn(m_here, here)
    whole = F.coalesce(F.col(m_here) <= F.col(f"{m_cut}.whole"), F.lit(False))
    part = F.col(m_here).eqNullSafe(F.struct(F.col(f"{m_cut}.part.key").alias("key"), F.col(f"{m_cut}.part.doc_id").alias("doc_id"))) & ~whole
    t = F.col(f"`{text}`")
    head = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), 1, F.coalesce(F.col(f"{m_cut}.part.extra"), F.lit(0)).cast("int")), " ")
    times = F.when(n_words(t) > 0, F.col(f"{m_cut}.epochs") + F.when(whole | part, 1).otherwise(0)).otherwise(0).cast("int")
    copies = out.withColumn(m_part, part).withColumn(m_copy, F.explode(F.sequence(F.lit(0), times)))
    copies = copies.filter(F.col(m_copy) < times)
    copies = copies.withColumn(m_cut_here, F.col(m_part) & (F.col(m_copy) == F.col(f"{m_cut}.epochs")))
    out = copies.withColumn(text, F.when(F.col(m_cut_here), head).otherwise(t))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(m_cut_here), F.length(t).cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"`{n_chars}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
