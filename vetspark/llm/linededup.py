"""Line dedup: later copies of runs of lines go, found by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hidden, materialise, skew_join

#: White space that doesn't tell lines apart at their ends.
BLANK = " \t\x0b\x0c\r"


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(no_id, doc_id, text_hash, pos, h, h2, words): the lines that hold words, numbered from 0 in the text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("t"))
    rows = rows.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    line = F.trim(F.col("line"), F.lit(BLANK))
    rows = rows.withColumn("line", line).filter("line != ''")
    return rows.select("no_id", "doc_id", "text_hash", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))


DOC = ["no_id", "doc_id", "text_hash"]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """The guaranteed fingerprints of texts: (no_id, doc_id, text_hash, fp, at, around, windows), one row for each selected line.

    A text's windows are its shortest runs of ``min_words`` words from each line on, and up to each line.  Each window
    selects its smallest line hash ``fp``, the last if tied, at line ``at``; texts that share a window select the same line of it.
    ``windows`` (start, stop) are those that selected the line; ``around`` (pos, h, h2) are their lines.
    """
    own = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(docs, doc_id, text).repartition(*DOC).dropDuplicates([*DOC, "pos"])
    lines = lines.withColumn("before", F.coalesce(F.sum("words").over(own), F.lit(0))).withColumn("after", F.col("before") + F.col("words"))
    ahead = Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC).orderBy("after").rangeBetween(-(min_words - 1), 0)
    line = F.struct("h", (-F.col("pos")).alias("late"))
    whole = {"ahead": F.col("before") + min_words <= F.col("all"), "back": F.col("after") >= min_words}
    seen = lines.withColumn("all", F.max("after").over(Window.partitionBy(*DOC)))
    for name, over in (("ahead", ahead), ("back", back)):
        content = F.collect_list(F.struct("pos", "h", "h2")).over(over)
        seen = seen.withColumn(name, F.when(whole[name], F.struct(F.min(line).over(over).alias("least"), content.alias("lines"))))
    windows = seen.select(*DOC, F.inline(F.array_compact(F.array("ahead", "back")))).select(*DOC, F.col("least.h").alias("fp"), (-F.col("least.late")).alias("at"), "lines")
    selected = windows.groupBy(*DOC, "fp", "at").agg(F.collect_list("lines").alias("each"))
    span = F.transform("each", lambda w: F.struct(F.element_at(w, 1)["pos"].alias("start"), F.element_at(w, -1)["pos"].alias("stop")))
    return selected.select(*DOC, "fp", "at", F.array_sort(F.array_distinct(F.flatten("each"))).alias("around"), F.array_distinct(span).alias("windows"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Maximal runs of lines that occurred before: (no_id, doc_id, text_hash, start, stop), line numbers from 0, both included.

    A run counts if it has ``min_words`` words and equals an earlier run that it doesn't overlap;
    earlier is by id (null last), then by a hash of the text, then by line.
    Lines are equal if they are after trimming; lines without words are looked through.

    Winnowing: only selected lines (:func:`fingerprints`) are kept.  Fingerprints that stand at one place end there.  From the others' lines
    a match is extended to the left and to the right over line hashes, as far as a window reaches; what each extension holds is compared with
    the first place that holds the same, one row each however many copies there are, never in pairs.  Matches of one text that overlap
    are one run.  So every line of a run that counts lies in a match, and later runs go.

    Rows that repeat id and text are one document here; no rows give no rows.
    """
    selected = materialise(fingerprints(docs, doc_id, text, min_words), "line-fingerprints")
    spot = F.struct(*DOC, "at")
    common = selected.groupBy("fp").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a != b").select("fp")
    positions = skew_join(selected, common, ["fp"])
    inside = lambda h: F.transform(F.filter("around", lambda x: x["pos"].between(F.col("w.start"), F.col("w.stop"))), lambda x: x[h])
    extended = positions.select(*DOC, "around", F.explode("windows").alias("w")).select(*DOC, "w.start", "w.stop", F.xxhash64(inside("h")).alias("w1"), F.xxhash64(inside("h2")).alias("w2"))
    extended = materialise(extended, "line-matches", selected)
    place = F.struct(*DOC, "start", "stop")
    first = extended.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last")
    later = skew_join(extended, first, ["w1", "w2"])
    apart = ~(F.struct(*DOC).eqNullSafe(F.struct(*[F.col(f"first.{c}").alias(c) for c in DOC])) & (F.col("start") <= F.col("first.stop")))
    hits = later.filter(apart).select(*DOC, "start", "stop").distinct()

    so_far = F.max("stop").over(Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.when(F.col("start") <= so_far, 0).otherwise(1))
    run = F.sum("new").over(Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _without(text: Column, runs: Column) -> Column:
    """A text without its ``runs``, ordered and apart: the slices between them, put together."""
    lines = F.split(text, "\n")
    stops = F.concat(F.array(F.lit(-1)), F.transform(runs, lambda r: r["stop"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    gaps = F.arrays_zip(stops.alias("stop"), starts.alias("start"))
    return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["stop"] + 2, g["start"] - g["stop"] - 1))), "\n")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with later copies of runs of lines deleted from ``text``, and ``n_chars``, if there, counted anew for changed texts.

    All rows and columns stay; a text of which nothing is left is empty, and
    the first copy of every line stays somewhere.  Runs are those of :func:`repeated_runs`.  Of rows that repeat
    id and text, all lose the same lines.  Null texts stay null.
    """
    name, d, h = (hidden(x, docs) for x in ("runs", "id", "hash"))
    runs = repeated_runs(docs, doc_id, text, min_words).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(name))
    runs = materialise(runs, "line-runs")
    ids = runs.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), name)
    t = F.col(f"`{text}`")
    here = F.xxhash64(F.coalesce(t.cast("string"), F.lit("")))
    # merged at every size: broadcasting short lists of runs would only hold for small inputs
    joined = docs.join(ids.hint("merge"), F.col(f"`{doc_id}`").eqNullSafe(F.col(d)) & (here == F.col(h)), "left")
    changed = F.col(name).isNotNull()
    out = joined.withColumn(text, F.when(changed, _without(t, F.col(name))).otherwise(t))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(changed, F.length(t).cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"`{n_chars}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
