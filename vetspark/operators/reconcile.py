"""Reconciling candidates with each other and with what is already scheduled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import event_key, fresh
from ..functions.params import UrlRule
from ..sources.shared import written
from .checks import check_working_link
from .urls import probe_verdict, url_rule_verdict

MINUTES = 30


def tier_prune(df: DataFrame, entity: Sequence[str], tier: str = "tier") -> DataFrame:
    """Per entity the rows of the smallest tier, ties and all; a null tier is the last, so that an entity without any keeps its rows.

    The best tier per entity is aggregated before it is joined, so that an entity with many rows doesn't meet in one task.
    """
    names = fresh(df, *entity, "best")
    best = df.groupBy(*[F.col(c).alias(n) for c, n in zip(entity, names, strict=False)]).agg(F.min(tier).alias(names[-1]))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(entity, names, strict=False)]
    return df.join(best, [*same, F.col(tier).eqNullSafe(F.col(names[-1]))], "left_semi")


def merge_links(df: DataFrame, entity: Sequence[str], tier: str = "tier", source: str = "source", url: str = "url", size: int = 100) -> DataFrame:
    """Rows of entity, ``chunk`` from 1, ``n_links`` of the whole entity and ``links``: its distinct (tier, source, url), best tier first, ``size`` to a row.

    The links are sorted in ranges, of which a large entity fills several; a link's place is its place in its range's part of the entity
    after the parts before, of which there are as many as ranges.  So no row, window or task holds a whole entity unless it is small, as games are.  Null entities are one.
    """
    part, place, n, before = fresh(df, "part", "place", "n", "before")
    keys = [F.col(f"`{c}`") for c in entity]
    links = df.select(*keys, F.col(tier).alias("tier"), F.col(source).alias("source"), F.col(url).alias("url")).distinct()
    ranged = written(links.repartitionByRange(*keys, "tier", "source", "url").withColumn(part, F.spark_partition_id()), "links")
    parts = ranged.groupBy(*keys, part).agg(F.count("*").alias(n))
    whole = Window.partitionBy(*keys)
    parts = parts.withColumns({before: F.coalesce(F.sum(n).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n_links": F.sum(n).over(whole)})
    names = fresh(ranged, *entity, "in")
    parts = parts.select(*[k.alias(c) for k, c in zip(keys, names, strict=False)], F.col(part).alias(names[-1]), before, "n_links")
    numbered = ranged.withColumn(place, F.row_number().over(Window.partitionBy(*keys, part).orderBy("tier", "source", "url")))
    same = [k.eqNullSafe(F.col(c)) for k, c in zip(keys, names, strict=False)]
    placed = numbered.join(parts, [F.col(part) == F.col(names[-1]), *same])
    at = F.col(before) + F.col(place) - 1
    chunked = placed.groupBy(*keys, (F.floor(at / size) + 1).cast("int").alias("chunk"), "n_links")
    return chunked.agg(F.sort_array(F.collect_list(F.struct("tier", "source", "url"))).alias("links"))


def _seconds(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz")))


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp_ntz").cast("timestamp"))


def _bucket(micros: Column, width: int) -> Column:
    """The whole number of widths before, in integers: doubles don't tell microseconds apart beyond the year 2255."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))


def close_pairs(candidates: DataFrame, existing: DataFrame, cand_id: str, event_id: str, start: str, existing_start: str, key: str | None = None, existing_key: str | None = None, minutes: int = MINUTES, widths: int = 1) -> DataFrame:
    """(cand_id, event_id, gap): every candidate and existing event at most ``minutes`` apart, both ends included.

    Starts are put in buckets of ``widths`` times that length; the existing side is listed in
    all that its window touches, so that the join is by equality and every pair comes once: in three of one width, in one or two of four, which
    suits existing events that don't lie close.  With keys, both sides must have the same, and a null or blank key matches nothing.
    """
    width = minutes * 60_000_000
    filled = lambda df, k: df.filter(F.trim(F.col(k).cast("string")) != "")
    bucket = lambda micros: _bucket(micros, width * widths)
    left = candidates.select(F.col(cand_id).alias("cand_id"), F.col(start).alias("a"), (F.col(key) if key else F.lit(0)).alias("k")).filter("a is not null")
    right = existing.select(F.col(event_id).alias("event_id"), F.col(existing_start).alias("b"), (F.col(existing_key) if existing_key else F.lit(0)).alias("k2")).filter("b is not null")
    left, right = filled(left, "k"), filled(right, "k2")
    left = left.withColumn("slot", bucket(_micros(F.col("a"))))
    right = right.withColumn("slot2", F.explode(F.sequence(bucket(_micros(F.col("b")) - width), bucket(_micros(F.col("b")) + width))))
    cond = (F.col("slot") == F.col("slot2")) & (_seconds(F.col("a"), F.col("b")) <= width)
    if key:
        cond = (F.col("k") == F.col("k2")) & cond
    return left.join(right, cond).select("cand_id", "event_id", _seconds(F.col("a"), F.col("b")).alias("gap"))


def duplicate_match(candidates: DataFrame, existing: DataFrame, cand_id: str, event_id: str, start: str, existing_start: str, key: str | None = None, existing_key: str | None = None, minutes: int = MINUTES) -> DataFrame:
    """Candidates with ``matched_event`` (the closest, then lowest, null if none) and ``matches``, how many there are."""
    pairs = close_pairs(candidates, existing, cand_id, event_id, start, existing_start, key, existing_key, minutes)
    best, cand = fresh(candidates, "best", "cand")
    found = pairs.groupBy(F.col("cand_id").alias(cand)).agg(F.struct(F.min(F.struct("gap", "event_id")).alias("least"), F.count("*").alias("n")).alias(best))
    out = candidates.join(found, F.col(cand_id) == F.col(cand), "left")
    return out.withColumns({"matched_event": F.col(f"{best}.least.event_id"), "matches": F.coalesce(F.col(f"{best}.n"), F.lit(0))}).drop(cand, best)


def clash_counts(candidates: DataFrame, existing: DataFrame, cand_id: str, start: str, existing_start: str, minutes: int = MINUTES) -> DataFrame:
    """(cand_id, clashes): how many existing events start at most ``minutes`` from each candidate, whatever their keys; no pairs are made.

    A candidate's count is the number of events before the end of its window less the number before its beginning.  Those numbers are
    running sums over the distinct instants of both sides, taken inside seconds, over the seconds of a slot and over the slots
    (one short row per half hour), so that no slot or instant, however full, meets in one task.  A candidate without
    start has 0.  ``cand_id`` must be unique.
    """
    width, second = minutes * 60_000_000, 1_000_000
    micros = lambda x: F.unix_micros(x.cast("timestamp_ntz").cast("timestamp"))
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    asked = candidates.select(F.col(cand_id).alias("cand_id"), micros(F.col(start)).alias("a")).filter("a is not null")
    ends = F.array(F.struct((F.col("a") - width).alias("t"), F.lit(-1).alias("sign")), F.struct((F.col("a") + width + 1).alias("t"), F.lit(1).alias("sign")))
    edges = asked.select("cand_id", F.inline(ends))
    points = existing.select(micros(F.col(existing_start)).alias("t"), F.lit(1).alias("n")).filter("t is not null").unionByName(edges.select("t", F.lit(0).alias("n")))
    points = points.groupBy("t").agg(F.sum("n").alias("n")).withColumn("second", F.floor(F.col("t") / second))
    seconds = points.groupBy("second").agg(F.sum("n").alias("n")).withColumn("slot", F.floor(F.col("second") / 1800))
    slots = seconds.groupBy("slot").agg(F.sum("n").alias("n"))
    until = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", before(until("slot")).alias("of_slots"))
    seconds = seconds.withColumn("of_seconds", before(until("second", "slot"))).join(slots, "slot").select("second", (F.col("of_seconds") + F.col("of_slots")).alias("earlier"))
    points = points.withColumn("inside", before(until("t", "second"))).join(seconds, "second").select("t", (F.col("earlier") + F.col("inside")).alias("below"))
    n = edges.join(points, "t").groupBy("cand_id").agg(F.sum(F.col("sign") * F.col("below")).alias("clashes"))
    return candidates.select(F.col(cand_id).alias("cand_id")).join(n, "cand_id", "left").withColumn("clashes", F.coalesce("clashes", F.lit(0)))


def new_only(candidates: DataFrame, existing: DataFrame, cand_id: str, event_id: str, start: str, existing_start: str, key: str | None = None, existing_key: str | None = None, minutes: int = MINUTES, widths: int = 1) -> DataFrame:
    """Candidates that no existing event matches; a null or blank key matches nothing."""
    pairs = close_pairs(candidates, existing, cand_id, event_id, start, existing_start, key, existing_key, minutes, widths)
    (cand,) = fresh(candidates, "cand")
    return candidates.join(pairs.select(F.col("cand_id").alias(cand)), F.col(cand_id) == F.col(cand), "left_anti")


def chain_buckets(points: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Points (k, t; t in microseconds) by bucket of ``minutes``: k, b, ``first``, ``head``, ``asks``, ``beyond``.

    All points of a bucket lie within ``minutes`` of its first, and so only that one can be a chain's ``head``: if the last point of
    the bucket before lies further back.  Where the next bucket has a head, all points lead to it; only where it has none it ``asks`` which of that bucket's points
    comes after which of its own, and ``beyond`` is the first point after both, null if that is a head or there is none.  The window has one
    short row for each bucket of a k.
    """
    width = minutes * 60_000_000
    order = Window.partitionBy("k").orderBy("b")
    ends = points.groupBy("k", _bucket(F.col("t"), width).alias("b")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    far = lambda n: F.lead("first", n).over(order) - (F.lead("last", n - 1).over(order) if n > 1 else F.col("last")) > width
    head = F.coalesce(F.col("first") - F.lag("last", 1).over(order) > width, F.lit(True))
    return ends.select("k", "b", "first", head.alias("head"), F.coalesce(~far(1), F.lit(False)).alias("asks"), F.when(~far(2), F.lead("first", 2).over(order)).alias("beyond"))


def chain_links(points: DataFrame, minutes: int = MINUTES, buckets: DataFrame | None = None) -> DataFrame:
    """(k, t, ``onward``) of the points that a chain may reach: the first that lies more than ``minutes`` after, unless that is a head, which stays anyway.

    What is that long after a point lies in the next bucket, so that the first later point is found
    among its points, by a running minimum over both, or is the first of the bucket that comes after.  A bucket with a head asks for that one alone, as no chain
    reaches the others.  Windows hold one bucket of one k, and only points of buckets that ask or are asked get there.
    ``buckets``: what :func:`chain_buckets` gives for these points, if it is there already.
    """
    width = minutes * 60_000_000
    buckets = chain_buckets(points, minutes) if buckets is None else buckets
    own = points.select("k", "t", _bucket(F.col("t"), width).alias("b")).join(buckets.filter("asks or not head"), ["k", "b"])
    known = F.when(~F.col("head"), F.struct("b", "t", F.lit(1).alias("point"), F.lit(None).cast("long").alias("beyond")))
    asked = F.when(F.col("asks") & (~F.col("head") | (F.col("t") == F.col("first"))), F.struct((F.col("b") + 1).alias("b"), (F.col("t") + width).alias("t"), F.lit(0).alias("point"), "beyond"))
    rows = own.select("k", F.inline(F.array(known, asked))).filter("b is not null")
    by = Window.partitionBy("k", "b").orderBy(F.desc("t"), "point")
    later = F.min(F.when(F.col("point") == 1, F.col("t"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce((F.lag("t", 1).over(by) == F.col("t")) & (F.lag("point", 1).over(by) == 0), F.lit(False))
    seen = rows.withColumns({"onward": F.coalesce(later, "beyond"), "again": again})
    return seen.filter("point = 0 and not again and onward is not null").select("k", (F.col("t") - width).alias("t"), "onward")


def chain_picks(points: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Of points (k, t; t in microseconds) those that stay, once each, when, in the order of t, one goes that a kept one of its k lies at most ``minutes`` before.

    Every chain's head stays, and after a kept point the first one further on.  Pointers to it double their reach each round, and the points reached
    from heads double with them, so that a chain of a million points takes twenty rounds; what a round adds is written to the shared folder.
    A pointer ends at the next head, which is kept anyway, so that chains never meet.
    """
    buckets = written(chain_buckets(points, minutes), "buckets")
    jumps, kept = written(chain_links(points, minutes, buckets), "jumps"), buckets.filter("head").select("k", F.col("first").alias("t"))
    while jumps.limit(1).count():
        kept = kept.unionByName(written(jumps.join(kept, ["k", "t"]).select("k", F.col("onward").alias("t")), "kept"))
        jumps = written(jumps.join(jumps.select("k", F.col("t").alias("onward"), F.col("onward").alias("far")), ["k", "onward"]).select("k", "t", F.col("far").alias("onward")), "jumps")
    return kept


def new_in_batch(events: DataFrame, event_id: str = "event_id", start: str = "start_ts", key: str = "pair_key", minutes: int = MINUTES, own: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """Events of a batch without those that another of the batch makes duplicates, by id and by pair.

    Of rows that repeat an id the earliest stays (then by key and the rest of the row); rows without id that are equal are one.  In the order
    of starts (then ids), an event goes if one of its pair that stays starts at most ``minutes`` before it.  Events without start, or with a null or
    blank key, go by their id only.  No array or window ever holds a pair's events: see :func:`chain_picks`.

    Which ids stay is worked out on id, start and key alone; whole rows meet the ids once, and only those that repeat one are compared.
    ``own``: a column of ``events`` that tells rows apart as :func:`event_key` does; such events lie in a table already, others are written to one first.
    ``among``: the part of their rows that may stay, all rows of an id or none, with ``own``, ``event_id``, ``start`` and ``key``.
    """
    columns = [F.col(f"`{c}`") for c in events.columns]
    if own is None:
        (own,) = fresh(events, "own")
        events = written(events.withColumn(own, event_key(events, event_id)), "events")
    row, hashed, n = fresh(events, "row", "hash", "n")
    first = [F.col(start).isNull(), F.col(start), F.col(key).isNull(), F.col(key)]
    ids = events if among is None else among
    ids = ids.groupBy(F.xxhash64(own).alias("h"), F.col(own).alias("own")).agg(F.min(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(first)])).alias("at"), F.min(F.col(event_id)).alias("id"), F.count(F.lit(1)).alias("n"))
    k, at = F.col("at.c3"), F.col("at.c1")
    filled = F.coalesce((F.trim(k.cast("string")) != "") & at.isNotNull(), F.lit(False))
    ids = written(ids.select("h", "own", "id", "n", F.when(filled, k).alias("k"), F.when(filled, _micros(at)).alias("t")), "ids")
    timed = ids.filter("t is not null")
    least = timed.join(chain_picks(timed.select("k", "t"), minutes), ["k", "t"]).groupBy("k", "t").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own", "h", "n")).alias("least"))
    stay = least.select("least.h", "least.own", "least.n").unionByName(ids.filter("t is null").select("h", "own", "n"))
    repeated = ids.filter("n > 1").limit(1).count()
    stay = (written(stay, "stay") if repeated else stay).select(F.col("h").alias(hashed), F.col("own").alias(row), F.col("n").alias(n))
    whole = lambda ids: events.join(ids, (F.xxhash64(own) == F.col(hashed)) & (F.col(own) == F.col(row)))
    if not repeated:
        return whole(stay).select(*columns)
    order = F.struct(*first, F.to_json(F.struct(*columns)))
    several = whole(stay.filter(F.col(n) > 1)).groupBy(own).agg(F.min_by(F.struct(*columns), order).alias(row)).select(f"{row}.*")
    return whole(stay.filter(F.col(n) == 1)).select(*columns).unionByName(several)


def results_table(created: DataFrame, skipped: DataFrame, columns: Sequence[str], event: str = "event_id") -> DataFrame:
    """Created and skipped rows in one table: status, ``columns``, calendar_event."""
    made = created.select(F.lit("created").alias("status"), *columns, F.col(event).cast("string").alias("calendar_event"))
    left = skipped.select(F.lit("skipped").alias("status"), *columns, F.concat(F.lit("Event already exists: "), F.col("matched_event").cast("string")).alias("calendar_event"))
    return made.unionByName(left)


def run_summary(
    df: DataFrame, rejected: Column, duplicate: Column, none_found: str = "no streams found", none_passed: str = "found {n} candidates, none passed",
    stages: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row: found, rejected, duplicates, created, and the message if nothing came of it; also for no rows.

    ``stages``: conditions in order; ``rejected_<name>`` counts the rows that a stage is the first to reject.
    """
    r, d = F.coalesce(rejected, F.lit(False)), F.coalesce(duplicate, F.lit(False))
    first = _stage_of(stages or {})
    per_stage = [F.count_if(F.coalesce(first == name, F.lit(False))).alias(f"rejected_{name}") for name in stages or {}]
    out = df.agg(F.count("*").alias("found"), F.count_if(r).alias("rejected"), F.count_if(~r & d).alias("duplicates"), F.count_if(~r & ~d).alias("created"), *per_stage)
    before, _, after = none_passed.partition("{n}")
    message = F.when(F.col("found") == 0, none_found).when(F.col("found") == F.col("rejected"), F.concat(F.lit(before), F.col("found").cast("string"), F.lit(after)))
    return out.withColumn("message", message)


def _stage_of(stages: Mapping[str, Column]) -> Column:
    """The first stage that rejects a row, null if none does."""
    first = F.lit(None).cast("string")
    for name, c in reversed(stages.items()):
        first = F.when(F.coalesce(c, F.lit(False)), name).otherwise(first)
    return first


def write_decided(
    df: DataFrame, path: str, reason: Column, duplicate: Column, stages: Mapping[str, Column] | None = None,
    none_found: str = "no streams found", none_passed: str = "found {n} candidates, none passed",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decide every row and write it once: (accepted, rejected with their ``reason``, summary as :func:`run_summary` gives it), from one pass over ``df``.

    ``reason``: why a row is rejected, null if it isn't; ``duplicate``: whether an accepted one is there already, which is no rejection.  The
    table at ``path`` is partitioned by ``verdict``, so that either part is read alone.  The counts are observed while rows are written, in the very tasks that write
    them, so that a task that runs again counts once.  An earlier table at ``path`` is replaced.
    """
    if clash := {"verdict", "reason"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    stage = fresh(df, "stage")[0]
    verdict = F.when(reason.isNotNull(), "rejected").when(F.coalesce(duplicate, F.lit(False)), "duplicate").otherwise("accepted")
    rows = df.withColumns({"reason": reason, "verdict": verdict, stage: _stage_of(stages or {})})
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    counts = [F.count(F.lit(1)).alias("found"), is_("rejected").alias("rejected"), is_("duplicate").alias("duplicates"), is_("accepted").alias("created")]
    counts += [F.count_if(F.coalesce(F.col(stage) == name, F.lit(False))).alias(f"rejected_{name}") for name in stages or {}]
    seen = Observation("decided")
    rows.observe(seen, *counts).drop(stage).write.mode("overwrite").partitionBy("verdict").parquet(path)
    spark, got = df.sparkSession, seen.get
    n = {c: int(got.get(c, 0)) for c in ("found", "rejected", "duplicates", "created", *(f"rejected_{x}" for x in stages or {}))}
    table = spark.read.schema(rows.drop(stage).schema).parquet(path)
    said = none_found if not n["found"] else none_passed.replace("{n}", str(n["found"])) if n["found"] == n["rejected"] else None
    summary = spark.createDataFrame([(*n.values(), said)], ", ".join(f"`{c}` long" for c in n) + ", message string")
    return table.filter("verdict = 'accepted'").drop("verdict", "reason"), table.filter("verdict = 'rejected'").drop("verdict"), summary


def audit_published(events: DataFrame, verdict: Column, keys: Sequence[str], links: str = "links") -> DataFrame:
    """Links of published events that no longer stand: keys, link, failed.

    ``verdict`` is the reason why a ``link`` fails, null if it doesn't.
    """
    return events.select(*keys, F.explode(links).alias("link")).withColumn("failed", verdict).filter("failed is not null").select(*keys, "link", "failed")


def audit_links(events: DataFrame, probes: DataFrame, rules: Sequence[UrlRule], keys: Sequence[str] = ("event_id", "source_ref", "validated_at"), links: str = "links") -> DataFrame:
    """Links of published events that fail the URL rules, the probe or the exact check for 200: ``keys``, link, http_status, failed.

    The rules come first; then a missing probe, a status other than 200, and a redirect to a wall.  ``probes``: url, http_status,
    final_url, as for :func:`probe_verdict`.  Each event names a link once; null links don't count.
    """
    each = events.select(*keys, F.explode(F.array_distinct(links)).alias("link")).filter("link is not null")
    probed = probe_verdict(each, probes.withColumnRenamed("url", "link"), on="link")
    rule = url_rule_verdict(F.col("link"), rules)
    link = check_working_link(F.col("http_status"), rule["valid"], F.col("probe.final_url"))
    return probed.withColumn("failed", F.coalesce(rule["reason"], link["reason"])).filter("failed is not null").select(*keys, "link", "http_status", "failed")


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; the order must leave no ties."""
    (at,) = fresh(df, "n")
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(at) <= n).drop(at)
