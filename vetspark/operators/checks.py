"""The checks of a candidate, each a (status, reason), and the decision over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.columns import fold, fold_text, fresh, has_word, host_suffixes, text_or_empty, to_local, word_pattern
from .joins import join_grouped

PASS, FAIL, NA = "PASS", "FAIL", "N/A"
CHECKS = ("freeAccess", "liveContent", "officialSource", "topic", "dateTimeRange", "workingLink", "directStream")
RESULT = "struct<status:string,reason:string>"


def result(reason: Column) -> Column:
    """(status, reason): passes where no reason is given."""
    return F.struct(F.when(reason.isNull(), PASS).otherwise(FAIL).alias("status"), reason.alias("reason")).cast(RESULT)


def keyword_hits(text: Column, words: Sequence[str], folded: bool = False, hits: Column | None = None) -> Column:
    """Array of the words that stand in the text as whole words, in the order given, each once.  ``hits`` as for :func:`.has_word`."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*[F.when(has_word(text, [w], folded, hits), F.lit(w)) for w in words]), F.array(F.lit(None).cast("string")))


def without_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """Folded text with whole phrases blanked, long ones first, so that a negated word doesn't count."""
    out = fold_text(text)
    for p in sorted({fold(x) for x in phrases}, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, word_pattern([p]), "$1 $3")
    return out


def check_free_access(
    text: Column, free_flag: Column | None = None, paid: Sequence[str] = tuple(P.PAID_TERMS), brands: Sequence[str] = tuple(P.PAID_BRANDS),
    free: Sequence[str] = tuple(P.FREE_TERMS), price: str | None = r"\d+([.,]\d\d)?\s*(€|eur\b|euro\b)", hits: Column | None = None,
) -> Column:
    """Fails on a paid term that no free phrase contains, a paid brand, a price, or a flag that isn't set; else needs a flag or a free term.

    ``hits``, here and below: what a vocabulary with all the terms has found in the text.
    """
    t = text_or_empty(text)
    said = lambda words: has_word(t, words, folded=True, hits=hits)
    flag = F.lit(None).cast("boolean") if free_flag is None else free_flag
    # phrases are blanked only where a paid term and a free phrase stand; blanking makes no new words
    reason = F.when(said(paid) & (~said(free) | has_word(without_phrases(t, free), paid, folded=True)), "paid term").when(said(brands), "paid brand")
    if price:
        reason = reason.when(fold_text(t).rlike(price), "price")
    reason = reason.when(flag == F.lit(False), "not free").when(~F.coalesce(flag, F.lit(False)) & ~said(free), "no sign of free access")
    return result(reason)


def check_live_content(text: Column, scheduled: Column | None = None, live: Sequence[str] = tuple(P.LIVE_TERMS), replay: Sequence[str] = tuple(P.REPLAY_TERMS), hits: Column | None = None) -> Column:
    """A replay term fails whatever else is there; passes on a live term or a scheduled stream."""
    ahead = F.lit(False) if scheduled is None else F.coalesce(scheduled, F.lit(False))
    return result(F.when(has_word(text, replay, folded=True, hits=hits), "replay").when(~has_word(text, live, folded=True, hits=hits) & ~ahead, "not live"))


def match_domains(df: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain", out: str = "matched") -> DataFrame:
    """Adds ``out``: the row of ``domains`` whose domain is the host or the longest one above it, null if none.

    The suffixes of the distinct hosts are exploded and joined by equality to the domains, one row each (the
    smallest of rows that repeat a domain); what is found goes back by host, a hot one in parts.  Spark broadcasts either table where its size allows.
    """
    own, suffix, row = fresh(df, "host", "suffix", "row")
    dim = domains.groupBy(F.col(domain).alias(suffix)).agg(F.min(F.struct(*domains.columns)).alias(row))
    hosts = df.select(F.col(host).alias(own)).filter(F.col(own).isNotNull()).distinct()
    suffixes = hosts.select(own, F.explode(host_suffixes(F.col(own))).alias(suffix))
    best = suffixes.join(dim, suffix).groupBy(own).agg(F.max_by(row, F.length(suffix)).alias(out))
    return join_grouped(df, best, F.col(host), own)


def check_official_source(host: Column, path: Column, matched: Column, channels: Sequence[str] = tuple(P.CHANNELS), channel_hosts: Sequence[str] = tuple(P.CHANNEL_HOSTS)) -> Column:
    """Passes on an approved domain or, on a video site, an approved channel (whole segments, any case of a handle)."""
    on_channels = F.coalesce(host.isin(*channel_hosts, *("m." + h for h in channel_hosts)), F.lit(False))
    handles = [c.lower() for c in channels if c.startswith("@")]
    others = [c for c in channels if not c.startswith("@")]
    own = F.lower(F.split_part(path, F.lit("/"), F.lit(2))).isin(*handles) | F.concat_ws("/", F.split_part(path, F.lit("/"), F.lit(2)), F.split_part(path, F.lit("/"), F.lit(3))).isin(*others)
    return result(F.when(on_channels & ~F.coalesce(own, F.lit(False)), "channel not approved").when(~on_channels & matched.isNull(), "domain not approved"))


def check_topic(text: Column, topics: Sequence[str] = tuple(P.TOPIC_TERMS), others: Sequence[str] = tuple(P.OTHER_TOPICS), known: Column | None = None, hits: Column | None = None) -> Column:
    """Fails on another topic; passes on a topic term or where ``known`` says that a team or league is."""
    is_known = F.lit(False) if known is None else F.coalesce(known, F.lit(False))
    return result(F.when(has_word(text, others, folded=True, hits=hits), "other topic").when(~has_word(text, topics, folded=True, hits=hits) & ~is_known, "no topic term"))


def check_date_window(start: Column, as_of: str, days: int = 7, tz: str = P.TIMEZONE) -> Column:
    """Local start from ``as_of`` 00:00 to the end of the day ``days`` later; ``start`` is an instant as UTC wall-clock."""
    local, first = to_local(start, tz), F.lit(as_of).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(as_of).cast("date"), days + 1).cast("timestamp_ntz")
    return result(F.when(start.isNull(), "date cannot be determined").when(local < first, "in the past").when(local >= end, "too far ahead"))


def usual_hours(start: Column, tz: str = P.TIMEZONE, first: int = 14, last: int = 23) -> Column:
    """Whether the local start lies from ``first`` to ``last`` o'clock, both included; null if unknown."""
    local = to_local(start, tz)
    return (F.hour(local) >= first) & ((F.hour(local) < last) | ((F.hour(local) == last) & (F.minute(local) == 0) & (F.second(local) == 0)))


def check_working_link(status: Column, url_valid: Column, final_url: Column | None = None, walls: str = r"/(login|abo|paywall|error|404)([/?#]|$)") -> Column:
    """Passes on exactly 200, without redirect to an error or pay page; a URL that the rules reject fails unprobed."""
    wall = F.lit(False) if final_url is None else F.coalesce(F.lower(final_url).rlike(walls), F.lit(False))
    return result(F.when(~F.coalesce(url_valid, F.lit(False)), "URL rejected").when(status.isNull(), "HTTP error").when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(wall, "redirected to a wall"))


def check_direct_stream(html: Column, scheduled: Column | None = None, evidence: str = r"(?i)<video[\s>]|(^|[^\p{L}\p{N}])live($|[^\p{L}\p{N}])") -> Column:
    """Passes on a player or badge in the page, or a scheduled stream; an unreadable page (null) fails."""
    ahead = F.lit(False) if scheduled is None else F.coalesce(scheduled, F.lit(False))
    return result(F.when(html.isNull(), "page unreadable").when(~html.rlike(evidence) & ~ahead, "no stream on the page"))


def platform_rule(df: DataFrame, platforms: Mapping[str, bool], host: str = "host") -> DataFrame:
    """Adds ``platform_free``: what the table says of the row's domain, null where it says nothing."""
    table = df.sparkSession.createDataFrame([*platforms.items()], "domain string, free boolean")
    (found,) = fresh(df, "platform")
    return match_domains(df, table, host, out=found).withColumn("platform_free", F.col(f"{found}.free")).drop(found)


def announcement_gate(df: DataFrame, announcements: DataFrame, gated: Column, on: Sequence[str]) -> DataFrame:
    """Adds ``announced``: true where the row isn't ``gated`` or an announcement has its keys; null keys match nothing."""
    hit, *names = fresh(df, "hit", *on)
    keys = announcements.select(*[F.col(c).alias(n) for c, n in zip(on, names, strict=True)]).dropna().distinct().withColumn(hit, F.lit(True))
    out = df.join(keys, [F.col(c) == F.col(n) for c, n in zip(on, names, strict=True)], "left")
    return out.withColumn("announced", ~F.coalesce(gated, F.lit(False)) | F.col(hit).isNotNull()).drop(hit, *names)


def quota_violation(df: DataFrame, group: Sequence[str | Column], most: int = 1) -> DataFrame:
    """Groups with more than ``most`` rows, and how many."""
    return df.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def check_array(checks: Mapping[str, Column]) -> Column:
    """Results as an array of (check_no, check, status, reason), numbered from 1."""
    one = [F.struct(F.lit(i).alias("check_no"), F.lit(name).alias("check"), F.coalesce(c["status"], F.lit(FAIL)).alias("status"), c["reason"].alias("reason")) for i, (name, c) in enumerate(checks.items(), 1)]
    return F.array(*one)


def decide(df: DataFrame, checks: str = "checks") -> DataFrame:
    """Adds ``decision`` (CREATE if all pass, else SKIP), ``reasons`` of all that fail, and ``reason``, the first."""
    c = F.col(checks)
    failed = F.filter(c, lambda x: x["status"] != PASS)
    return df.withColumns({
        "decision": F.when(F.coalesce(F.forall(c, lambda x: x["status"] == PASS), F.lit(False)), "CREATE").otherwise("SKIP"),
        "reasons": F.transform(failed, lambda x: F.coalesce(x["reason"], x["check"])),
        "reason": F.coalesce(F.try_element_at(failed, F.lit(1))["reason"], F.try_element_at(failed, F.lit(1))["check"]),
    })


def short_circuit(checks: Column) -> Column:
    """The same array with every check after the first failure not applicable."""
    first = F.array_min(F.transform(F.filter(checks, lambda x: x["status"] == FAIL), lambda x: x["check_no"]))
    after = lambda x: F.coalesce(x["check_no"] > first, F.lit(False))
    return F.transform(checks, lambda x: F.struct(x["check_no"].alias("check_no"), x["check"].alias("check"), F.when(after(x), NA).otherwise(x["status"]).alias("status"), F.when(~after(x), x["reason"]).alias("reason")))


def creation_gate(direct_link: Column, url_valid: Column, live_confirmed: Column, source_ref: Column) -> Column:
    """The first of four requirements that is missing, null if none is."""
    empty = lambda x: F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""
    no = lambda x: ~F.coalesce(x, F.lit(False))
    return F.when(empty(direct_link), "no direct link").when(no(url_valid), "URL not valid").when(no(live_confirmed), "live stream not confirmed").when(empty(source_ref), "no source reference")


def validation_log(df: DataFrame, keys: Sequence[str], checks: str = "checks") -> DataFrame:
    """One row per row and check: keys, check_no, check, status, reason."""
    return df.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.check_no", "c.check", "c.status", "c.reason")


def validation_text(url: Column, source: Column, at: Column, checks: Column, decision: Column, event_id: Column) -> Column:
    """The log entry of one candidate as lines of text."""
    lines = F.transform(checks, lambda x: F.concat(x["check_no"].cast("string"), F.lit(". "), x["check"], F.lit(": "), x["status"], F.coalesce(F.concat(F.lit(" ("), x["reason"], F.lit(")")), F.lit(""))))
    head = [F.concat(F.lit(f"{k}: "), text_or_empty(v)) for k, v in (("URL", url), ("Source", source), ("Timestamp", at))]
    tail = [F.concat(F.lit("Decision: "), decision), F.concat(F.lit("Event: "), F.coalesce(event_id.cast("string"), F.lit("-")))]
    return F.array_join(F.concat(F.array(*head), lines, F.array(*tail)), "\n")


def check_pass_rates(log: DataFrame, by: Sequence[str] = ("check",)) -> DataFrame:
    """Per check (and what else ``by`` names): how many passed, failed, and the share that passed."""
    passed, failed = F.count_if(F.col("status") == PASS), F.count_if(F.col("status") == FAIL)
    return log.groupBy(*by).agg(passed.alias("passed"), failed.alias("failed"), F.try_divide(passed, passed + failed).alias("pass_rate"))
