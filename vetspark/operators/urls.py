"""URL parts, kinds and ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.params import CHANNEL_HOSTS, URL_KINDS, UrlRule
from .joins import join_grouped

VERDICT = "struct<valid:boolean,reason:string,final_url:string>"


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds scheme, host (lower case, without ``www.``), path, query, fragment, first_segment.

    A URL without scheme is read as https.  What can't be parsed, and null, gives nulls.
    """
    u = F.when(F.col(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col(url)).otherwise(F.concat(F.lit("https://"), F.col(url)))
    part = lambda name: F.try_parse_url(u, F.lit(name))
    path = part("PATH")
    return df.withColumns({
        "scheme": F.lower(part("PROTOCOL")), "host": F.regexp_replace(F.lower(part("HOST")), r"^www\.", ""), "path": path,
        "query": part("QUERY"), "fragment": part("REF"), "first_segment": F.nullif(F.split_part(path, F.lit("/"), F.lit(2)), F.lit("")),
    })


def classify_url(df: DataFrame, subject: Column, kinds: Sequence[tuple[str, str]] = tuple(URL_KINDS), name: str = "kind") -> DataFrame:
    """Adds the name of the first pattern that ``subject`` matches, else ``other``."""
    out = F.lit("other")
    for kind, pattern in reversed(kinds):
        out = F.when(subject.rlike(pattern), kind).otherwise(out)
    return df.withColumn(name, out)


def _has_segments(url: Column, segments: str) -> Column:
    return F.coalesce(url.rlike(f"{segments}([/?#]|$)"), F.lit(False))


def url_rule_verdict(url: Column, rules: Sequence[UrlRule], hosts: Sequence[str] | None = None, host: Column | None = None) -> Column:
    """(valid, reason, final_url) by the first rule whose text the URL holds, case and all.

    ``unless`` excuses a URL only if its whole path segments match.  Null and
    blank URLs are invalid.  With ``hosts``, rules bind those hosts only.
    """
    reason: Column = F.lit(None).cast("string")
    for r in reversed(rules):
        hit = url.contains(r.contains)
        if r.unless:
            hit &= ~_has_segments(url, r.unless)
        if hosts is not None and host is not None:
            hit &= F.coalesce(host.isin(*hosts), F.lit(False))
        reason = F.when(hit, r.reason).otherwise(reason)
    reason = F.when(F.coalesce(F.trim(url), F.lit("")) == "", "no URL").otherwise(reason)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), F.when(reason.isNull(), url).alias("final_url")).cast(VERDICT)


def probe_verdict(df: DataFrame, probes: DataFrame, on: str = "url", status: str = "http_status", final: str = "final_url") -> DataFrame:
    """Adds ``http_status`` and ``probe``: invalid without a status ("HTTP error") or from 400 on, else valid with the final URL.

    ``probes`` has one row per URL; the newest wins if it has ``probed_at`` and more, else the largest status.
    """
    newest = F.struct(*([F.col("probed_at")] if "probed_at" in probes.columns else []), F.col(status), F.col(final) if final in probes.columns else F.lit(None).cast("string").alias(final))
    key, found = fresh(df, "on", "probe")
    own = probes.groupBy(F.col(on).alias(key)).agg(F.max(newest).alias(found))
    out = join_grouped(df, own, F.col(on), key)
    s, url = F.col(f"{found}.{status}"), F.col(on).cast("string")
    reason = F.when(s.isNull(), "HTTP error").when(s >= 400, F.concat(F.lit("HTTP "), s.cast("string")))
    verdict = F.struct(reason.isNull().alias("valid"), reason.alias("reason"), F.when(reason.isNull(), F.coalesce(F.col(f"{found}.{final}"), url)).alias("final_url")).cast(VERDICT)
    return out.withColumns({"http_status": s, "probe": verdict}).drop(found)


def live_url_rule(
    url: Column, host: Column, hosts: Sequence[str] = tuple(CHANNEL_HOSTS), exempt: str | None = "/user/TheDBBTV",
    live: Sequence[str] = ("/live", "live=", "/@"), on_host: Column | None = None,
) -> Column:
    """False for a URL on ``hosts`` (or below) that doesn't point at a live page; true elsewhere.

    A live page's URL holds one of ``live`` or the path segments ``exempt``.  ``on_host`` says instead of ``hosts`` which URLs are bound.
    """
    bound = F.lit(False) if on_host is None else on_host
    for h in hosts if on_host is None else ():
        bound |= (host == h) | host.endswith("." + h)
    ok = F.lit(False)
    for x in live:
        ok |= url.contains(x)
    if exempt:
        ok |= _has_segments(url, exempt)
    return F.coalesce(~bound | ok, F.lit(True))


def split_by_verdict(df: DataFrame, verdict: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """The rows that go on, and the rejected ones with their ``reason``."""
    ok = F.coalesce(F.col(f"{verdict}.valid"), F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.coalesce(F.col(f"{verdict}.reason"), F.lit("no verdict")))


def reason_counts(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(reason, n): accepted rows count under ``accepted``."""
    return df.groupBy(F.when(F.col(f"{verdict}.valid"), "accepted").otherwise(F.coalesce(F.col(f"{verdict}.reason"), F.lit("no verdict"))).alias("reason")).agg(F.count("*").alias("n"))
