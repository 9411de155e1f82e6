"""From candidates to decisions and events, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.columns import Vocabulary, fresh, strip
from ..operators import checks as C
from ..operators import urls as U
from ..operators.entities import extract_game
from ..operators.reconcile import duplicate_match
from ..sources.readers import existing_for

#: Words of a stream that is announced.
AHEAD = ("upcoming", "scheduled")


def vet_candidates(candidates: DataFrame, probes: DataFrame, announcements: DataFrame, as_of: str, tz: str = P.TIMEZONE) -> DataFrame:
    """Candidates without ``page_text``, with ``checks``, ``decision``, ``reasons``, ``reason``, team1, team2, pair_key.

    ``candidates``: cand_id, url, title, page_text, league, teams, start_ts (instant as UTC wall-clock), free_tier.
    ``probes``: url, http_status, final_url.  ``announcements``: pair_key, local_date.  ``cand_id`` must be unique.
    What the page's text decides is decided where it is read, so that no join moves it.
    """
    spark = candidates.sparkSession
    df = U.with_url_parts(candidates).withColumn("verdict", U.url_rule_verdict(F.col("url"), P.URL_RULES))
    said = F.concat_ws(" ", "title", "page_text")
    words = F.concat_ws(" ", "url", "title", "page_text")
    known = F.coalesce(strip(F.col("league")), F.lit("")) != ""
    vocabulary = Vocabulary(P.PAID_TERMS, P.PAID_BRANDS, P.FREE_TERMS, P.LIVE_TERMS, P.REPLAY_TERMS, P.TOPIC_TERMS, P.OTHER_TOPICS, AHEAD)
    by_text, *places = fresh(df, "by_text", "url", "title", "page_text", "rest")
    in_ = dict(zip(("url", "title", "page_text", "rest"), map(F.col, places), strict=True))
    each = (F.col("url"), F.col("title"), F.col("page_text"), F.concat_ws(" ", "league", "teams"))
    df = df.withColumns({name: vocabulary.hits(x) for name, x in zip(places, each, strict=True)})  # the one pass over the page's text
    in_said, in_words, in_all = F.concat(in_["title"], in_["page_text"]), F.concat(in_["url"], in_["title"], in_["page_text"]), F.concat(in_["title"], in_["page_text"], in_["rest"])
    scheduled = F.col("page_text").isNotNull() & F.col("start_ts").isNotNull() & C.has_word(words, AHEAD, folded=True, hits=in_words)
    df = df.withColumn(by_text, F.struct(
        C.check_free_access(said, F.col("free_tier"), hits=in_said)["reason"].alias("free"), C.check_live_content(words, scheduled, hits=in_words).alias("live"),
        C.has_word(said, P.PAID_BRANDS, folded=True, hits=in_said).alias("brand"),
        C.check_topic(F.concat_ws(" ", said, "league", "teams"), known=known, hits=in_all).alias("topic"), C.check_direct_stream(F.when(F.col("page_text").isNotNull(), words), scheduled).alias("direct"),
    )).drop("page_text", *places)
    df = U.probe_verdict(df, probes)
    df = C.match_domains(df, P.approved_sources(spark))
    df = C.platform_rule(df, P.FREE_PLATFORMS)
    df = extract_game(df, P.team_aliases(spark))
    df = df.withColumn("local_date", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("start_ts").cast("timestamp_ntz"))))
    gated = (F.col("host") == "magenta.tv") | F.col("host").endswith(".magenta.tv")
    df = C.announcement_gate(df, announcements, gated, ["pair_key", "local_date"])

    text = F.col(by_text)
    reason = F.coalesce(text["free"], F.when(~F.col("announced"), "no announcement"), F.when(F.col("platform_free") == F.lit(False), "platform not free"))
    ok_url = F.col("verdict.valid") & F.col("probe.valid") & U.live_url_rule(F.col("url"), F.col("host"))
    return C.decide(df.withColumn("checks", C.check_array({
        "freeAccess": C.result(reason), "liveContent": text["live"],
        "officialSource": C.result(F.coalesce(F.when(~F.col("verdict.valid"), F.col("verdict.reason")), F.when(text["brand"], "excluded brand"), C.check_official_source(F.col("host"), F.col("path"), F.col("matched"))["reason"])),
        "topic": text["topic"], "dateTimeRange": C.check_date_window(F.col("start_ts"), as_of, tz=tz),
        "workingLink": C.check_working_link(F.col("http_status"), ok_url, F.col("probe.final_url")), "directStream": text["direct"],
    })).drop(by_text))


def vet_and_reconcile(vetted: DataFrame, existing: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Adds matched_event; a created candidate that an existing event matches is skipped as a duplicate.

    ``existing``: event_id, pair_key, start_ts; only the part around the candidates' starts is read.  ``candidates``: what ``vetted``
    was made of, so that their starts come from one column of the source; else ``vetted`` is run for them.
    """
    near = existing_for(vetted if candidates is None else candidates, existing, "start_ts", "start_ts")
    out = duplicate_match(vetted, near, "cand_id", "event_id", "start_ts", "start_ts", "pair_key", "pair_key")
    twice = F.col("matched_event").isNotNull()
    return out.withColumns({
        "decision": F.when(twice, "SKIP").otherwise(F.col("decision")),
        "reasons": F.when(twice, F.concat("reasons", F.array(F.lit("duplicate")))).otherwise(F.col("reasons")),
        "reason": F.coalesce("reason", F.when(twice, "duplicate")),
    })

