"""From candidates to entities: teams, games, event records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.columns import end_time, fold_text, fresh, iso_offset, pair_key, strip, text_or_empty, to_local
from .joins import join_grouped


def normalise(df: DataFrame, column: str, aliases: DataFrame, out: str | None = None) -> DataFrame:
    """Replaces aliases by canonical names, compared folded; unknown names stay.  Of several canonical names the smallest counts."""
    alias, canonical = fresh(df, "alias", "canonical")
    dim = aliases.groupBy(strip(fold_text(F.col("alias"))).alias(alias)).agg(F.min("canonical").alias(canonical))
    joined = join_grouped(df, dim, strip(fold_text(F.col(column))), alias)
    return joined.withColumn(out or column, F.coalesce(canonical, column)).drop(canonical)


def split_pair(text: Column, separator: str = r"\s+vs\.?\s+") -> Column:
    """(first, second) of a text like ``A vs B``; blanks are null, and without separator both are."""
    parts = F.split(text, separator, 2)
    side = lambda i: F.when(F.size(parts) == 2, F.nullif(strip(F.get(parts, F.lit(i))), F.lit("")))
    return F.struct(side(0).alias("first"), side(1).alias("second"))


def extract_game(df: DataFrame, aliases: DataFrame | None = None, teams: str = "teams", title: str = "title") -> DataFrame:
    """Adds team1, team2 (canonical if ``aliases`` are given) and pair_key, from the teams or else the title."""
    both = F.coalesce(F.nullif(strip(F.col(teams)), F.lit("")), F.col(title))
    (pair,) = fresh(df, "pair")
    out = df.withColumn(pair, split_pair(both)).withColumns({"team1": F.col(f"{pair}.first"), "team2": F.col(f"{pair}.second")}).drop(pair)
    for t in ("team1", "team2") if aliases is not None else ():
        out = normalise(out, t, aliases)
    return out.withColumn("pair_key", pair_key(F.col("team1"), F.col("team2")))


def game_record(
    df: DataFrame, validated_at: str, aliases: DataFrame | None = None, tz: str = P.TIMEZONE, teams: str = "teams", title: str = "title",
    league: str = "league", start: str = "start_ts", link: str = "url", free: str = "free_tier", source_ref: str = "source_ref",
) -> DataFrame:
    """Adds what is taken down of a game: teams and pair_key as :func:`extract_game`, and league, start, link, access, source_ref, validated_at.

    ``league``: stripped, or else the title's beginning up to a colon; ``start`` as ISO 8601 with its offset in ``tz``; ``access``:
    ``free`` or ``restricted`` by the flag, ``unknown`` without; ``source_ref``: the link where none is given.  Blanks are null.
    """
    said = lambda c: F.nullif(strip(F.col(c).cast("string")), F.lit(""))
    reference = F.coalesce(said(source_ref), said(link)) if source_ref in df.columns else said(link)
    return extract_game(df, aliases, teams, title).withColumns({
        "league": F.coalesce(said(league), F.nullif(strip(F.regexp_extract(F.col(title), r"^([^:]+):", 1)), F.lit(""))), "start": iso_offset(F.col(start), tz), "link": said(link),
        "access": F.when(F.col(free), "free").when(~F.col(free), "restricted").otherwise("unknown"), "source_ref": reference, "validated_at": F.lit(validated_at),
    })


def event_colour(league: Column, event_type: Column, strict: bool = False) -> Column:
    """Colour of an event: internationals, finals of the cup leagues, everything else.

    A null or empty league gives null, or an error if ``strict``; one of blanks only counts as any other.
    """
    name, kind = strip(F.lower(league)), strip(F.lower(F.coalesce(event_type, F.lit("regular"))))
    missing = F.raise_error(F.lit("league must not be empty")).cast("string") if strict else F.lit(None).cast("string")
    return (
        F.when(league.isNull() | (league == ""), missing)
        .when(name.isin(*P.INTERNATIONAL), P.COLOUR_INTERNATIONAL)
        .when(name.isin(*P.CUP_LEAGUES) & kind.isin(*P.FINAL_TYPES), P.COLOUR_FINAL)
        .otherwise(P.COLOUR_OTHER)
    )


def event_record(df: DataFrame, config: Mapping[str, str] | None = None, start: str = "start_ts", tz: str = P.TIMEZONE) -> DataFrame:
    """The event rows to publish: summary, start and end, colour, zone, visibility, description with all links.

    Needs league, event_type, team1, team2, ``start``, links (array of source, url), access, source_ref, validated_at.
    """
    c = {"calendar_id": "", "visibility": "public"} | dict(config or {})
    s = F.col(start)
    links = F.array_join(F.transform("links", lambda x: F.concat(x["source"], F.lit(": "), x["url"])), "\n")
    lines = [
        F.concat(F.lit("League: "), text_or_empty(F.col("league"))), F.concat(F.lit("Teams: "), F.concat_ws(" vs ", "team1", "team2")), F.concat(F.lit("Date/Time: "), F.coalesce(iso_offset(s, tz), F.lit(""))),
        F.lit("Free stream links:"), F.coalesce(links, F.lit("")), F.concat(F.lit("Access: "), text_or_empty(F.col("access"))),
        F.concat(F.lit("Source: "), text_or_empty(F.col("source_ref")), F.lit(" at "), text_or_empty(F.col("validated_at"))),
    ]
    playoff = strip(F.lower(F.col("event_type"))) == "playoff"
    return df.select(
        F.concat(F.lit("["), text_or_empty(F.col("league")), F.lit("] "), F.concat_ws(" vs ", "team1", "team2")).alias("summary"),
        s.alias("start_ts"), end_time(s, playoff).alias("end_ts"), iso_offset(s, tz).alias("start_iso"), iso_offset(end_time(s, playoff), tz).alias("end_iso"),
        to_local(s, tz).alias("start_local"), event_colour(F.col("league"), F.col("event_type")).alias("colour"), F.lit(tz).alias("time_zone"),
        F.lit(c["visibility"]).alias("visibility"), F.lit(c["calendar_id"]).alias("calendar_id"), F.array_join(F.array(*lines), "\n").alias("description"),
        pair_key(F.col("team1"), F.col("team2")).alias("pair_key"), "links",
    )
