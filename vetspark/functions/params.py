"""Default parameters.  All operators take their own; these are the ones of the streaming-guide domain."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

TIMEZONE = "Europe/Berlin"

# The approved sources, by tier.
APPROVED = {
    1: {"FIBA": ["fiba.basketball", "fiba.com"], "EuroLeague": ["euroleaguebasketball.net"], "Basketball Bundesliga": ["basketball-bundesliga.de"], "DBB": ["basketball-bund.de"]},
    2: {"Sportschau": ["sportschau.de", "ard.de", "ardmediathek.de"], "ZDF": ["zdf.de", "zdfmediathek.de"]},
    3: {"MDR": ["mdr.de"], "BR24": ["br.de", "br24.de"], "RBB24": ["rbb-online.de", "rbb24.de"]},
    4: {"Dyn Sport Mix": ["amazon.de", "primevideo.com", "joyn.de", "pluto.tv", "zattoo.com"], "MagentaSport": ["magentasport.de", "magenta.tv"]},
    5: {
        "ALBA BERLIN": ["albaberlin.de"],
        "BMA365 Bamberg Baskets": ["bamberg-baskets.de"],
        "Basketball Löwen Braunschweig": ["basketball-braunschweig.de"],
        "EWE Baskets Oldenburg": ["ewe-baskets.de"],
        "FC Bayern München Basketball": ["fcbayern.com"],
        "FIT/One Würzburg Baskets": ["wuerzburg-baskets.de"],
        "MHP RIESEN Ludwigsburg": ["mhpriesen.de"],
        "MLP Academics Heidelberg": ["academics-basketball.de"],
        "NINERS Chemnitz": ["niners-chemnitz.de"],
        "RASTA Vechta": ["rasta-vechta.de"],
        "ratiopharm ulm": ["ratiopharm-ulm.de"],
        "ROSTOCK SEAWOLVES": ["rostock-seawolves.de"],
        "Science City Jena": ["sciencecitybasketball.de"],
        "SKYLINERS": ["skygermany.de"],
        "SYNTAINICS MBC": ["mitteldeutscherbbc.de"],
        "Telekom Baskets Bonn": ["telekom-baskets.de"],
        "Veolia Towers Hamburg": ["towers-hamburg.de"],
        "VET-CONCEPT Gladiators Trier": ["gladiators-trier.de"],
    },
}
# Approved channels on a video site, by the first part of the path.
CHANNELS = ["@fiba", "@bbl_basketball", "@EuroLeague", "user/TheDBBTV"]
CHANNEL_HOSTS = ["youtube.com", "youtu.be"]
# Whose channels they are (tier 6), and who is found through a site of tier 5 instead.
CHANNEL_NAMES = {"@fiba": "FIBA (official)", "user/TheDBBTV": "DBB - Deutscher Basketball Bund", "@bbl_basketball": "Basketball Bundesliga", "@EuroLeague": "EuroLeague"}
CHANNEL_VIA = {"ALBA Berlin": "albaberlin.de", "FC Bayern Basketball": "fcbayern.com"}
# Excluded sources and why.
EXCLUDED = {"Sky Sport": "Paid subscription", "DAZN": "Paid subscription", "Sport1+": "Paid", "Amazon Prime (general)": "Paid (Dyn Sport Mix free tier only)", "Pirate/aggregator sites": "Unofficial", "Third-party stream sites": "Unofficial"}
# Vocabularies of the checks.
PAID_TERMS = ["Abo", "kostenpflichtig", "pay-per-view", "subscription", "mit MagentaSport Abo", "nur für Abonnenten", "Login erforderlich", "Registration required"]
PAID_BRANDS = ["Sky", "DAZN", "Prime", "Sport1+"]
FREE_TERMS = ["free", "kostenlos", "gratis", "kostenlos für alle", "ohne Abo", "ohne Login", "für alle zugänglich"]
REPLAY_TERMS = ["highlights", "replay", "zusammenfassung", "on demand", "wiederholung"]
LIVE_TERMS = ["live"]
TOPIC_TERMS = ["Basketball", "BBL", "EuroLeague", "Basketball Champions League", "FIBA", "ProA", "ProB"]
OTHER_TOPICS = ["Fußball", "Handball", "Eishockey", "Tennis", "Volleyball"]
FREE_PLATFORMS = {"joyn.de": True, "pluto.tv": True, "zattoo.com": True, "amazon.de": False, "primevideo.com": False}
TEAM_ALIASES = {"Alba Berlin": "ALBA Berlin", "ALBA": "ALBA Berlin", "Bayern Munich": "FC Bayern München", "FC Bayern": "FC Bayern München", "Bayern": "FC Bayern München", "Ulm": "ratiopharm ulm", "Ratiopharm Ulm": "ratiopharm ulm"}
# Colours of events.
INTERNATIONAL = ["fiba", "fiba international", "fiba world cup", "fiba eurobasket"]
CUP_LEAGUES = ["euroleague", "euro league", "basketball champions league", "bcl"]
FINAL_TYPES = ["final", "finals", "championship", "semifinal", "semifinals"]
COLOUR_INTERNATIONAL, COLOUR_FINAL, COLOUR_OTHER = "2", "11", "6"


@dataclass(frozen=True)
class UrlRule:
    """Rejects a URL that holds ``contains``, unless the path has the segments ``unless``."""

    contains: str
    reason: str
    unless: str | None = None


# The ordered URL rules.
URL_RULES = [
    UrlRule("@FIBAWorld", "not an official channel"),
    UrlRule("/user/", "legacy user address", unless="/user/TheDBBTV"),
    UrlRule("/channel/", "channel address is no direct stream"),
]
#: Kinds of URL, in order: the first pattern that matches the path names it.
URL_KINDS = [("handle_live", r"^/@[^/]+/live/?$"), ("handle", r"^/@[^/]+/?$"), ("user", r"^/user/"), ("channel", r"^/channel/"), ("watch", r"^/watch")]


def approved_sources(spark: SparkSession) -> DataFrame:
    """(tier, name, domain): one row per approved domain."""
    rows = chain.from_iterable([(tier, name, d) for d in domains] for tier, own in APPROVED.items() for name, domains in own.items())
    return spark.createDataFrame([*rows], "tier int, name string, domain string")


def approved_channels(spark: SparkSession) -> DataFrame:
    """(tier, name, host, channel, via): the channels of tier 6; ``via`` is the site that links to a channel whose address isn't listed."""
    listed = [(6, CHANNEL_NAMES[c], CHANNEL_HOSTS[0], c, None) for c in CHANNELS]
    return spark.createDataFrame([*listed, *((6, name, CHANNEL_HOSTS[0], None, site) for name, site in CHANNEL_VIA.items())], "tier int, name string, host string, channel string, via string")


def excluded_sources(spark: SparkSession) -> DataFrame:
    """(source, reason)."""
    return spark.createDataFrame([*EXCLUDED.items()], "source string, reason string")


def vocabularies(spark: SparkSession) -> DataFrame:
    """(vocabulary, term): the words of every check, a row each."""
    own = {"paid": PAID_TERMS, "paid_brand": PAID_BRANDS, "free": FREE_TERMS, "replay": REPLAY_TERMS, "live": LIVE_TERMS, "topic": TOPIC_TERMS, "other_topic": OTHER_TOPICS}
    return spark.createDataFrame([(name, term) for name, terms in own.items() for term in terms], "vocabulary string, term string")


def team_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*TEAM_ALIASES.items()], "alias string, canonical string")
