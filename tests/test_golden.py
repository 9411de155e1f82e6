"""The twenty golden candidates and their decisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vetspark.plans.vetting import vet_and_reconcile, vet_candidates

YT = "https://www.youtube.com"
LIVE = "BBL LIVE: ALBA Berlin vs FC Bayern"
# id, url, title, local start, free, league, teams, page_text (None: as title), decision, asserted checks
GOLDEN = [
    (1, f"{YT}/@fiba/live", "FIBA LIVE", "06-27 19:00", True, "FIBA", "Germany vs Spain", None, "CREATE", dict.fromkeys(("freeAccess", "liveContent", "officialSource", "topic", "dateTimeRange", "workingLink", "directStream"), "PASS")),
    (2, f"{YT}/@FIBAWorld/live", "FIBA live", "06-27 19:00", True, "FIBA", "Germany vs Spain", None, "SKIP", {"officialSource": "FAIL", "workingLink": "FAIL"}),
    (3, f"{YT}/user/FIBA", "FIBA live", "06-27 20:00", True, "FIBA", "Germany vs Spain", None, "SKIP", {"officialSource": "FAIL"}),
    (4, "https://www.magentasport.de/live/euroleague", "EuroLeague LIVE", "06-26 20:30", True, "EuroLeague", "FC Bayern vs Real Madrid", None, "CREATE", {"freeAccess": "PASS", "officialSource": "PASS"}),
    (5, "https://www.sky.de/sport", "Basketball LIVE auf Sky", "06-27 19:00", False, "BBL", "ALBA Berlin vs Ulm", None, "SKIP", {"freeAccess": "FAIL", "officialSource": "FAIL"}),
    (6, "https://www.sportschau.de/highlights", "Basketball Highlights", "06-24 10:00", True, "BBL", "", None, "SKIP", {"liveContent": "FAIL"}),
    (7, f"{YT}/user/TheDBBTV", "DBB Basketball LIVE", "06-28 18:00", True, "FIBA", "Germany vs France", None, "CREATE", {"officialSource": "PASS"}),
    (8, f"{YT}/channel/UCabc", "Basketball live", "06-27 19:00", True, "", "", None, "SKIP", {"officialSource": "FAIL"}),
    (9, "https://www.albaberlin.de/live", "ALBA BERLIN LIVE", "06-28 19:00", True, "BBL", "ALBA vs Ulm", None, "CREATE", dict.fromkeys(("freeAccess", "liveContent", "officialSource", "topic", "dateTimeRange", "workingLink", "directStream"), "PASS")),
    (10, "https://pluto.tv/live", "Dyn Basketball LIVE", "06-29 18:00", True, "BBL", "FC Bayern Muenchen vs Ulm", None, "CREATE", {"freeAccess": "PASS", "liveContent": "PASS", "officialSource": "PASS", "topic": "PASS"}),
    (11, f"{YT}/@fiba/live", "FIBA replay", "06-25 19:00", True, "FIBA", "Germany vs Spain", None, "SKIP", {"dateTimeRange": "FAIL"}),
    (12, f"{YT}/@fiba/live", "FIBA upcoming", "07-05 19:00", True, "FIBA", "Germany vs Spain", None, "SKIP", {"dateTimeRange": "FAIL"}),
    (13, "https://www.sportschau.de/live", LIVE, "06-27 19:00", True, "BBL", "ALBA vs Bayern", None, "SKIP", {}),
    (14, "https://www.sportschau.de/live", LIVE, "06-27 21:00", True, "BBL", "", None, "CREATE", {}),
    (15, "https://www.sportschau.de/live", LIVE, "06-27 17:00", True, "BBL", "ALBA vs Ulm", None, "CREATE", {}),
    (16, "https://www.sportschau.de/live", LIVE, "06-28 19:00", True, "BBL", "ALBA vs Bayern", None, "CREATE", {}),
    (17, "https://www.magenta.tv/tv/live-a/1", "EuroLeague LIVE", "06-26 20:30", True, "EuroLeague", "FC Bayern vs Valencia", None, "SKIP", {"freeAccess": "FAIL"}),
    (18, "https://www.magenta.tv/tv/live-b/2", "EuroLeague LIVE kostenlos fuer alle", "06-26 20:30", True, "EuroLeague", "FC Bayern vs Real Madrid", None, "CREATE", {"freeAccess": "PASS", "officialSource": "PASS"}),
    (19, "https://www.magentasport.de/live", "EuroLeague LIVE Kostenlos", "06-26 20:30", True, "EuroLeague", "FC Bayern vs Olympia", "live kostenlos fuer alle", "CREATE", {"freeAccess": "PASS"}),
    (20, "https://www.magenta.tv/tv/live-c/3", "EuroLeague LIVE", "06-26 20:30", False, "EuroLeague", "FC Bayern vs Real Madrid", "live mit MagentaSport Abo", "SKIP", {"freeAccess": "FAIL"}),
]


def utc(local: str) -> dt.datetime:
    return dt.datetime.strptime(f"2026-{local}", "%Y-%m-%d %H:%M") - dt.timedelta(hours=2)


@pytest.fixture(scope="module")
def vetted(spark):
    c = spark.createDataFrame(
        [(i, u, t, p or t, lg, tm, utc(s), fr, "ref") for i, u, t, s, fr, lg, tm, p, _, _ in GOLDEN],
        "cand_id long, url string, title string, page_text string, league string, teams string, start_ts timestamp_ntz, free_tier boolean, source_ref string",
    )
    probes = c.select("url", F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("final_url")).distinct()
    said = spark.createDataFrame([("fc bayern muenchen|real madrid", dt.date(2026, 6, 26))], "pair_key string, local_date date")
    existing = spark.createDataFrame(
        [(100, "alba berlin|fc bayern muenchen", utc("06-27 19:00")), (101, None, utc("06-27 21:00")), (102, "alba berlin|mbc", utc("06-27 17:15"))],
        "event_id long, pair_key string, start_ts timestamp_ntz",
    )
    return {r.cand_id: r for r in vet_and_reconcile(vet_candidates(c, probes, said, "2026-06-26"), existing).collect()}


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: str(c[0]))
def test_golden(vetted, case):
    row = vetted[case[0]]
    checks = {c.check: c.status for c in row.checks}
    assert {k: checks[k] for k in case[9]} == case[9], row.reasons
    assert row.decision == case[8], row.reasons
    assert (row.decision == "CREATE") == (row.reason is None)


def test_duplicate_names_event(vetted):
    assert vetted[13].matched_event == 100 and vetted[14].matched_event is None
