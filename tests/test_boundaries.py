"""Boundary rows of the operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vetspark.functions import columns as K
from vetspark.functions import params as P
from vetspark.operators import checks as C
from vetspark.operators import conformance as V
from vetspark.operators import entities as D
from vetspark.operators import reconcile as R
from vetspark.operators import scoring as S
from vetspark.operators import urls as U
from vetspark.sources.readers import candidate_scan, case_source, existing_scan, raw_case_source
from vetspark.sources.sinks import event_sink, log_sink
from vetspark.sources.store import stored_events
from vetspark.streaming.delivery import deliver

T0 = dt.datetime(2026, 6, 27, 17)


def values(spark, data, column, kind="string"):
    """A column expression over one column ``x``."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r.y for r in df.withColumn("y", column).orderBy("i").collect()]


# ------------------------------------------------------------------ columns


def test_folding_and_words(spark):
    assert values(spark, ["Für ÄÖÜß", None], K.fold_text(F.col("x"))) == ["fuer aeoeuess", None]
    assert values(spark, ["SKYLINERS win", "auf Sky!", "Sky", None], K.has_word(F.col("x"), ["Sky"])) == [False, True, True, False]
    assert values(spark, ["mit uns", "MIT License"], K.has_word(F.col("x"), ["MIT"])) == [False, True]
    assert values(spark, ["nur fuer Abonnenten", "für alle"], K.has_word(F.col("x"), ["für"], folded=True)) == [True, True]
    assert values(spark, ["a", ""], K.has_word(F.col("x"), [])) == [False, False]


def test_strip_and_numbers(spark):
    assert values(spark, [" \n a b\t\n", ""], K.strip(F.col("x"))) == ["a b", ""]
    assert values(spark, [" 01 ", "abc", "7", None, "1_0"], K.try_int(F.col("x"))) == [1, None, 7, None, None]


def test_local_time_over_clock_changes(spark):
    data = [dt.datetime(2026, 3, 29, 0, 59), dt.datetime(2026, 3, 29, 1, 0), dt.datetime(2026, 10, 25, 0, 59), dt.datetime(2026, 10, 25, 1, 0)]
    assert values(spark, data, K.iso_offset(F.col("x"), "Europe/Berlin"), "timestamp_ntz") == ["2026-03-29T01:59:00+01:00", "2026-03-29T03:00:00+02:00", "2026-10-25T02:59:00+02:00", "2026-10-25T02:00:00+01:00"]
    assert values(spark, [T0], K.iso_offset(F.col("x"), "America/St_Johns"), "timestamp_ntz") == ["2026-06-27T14:30:00-02:30"]


# ------------------------------------------------------------------ URLs


def test_url_parts(spark):
    df = spark.createDataFrame([(u,) for u in ("youtube.com/@a/live", "HTTPS://WWW.Ex.DE/p?q=1#f", "http://[bad", None, "x.de")], "url string")
    got = {r.url: (r.host, r.path, r.query, r.first_segment) for r in U.with_url_parts(df).collect()}
    assert got["youtube.com/@a/live"][:2] == ("youtube.com", "/@a/live") and got["HTTPS://WWW.Ex.DE/p?q=1#f"] == ("ex.de", "/p", "q=1", "p")
    assert got["http://[bad"][0] is None and got[None] == (None,) * 4 and got["x.de"][0] == "x.de"


def test_url_rules(spark):
    data = ["https://youtube.com/user/TheDBBTV", "https://youtube.com/user/TheDBBTVfake", "https://a.de/user/x", "https://youtube.com/@FIBAWorld/user/x", "https://youtube.com/channel/UC", "https://a.de", None, " "]
    got = values(spark, data, U.url_rule_verdict(F.col("x"), P.URL_RULES)["reason"])
    assert got[0] is None and got[5] is None and got[1] == got[2] == "legacy user address" and got[3] == "not an official channel" and got[6] == got[7] == "no URL"
    host = F.lit("a.de")
    assert values(spark, ["https://a.de/user/x"], U.url_rule_verdict(F.col("x"), P.URL_RULES, ["youtube.com"], host)["valid"]) == [True]


def test_live_url(spark):
    df = U.with_url_parts(spark.createDataFrame([(u,) for u in ("https://youtu.be/x", "https://www.youtube.com/@A", "https://youtube.com/user/TheDBBTV", "https://youtube.com/watch?v=1&live=1", "https://a.de/x", "https://notyoutube.com/x")], "url string"))
    assert [r.ok for r in df.select(U.live_url_rule(F.col("url"), F.col("host")).alias("ok")).collect()] == [False, True, True, True, True, True]


def test_probes(spark):
    codes = (199, 200, 204, 302, 399, 400, 404, 500)
    df = spark.createDataFrame([(str(c),) for c in codes] + [("none",)], "url string")
    probes = spark.createDataFrame([(str(c), c, "final" if c == 200 else None) for c in codes], "url string, http_status int, final_url string")
    got = {r.url: r for r in U.probe_verdict(df, probes).withColumn("check", C.check_working_link(F.col("http_status"), F.lit(True), F.col("probe.final_url"))["reason"]).collect()}
    assert [u for u, r in got.items() if not r.probe.valid] and {u for u, r in got.items() if not r.probe.valid} == {"400", "404", "500", "none"}
    assert got["none"].probe.reason == "HTTP error" and got["200"].probe.final_url == "final" and got["204"].probe.final_url == "204"
    assert {u for u, r in got.items() if r.check is None} == {"200"}
    good, bad = U.split_by_verdict(U.probe_verdict(df, probes), "probe")
    assert good.count() == 5 and {r.reason for r in bad.collect()} == {"HTTP 400", "HTTP 404", "HTTP 500", "HTTP error"}


def test_domains(spark):
    hosts = ["albaberlin.de", "live.albaberlin.de", "notalbaberlin.de", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    assert [r.matched and r.matched.tier for r in C.match_domains(df, P.approved_sources(spark)).orderBy("i").collect()] == [5, 5, None, None]


# ------------------------------------------------------------------ checks


def test_free_access(spark):
    data = ["ohne Abo", "mit Abo", "für alle zugänglich", "fuer alle zugaenglich", "nur für Abonnenten, gratis", "kostenlos auf DAZN", "gratis, 4,99 €", "nichts", None, "kostenlos und Abo"]
    assert values(spark, data, C.check_free_access(F.col("x"))["status"]) == ["PASS", "FAIL", "PASS", "PASS", "FAIL", "FAIL", "FAIL", "FAIL", "FAIL", "FAIL"]
    assert values(spark, ["nichts", "gratis"], C.check_free_access(F.col("x"), F.lit(True))["status"]) == ["PASS", "PASS"]
    assert values(spark, ["gratis"], C.check_free_access(F.col("x"), F.lit(False))["status"]) == ["FAIL"]


def test_other_checks(spark):
    assert values(spark, ["LIVE", "live replay", "delivery", None], C.check_live_content(F.col("x"))["status"]) == ["PASS", "FAIL", "FAIL", "FAIL"]
    assert values(spark, ["BBL", "Fußball und BBL", "fussball", "x", None], C.check_topic(F.col("x"))["status"]) == ["PASS", "FAIL", "FAIL", "FAIL", "FAIL"]
    assert values(spark, ["<video src=x>", "<b>Live</b>", "deliver", None], C.check_direct_stream(F.col("x"))["reason"]) == [None, None, "no stream on the page", "page unreadable"]


def test_date_window(spark):
    local = [dt.datetime(2026, 6, 25, 23, 59, 59), dt.datetime(2026, 6, 26), dt.datetime(2026, 7, 3, 23, 59, 59, 999000), dt.datetime(2026, 7, 4)]
    data = [t - dt.timedelta(hours=2) for t in local] + [None]
    assert values(spark, data, C.check_date_window(F.col("x"), "2026-06-26")["reason"], "timestamp_ntz") == ["in the past", None, None, "too far ahead", "date cannot be determined"]
    hours = [dt.datetime(2026, 6, 27, h, m) - dt.timedelta(hours=2) for h, m in ((13, 59), (14, 0), (23, 0), (23, 1))]
    assert values(spark, hours, C.usual_hours(F.col("x")), "timestamp_ntz") == [False, True, True, False]


def test_decision_and_log(spark):
    ok, bad = C.result(F.lit(None).cast("string")), C.result(F.lit("why"))
    df = C.decide(spark.range(1).withColumn("checks", C.check_array({"a": ok, "b": bad, "c": bad, "d": ok})))
    r = df.withColumn("short", C.short_circuit(F.col("checks"))).withColumn("text", C.validation_text(F.lit("u"), F.lit(None), F.lit("t"), F.col("checks"), F.col("decision"), F.lit(None))).first()
    assert (r.decision, r.reason, r.reasons) == ("SKIP", "why", ["why", "why"]) and [c.status for c in r.short] == ["PASS", "FAIL", "N/A", "N/A"]
    assert r.text.split("\n")[3:5] == ["1. a: PASS", "2. b: FAIL (why)"] and r.text.endswith("Decision: SKIP\nEvent: -")
    rates = {x.check: (x.passed, x.failed, x.pass_rate) for x in C.check_pass_rates(C.validation_log(df, ["id"])).collect()}
    assert rates["a"] == (1, 0, 1.0) and rates["b"] == (0, 1, 0.0)
    assert C.decide(spark.range(1).withColumn("checks", C.check_array({"a": ok}))).first().decision == "CREATE"


def test_creation_gate(spark):
    gate = lambda *v: spark.range(1).select(C.creation_gate(*[F.lit(x) for x in v]).alias("y")).first().y
    assert gate("u", True, True, "s") is None and gate(None, True, True, "s") == "no direct link" and gate("u", None, True, "s") == "URL not valid"
    assert gate("u", True, False, "s") == "live stream not confirmed" and gate("u", True, True, " ") == "no source reference"


# ------------------------------------------------------------------ entities


COLOURS = [("BBL", "final", "6"), ("EuroLeague", "regular", "6"), ("EuroLeague", "playoff", "6"), ("EuroLeague", "Final", "11"), ("euro league", "finals", "11"), (" EUROLEAGUE ", " semifinal ", "11"), ("EuroLeague", "semifinals", "11"), ("EuroLeague", "championship", "11"), ("FIBA", "final", "2"), ("fiba world cup", "regular", "2"), ("FIBA EuroBasket", None, "2"), ("FIBA International", "x", "2"), ("BCL", "final", "11"), ("Basketball Champions League", "regular", "6"), ("ProA", "final", "6"), ("EuroLeague", None, "6"), ("", "final", None), (None, "final", None), ("  ", "final", "6")]


@pytest.mark.parametrize(("league", "kind", "colour"), COLOURS)
def test_colour(spark, league, kind, colour):
    df = spark.createDataFrame([(league, kind)], "l string, k string")
    assert df.select(D.event_colour(F.col("l"), F.col("k")).alias("c")).first().c == colour


def test_strict_colour_raises(spark):
    with pytest.raises(Exception, match="league must not be empty"):
        spark.createDataFrame([("",)], "l string").select(D.event_colour(F.col("l"), F.lit("x"), strict=True)).collect()


def test_games(spark):
    rows = [("ALBA vs Bayern Munich", "t"), ("", "LIVE: Ulm vs. ALBA"), (None, "no pair"), ("A vs ", "x")]
    got = D.extract_game(spark.createDataFrame(rows, "teams string, title string"), P.team_aliases(spark)).collect()
    assert [(r.team1, r.team2) for r in got] == [("ALBA Berlin", "FC Bayern München"), ("LIVE: Ulm", "ALBA Berlin"), (None, None), (None, None)]
    assert got[0].pair_key == "alba berlin|fc bayern muenchen" and got[2].pair_key is None and got[3].pair_key is None


# ------------------------------------------------------------------ reconciliation


@pytest.mark.parametrize("key", [None, "k"])
def test_interval_boundaries(spark, key):
    gaps = [0, 29 * 60 + 59, 1800, 1801, -1799, -1800, -1801]
    c = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=7, seconds=i), "a") for i in range(4)] + [(9, T0, None), (10, None, "a")], "cid long, ts timestamp_ntz, k string")
    e = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=7, seconds=g), "a") for i, g in enumerate(gaps)] + [(20, T0, None), (21, None, "a")], "eid long, ts timestamp_ntz, k string")
    got = {r.cid: (r.matched_event, r.matches) for r in R.duplicate_match(c, e, "cid", "eid", "ts", "ts", key, key).collect()}
    want = {}
    for cid, ts, k in [tuple(r) for r in c.collect()]:
        hit = [(abs(ts - b), i) for i, b, k2 in [tuple(r) for r in e.collect()] if ts and b and abs(ts - b) <= dt.timedelta(minutes=30) and (key is None or k is not None and k == k2)]
        want[cid] = (min(hit)[1] if hit else None, len(hit))
    assert got == want
    assert {r.cid for r in R.new_only(c, e, "cid", "eid", "ts", "ts", key, key).collect()} == {i for i, (m, _) in want.items() if m is None}


def test_interval_join_without_key_has_an_equality(spark):
    c = spark.createDataFrame([(1, T0)], "cid long, ts timestamp_ntz")
    plan = R.duplicate_match(c, c.withColumnRenamed("cid", "eid"), "cid", "eid", "ts", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tiers_links_and_summary(spark):
    df = spark.createDataFrame([("g", 1, "a", "u1"), ("g", 1, "b", "u2"), ("g", 2, "c", "u3"), ("g", 1, "a", "u1"), (None, 3, "d", "u4")], "game string, tier int, source string, url string")
    assert {(r.game, r.url) for r in R.tier_prune(df, ["game"]).collect()} == {("g", "u1"), ("g", "u2"), (None, "u4")}
    untiered = spark.createDataFrame([("g", None, "u1"), ("h", None, "u2"), ("h", 2, "u3")], "game string, tier int, url string").withColumn("__best", F.lit(0))
    assert {r.url for r in R.tier_prune(untiered, ["game"]).collect()} == {"u1", "u3"} and R.tier_prune(untiered, ["game"]).columns == untiered.columns
    assert {(r.game, r.chunk, r.n_links): [x.url for x in r.links] for r in R.merge_links(df, ["game"]).collect()} == {("g", 1, 3): ["u1", "u2", "u3"], (None, 1, 1): ["u4"]}
    flags = spark.createDataFrame([(True, False), (None, True), (False, None)], "r boolean, d boolean")
    assert tuple(R.run_summary(flags, F.col("r"), F.col("d")).first()) == (3, 1, 1, 1, None)
    assert tuple(R.run_summary(flags.filter("r"), F.col("r"), F.col("d")).first())[4] == "found 1 candidates, none passed"
    assert tuple(R.run_summary(flags.limit(0), F.col("r"), F.col("d")).first()) == (0, 0, 0, 0, "no streams found")


# ------------------------------------------------------------------ scans and sinks


def test_scans(spark, tmp_path):
    df = spark.createDataFrame([(s, i) for s in "ab" for i in range(30)], "s string, i int")
    assert candidate_scan(df, "s", [F.desc("i")]).groupBy("s").count().collect()[0]["count"] == 20
    e = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in (-31, -30, 0, 30, 31)], "ts timestamp_ntz")
    assert existing_scan(e, "ts", str(T0), str(T0)).count() == 3
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"skill_name": "x", "evals": [{"id": 1, "prompt": "p", "expected_output": "e", "assertions": ["a"], "files": []}, {"id": "2"}]}))
    assert case_source(spark, str(path)).count() == 2 and [json.loads(r.raw)["id"] for r in raw_case_source(spark, str(path)).orderBy("pos").collect()] == [1, "2"]


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, pair_key string, start_ts timestamp_ntz")


def test_sinks_run_twice(spark, tmp_path):
    path = str(tmp_path / "events")
    first = events(spark, [("1", "a|b", T0), ("2", None, T0), ("3", "a|c", T0)])
    for new in (3, 0):
        assert event_sink(first, path, "2026-06-26") == new and stored_events(spark, path).count() == 3
    event_sink(events(spark, [("4", "a|b", T0 + dt.timedelta(minutes=30)), ("5", "a|b", T0 + dt.timedelta(minutes=31))]), path, "2026-06-27")
    assert {(r.event_id, r.run_date) for r in stored_events(spark, path).collect()} == {("1", "2026-06-26"), ("2", "2026-06-26"), ("3", "2026-06-26"), ("5", "2026-06-27")}
    log = str(tmp_path / "log")
    for day in ("d1", "d2", "d1"):
        log_sink(first, log, day)
    assert spark.read.parquet(log).count() == 6


def test_one_batch_holds_no_duplicates(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("1", "a|b", at(0)), ("2", "a|b", at(5)), ("3", "a|b", at(30)), ("4", "a|b", at(31)), ("5", "a|b", at(61)), ("6", "a|c", at(5)), ("7", " ", at(0)), ("8", " ", at(0)), ("9", None, None), ("9", None, None), ("10", "a|b", None), ("11", "a|b", at(62))]
    kept = {r.event_id for r in R.new_in_batch(events(spark, rows)).collect()}
    assert R.new_in_batch(events(spark, [(None, "a|b", at(0)), (None, "a|b", at(5)), ("1", "a|b", at(6))])).count() == 1
    assert kept == {"1", "4", "6", "7", "8", "9", "10", "11"} and R.new_in_batch(events(spark, rows).limit(0)).count() == 0
    event_sink(events(spark, rows), str(tmp_path / "e"), "2026-06-26")
    assert {r.event_id for r in stored_events(spark, str(tmp_path / "e")).collect()} == kept


def test_blank_keys_match_nothing(spark):
    c = spark.createDataFrame([(1, "", T0), (2, " ", T0), (3, None, T0), (4, "k", T0)], "cid long, k string, ts timestamp_ntz")
    e = c.select(F.col("cid").alias("eid"), "k", "ts")
    assert {r.cid for r in R.new_only(c, e, "cid", "eid", "ts", "ts", "k", "k").collect()} == {1, 2, 3}
    assert {r.cid: r.matches for r in R.duplicate_match(c, e, "cid", "eid", "ts", "ts", "k", "k").collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_clash_counts_equal_brute_force_and_make_no_pairs(spark):
    offsets = [0, 0, 1, 59, 1799, 1800, 1801, 3600, -1800, -1801, 900, 900]
    own = [T0 + dt.timedelta(seconds=s) for s in offsets] + [T0 + dt.timedelta(seconds=1800, microseconds=1), None]
    c = spark.createDataFrame([*enumerate(own)], "cid long, ts timestamp_ntz")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(own) if i % 3], "eid long, ts timestamp_ntz")
    out = R.clash_counts(c, e, "cid", "ts", "ts")
    want = {i: sum(t is not None and x is not None and abs((t - x).total_seconds()) <= 1800 for j, x in enumerate(own) if j % 3) for i, t in enumerate(own)}
    assert {r.cand_id: r.clashes for r in out.collect()} == want and R.clash_counts(c.limit(0), e, "cid", "ts", "ts").count() == 0
    assert {r.clashes for r in R.clash_counts(c, e.limit(0), "cid", "ts", "ts").collect()} == {0}


def test_links_are_audited_by_rule_probe_and_status(spark):
    e = spark.createDataFrame([("e", "s", "t", ["https://a.de/user/x", "https://a.de/1", "https://a.de/2", "https://a.de/3", "https://a.de/4", "https://a.de/4", None])], "event_id string, source_ref string, validated_at string, links array<string>")
    probes = spark.createDataFrame([("https://a.de/user/x", 200, None), ("https://a.de/1", 404, None), ("https://a.de/2", 204, None), ("https://a.de/4", 200, None)], "url string, http_status int, final_url string")
    got = {r.link[-1]: (r.source_ref, r.validated_at, r.http_status, r.failed) for r in R.audit_links(e, probes, P.URL_RULES).collect()}
    assert got == {"x": ("s", "t", 200, "legacy user address"), "1": ("s", "t", 404, "HTTP 404"), "2": ("s", "t", 204, "HTTP 204"), "3": ("s", "t", None, "HTTP error")}


def test_parameter_tables(spark):
    channels = {(r.channel, r.via) for r in P.approved_channels(spark).collect()}
    assert {c for c, _ in channels if c} == set(P.CHANNELS) and ("@fiba", None) in channels and (None, "albaberlin.de") in channels
    assert {r.reason for r in P.excluded_sources(spark).filter("source = 'DAZN'").collect()} == {"Paid subscription"}
    assert P.vocabularies(spark).filter("vocabulary = 'paid' and term = 'Abo'").count() == 1


def test_game_records(spark):
    rows = [("A vs B", "BBL: x", None, T0, "https://a.de/1", True, None), (None, "ALBA vs. Ulm", " ", None, " ", None, "r")]
    df = spark.createDataFrame(rows, "teams string, title string, league string, start_ts timestamp_ntz, url string, free_tier boolean, source_ref string")
    a, b = D.game_record(df, "2026-06-26", P.team_aliases(spark)).orderBy("team1").collect()
    assert (a.league, a.link, a.access, a.source_ref, a.validated_at) == ("BBL", "https://a.de/1", "free", "https://a.de/1", "2026-06-26") and a.start.endswith("+02:00")
    assert (b.team1, b.team2, b.league, b.start, b.link, b.access, b.source_ref) == ("ALBA Berlin", "ratiopharm ulm", None, None, None, "unknown", "r")


def test_corpora_fixtures_and_missing_documents(spark):
    docs = spark.createDataFrame([(1, '{"skill_name": "x", "evals": []}'), (2, '{"skill_name": "WRONG", "evals": [{"id": 1}, {"id": 1}]}'), (3, "{"), (4, '{"skill_name": "x"}'), (5, None)], "i int, raw string")
    got = {r.i: r.errors for r in V.corpus_conformance(docs, "raw", "x").collect()}
    assert got == {1: [], 2: ["skill_name is not x: WRONG", "repeated id"], 3: ["not JSON"], 4: ["evals is no list"], 5: ["not JSON"]}
    checks = spark.createDataFrame([("a",), ("b",), ("c",)], "check string")
    runs = spark.createDataFrame([("a", "FAIL"), ("b", "PASS")], "check string, verdict string")
    assert {(r.check, r.problem) for r in V.unproven_checks(checks, runs).collect()} == {("b", "its fixtures pass"), ("c", "no failing fixture")}
    assert [r.warning for r in V.missing_documents(checks.withColumnRenamed("check", "name"), runs.select(F.col("check").alias("name"))).collect()] == ["c: not there, so its references were not looked at"]


def test_page_text_takes_part_in_no_exchange(spark):
    from vetspark.plans.vetting import vet_candidates

    c = spark.createDataFrame([(1, "https://a.de/x", "t", "p", "l", "A vs B", T0, True)], "cand_id long, url string, title string, page_text string, league string, teams string, start_ts timestamp_ntz, free_tier boolean")
    probes = spark.createDataFrame([("https://a.de/x", 200, None)], "url string, http_status int, final_url string")
    said = spark.createDataFrame([("a|b", T0.date())], "pair_key string, local_date date")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vet_candidates(c, probes, said, "2026-06-26")._jdf.queryExecution().sparkPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    joins, stack = 0, [plan]
    while stack:
        node = stack.pop()
        own = items(node.children())
        stack += own
        if "Join" in node.nodeName():
            joins += 1
            assert "page_text" not in [a.name() for child in own for a in items(child.output())]
    assert joins >= 5


def test_stream_adds_nothing_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark, [("1", "a|b", T0)]).write.parquet(source)
    for k in range(2):
        deliver(spark.readStream.schema("event_id string, pair_key string, start_ts timestamp_ntz").parquet(source), lambda df: df, out, str(tmp_path / f"c{k}"), "d").awaitTermination()
    assert stored_events(spark, out).count() == 1


# ------------------------------------------------------------------ scoring and conformance


def test_parsing(spark):
    got = values(spark, ["Do. Input: url=https://x.de/?a=b; free_tier=true; k=1; k=2.", "nothing", None], S.parse_inputs(F.col("x")))
    assert got == [{"url": "https://x.de/?a=b", "free_tier": "true", "k": "2"}, None, None]
    data = ["Decision=SKIP; reason=paid; checks: a=PASS, b=FAIL", "Decision=CREATE; reason=; checks: all PASS", "Decision=CREATE; checks: d=PASS; WARNING: x", "checks: f=PASS (free)"]
    got = values(spark, data, S.parse_expected(F.col("x")))
    assert [(g.decision, g.reason, g.checks, g.all_pass) for g in got] == [("SKIP", "paid", ["a=PASS", "b=FAIL"], False), ("CREATE", None, [], True), ("CREATE", None, ["d=PASS"], False), (None, None, ["f=PASS"], False)]


def test_scoring(spark):
    cases = spark.createDataFrame([(1, "x a=PASS", ["a expected PASS"]), (2, "y", []), (3, "z", ["bad"]), (4, "w", ["b expected FAIL"]), (5, "v", None), (6, "u", [])], "id long, expected_output string, assertions array<string>")
    said = spark.createDataFrame([("1", "x a=PASS\n\n"), (" 02 ", "y"), ("3", "z"), ("4", "w"), ("abc", "v"), ("6", "other"), ("77", "extra")], "key string, output string")
    scores = S.score_cases(cases, said)
    assert {r.id: r.why for r in scores.collect()} == {1: None, 2: None, 3: "malformed assertion", 4: "assertion not met", 5: "no output", 6: "output differs"}
    assert tuple(S.score_summary(scores).first()) == (2, 4, 1)


def test_records(spark):
    rows = ['{"id":1,"expected_output":"x","assertions":[]}', '{"id":"1","expected_output":2,"assertions":"s"}', '{"id":1}', "not json", '{"id":1,"expected_output":"x","assertions":["a",3]}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    out = V.record_conformance(df, "raw", ["id", "expected_output", "assertions"], {"id": "BIGINT", "expected_output": "STRING", "assertions": "ARRAY"}, items={"assertions": "STRING"})
    got = [r.errors for r in out.orderBy("i").collect()]
    assert got[0] == [] and len(got[1]) == 3 and got[2] == ["missing: assertions, expected_output"] and got[3] == got[5] == ["not JSON"] and got[4] == ["assertions[1] is not STRING"]
    first = S.structural_report(df, "raw", [("$.id", "BIGINT", "id"), ("$.expected_output", "STRING", "output")])
    assert [r.problem for r in first.orderBy("i").collect()] == [None, "id", "output", "not JSON", None, "not JSON"]


def document(name="my-doc", description="d", extra="", body="## Use\ntext\n"):
    return f"---\nname: {name}\ndescription: {description}\nversion: 1\ncategory: c\n{extra}---\n{body}"


DOCUMENTS = [(document(), []), (document(description="x" * 1024), []), (document(description="x" * 1025), ["description too long"]), (document(extra="compatibility: " + "y" * 500 + "\n"), []), (document(extra="compatibility: " + "y" * 501 + "\n"), ["compatibility too long"]), (document(name="Bad_Name"), ["another name", "name malformed"]), (document(body="no\n"), ["missing sections: ## Use"]), ("plain", ["no frontmatter", "missing sections: ## Use"]), (document(body="## Use\n" + "l\n" * 249), []), (document(body="## Use\n" + "l\n" * 250), ["body too long"]), ("---\nname: my-doc\n---\n## Use\n", ["missing keys: category, description, version"])]


@pytest.mark.parametrize(("text", "want"), DOCUMENTS)
def test_documents(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert V.document_conformance(df, "text", "my-doc", headings=["## Use"]).first().errors == want


def test_references_and_identifiers(spark):
    df = spark.createDataFrame([("see `a/b.md` and `c.md` and `a/d.md`",)], "text string")
    known = spark.createDataFrame([("a/b.md",)], "path string")
    assert [r.reference for r in V.dangling_references(V.path_references(df, "text"), known).collect()] == ["a/d.md"]
    at = "@group.calendar.google.com"
    data = [None, " ", "YOUR_ID" + at, "a" * 64 + at, "A" * 64 + at, "a" * 63 + at, "a" * 65 + at, "a" * 64]
    assert values(spark, data, V.identifier_problem(F.col("x"))) == ["missing", "blank", "placeholder", None, None, "malformed", "malformed", "malformed"]
    assert spark.range(1).select(V.missing_fields({"tz": F.lit(None), "colour": F.lit("6"), "v": F.lit(" ")}).alias("w")).first().w == ["tz", "v"]


def test_verdicts_name_every_check(spark):
    registry = spark.createDataFrame([("a",), ("b",)], "check string")
    found = spark.createDataFrame([("a",), ("a",)], "check string")
    assert {tuple(r) for r in V.conformance_verdict(registry, found).collect()} == {("a", 2, "FAIL"), ("b", 0, "PASS")}


def test_gate_quota_and_platform(spark):
    df = spark.createDataFrame([(1, "k", True, "x.joyn.de"), (2, "z", True, "amazon.de"), (3, None, False, "a.de"), (4, None, True, None)], "i long, k string, g boolean, host string")
    said = spark.createDataFrame([("k",), (None,), ("k",)], "k string")
    assert [r.announced for r in C.announcement_gate(df, said, F.col("g"), ["k"]).orderBy("i").collect()] == [True, False, True, False]
    assert [r.platform_free for r in C.platform_rule(df, P.FREE_PLATFORMS).orderBy("i").collect()] == [True, False, None, None]
    assert [tuple(r) for r in C.quota_violation(df, ["g"]).collect()] == [(True, 3)]
