"""One query per operator over the standard tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Vocabulary, pair_key, to_local
from ..functions.params import UrlRule
from ..operators import checks as C
from ..operators import conformance as V
from ..operators import entities as D
from ..operators import reconcile as R
from ..operators import scoring as S
from ..operators import urls as U
from ..sources.readers import candidate_scan, existing_for, existing_scan, table
from ..sources.shared import scratch
from ..sources.store import append_events, compact, stored_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def word(*words: str) -> str:
    """The whole-word pattern, for the SQL."""
    return rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(words)})($|[^\p{{L}}\p{{N}}])"


HOST = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '')"
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
FOLD = "replace(replace(replace(replace(lower({}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"

# ---------------------------------------------------------------- scans


@query("""select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n <= 20""")
def topk_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_scan(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")])


@query("""select event_id, user_id, event_type, ts from events where ts >= timestamp '2024-01-09 23:30:00' and ts <= timestamp '2024-01-12 00:30:00'""")
def existing_window_scan(spark: SparkSession, sf: str) -> DataFrame:
    return existing_scan(table(spark, sf, "events"), "ts", "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("event_id", "user_id", "event_type", "ts")


@query("""with d as (select cast(ts as date) as day, count(*) as n from events where event_type = 'error' group by 1 order by n desc, day limit 1),
  b as (select min(ts) as lo, max(ts) as hi from events, d where event_type = 'error' and cast(ts as date) = day)
  select event_id, user_id, event_type, ts from events, b where ts between lo - interval 30 minute and hi + interval 30 minute""")
def existing_batch_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch, the errors of the day that has most, can match."""
    e = table(spark, sf, "events")
    errors = e.filter("event_type = 'error'").withColumn("day", F.to_date("ts"))
    busiest = errors.groupBy("day").count().orderBy(F.desc("count"), "day").limit(1).select("day")
    return existing_for(errors.join(busiest, "day"), e, "ts", "ts").select("event_id", "user_id", "event_type", "ts")


# ---------------------------------------------------------------- URLs


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_url_parts(table(spark, sf, "pages"))


@query(rf"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, {HOST} as host, {PATH} as path,
  nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query, nullif(regexp_extract(url, '#(.*)$', 1), '') as fragment, nullif(split_part({PATH}, '/', 2), '') as first_segment from pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "scheme", "host", "path", "query", "fragment", "first_segment")


SHAPES = [("html", r"\.html$"), ("paged", r"\?page="), ("tracked", r"[?&]utm_"), ("anchor", r"#"), ("folder", r"/$")]


@query("select page_id, case " + " ".join(f"when regexp_matches(url, '{p}') then '{k}'" for k, p in SHAPES) + " else 'other' end as kind from pages")
def url_kind(spark: SparkSession, sf: str) -> DataFrame:
    return U.classify_url(table(spark, sf, "pages"), F.col("url"), SHAPES).select("page_id", "kind")


RULES = [UrlRule("cheap-pills", "spam host"), UrlRule("spam-farm", "link farm"), UrlRule("?page=", "listing page", unless="/fr")]
_RULES = r"""case when contains(url, 'cheap-pills') then 'spam host' when contains(url, 'spam-farm') then 'link farm'
  when contains(url, '?page=') and not regexp_matches(url, '/fr([/?#]|$)') then 'listing page' end"""


@query(f"select page_id, reason is null as valid, reason, case when reason is null then url end as final_url from (select page_id, url, {_RULES} as reason from pages)")
def url_rule_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.url_rule_verdict(F.col("url"), RULES).alias("v")).select("page_id", "v.*")


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded fetch results of documents, from their labels."""
    status = F.when(F.col("toxic") == 1, 500).when(F.col("quality") == 0, 404).otherwise(200)
    return table(spark, sf, "labels").select("doc_id", status.alias("http_status"), F.lit(None).cast("string").alias("final_url"))


_PROBES = "(select doc_id, case when toxic = 1 then 500 when quality = 0 then 404 else 200 end as s from labels)"
_PROBED = f"(select d.*, p.s, case when p.s is null then 'HTTP error' when p.s >= 400 then 'HTTP ' || p.s end as reason from documents d left join {_PROBES} p on p.doc_id = d.doc_id)"


def probed(spark: SparkSession, sf: str) -> DataFrame:
    return U.probe_verdict(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), probes(spark, sf), on="doc_id")


@query(f"select doc_id, s as http_status, reason is null as valid, reason, case when reason is null then cast(doc_id as varchar) end as final_url from {_PROBED}")
def probe_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return probed(spark, sf).select("doc_id", "http_status", "probe.valid", "probe.reason", "probe.final_url")


@query(rf"select page_id, not starts_with({HOST}, 'blog.') or contains(url, '/en/') as ok from pages")
def conditional_url_rule(spark: SparkSession, sf: str) -> DataFrame:
    on_blog = F.col("host").startswith("blog.")
    return pages(spark, sf).select("page_id", U.live_url_rule(F.col("url"), F.col("host"), exempt=None, live=["/en/"], on_host=on_blog).alias("ok"))


@query(f"select coalesce({_RULES}, 'accepted') as reason, count(*) as n from pages group by 1")
def reject_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return U.reason_counts(table(spark, sf, "pages").withColumn("verdict", U.url_rule_verdict(F.col("url"), RULES)))


# ---------------------------------------------------------------- checks


@query(f"""select doc_id, regexp_matches(text, '{word("MIT")}') as mit, regexp_matches(text, '{word("Licensed")}') as licensed, regexp_matches(text, '{word("Apache")}') as apache,
  concat_ws(',', case when regexp_matches(text, '{word("MIT")}') then 'MIT' end, case when regexp_matches(text, '{word("Licensed")}') then 'Licensed' end) as hits
  from documents""")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    single = [C.has_word(t, [w]).alias(w.lower()) for w in ("MIT", "Licensed", "Apache")]
    return table(spark, sf, "documents").select("doc_id", *single, F.array_join(C.keyword_hits(t, ["MIT", "Licensed"]), ",").alias("hits"))


def searched(spark: SparkSession, sf: str, *terms: list[str]) -> DataFrame:
    """Documents with the words of the terms that stand in them, from one pass over the text."""
    return table(spark, sf, "documents").select("doc_id", "lang", "text", Vocabulary(*terms).hits(F.col("text")).alias("hits"))


FREE, PAID = ["under the MIT License", "MIT License"], ["License", "rights reserved"]
_F = "regexp_replace(regexp_replace(" + FOLD.format("text") + f", '{word('under the mit license')}', '\\1 \\3', 'g'), '{word('mit license')}', '\\1 \\3', 'g')"


@query(f"""select doc_id, case when regexp_matches({_F}, '{word("license", "rights reserved")}') then 'paid term'
  when not regexp_matches({FOLD.format("text")}, '{word("under the mit license", "mit license")}') then 'no sign of free access' end as reason from documents""")
def two_polarity_check(spark: SparkSession, sf: str) -> DataFrame:
    r = C.check_free_access(F.col("text"), paid=PAID, brands=[], free=FREE, price=None, hits=F.col("hits"))
    return searched(spark, sf, PAID, FREE).select("doc_id", r["reason"].alias("reason"))


@query(f"""select doc_id, case when regexp_matches({FOLD.format("text")}, '{word("idiot", "scum")}') then 'replay'
  when not regexp_matches({FOLD.format("text")}, '{word("the", "und", "les")}') then 'not live' end as reason from documents""")
def reject_wins_check(spark: SparkSession, sf: str) -> DataFrame:
    live, replay = ["the", "und", "les"], ["idiot", "scum"]
    return searched(spark, sf, live, replay).select("doc_id", C.check_live_content(F.col("text"), live=live, replay=replay, hits=F.col("hits"))["reason"].alias("reason"))


DOMAINS = [(1, "site", "tionsh.example.net"), (2, "net", "example.net"), (3, "org", "example.org"), (1, "farm", "spam-farm.example.org")]
_DOMAINS = "(values " + ", ".join(map(str, DOMAINS)) + ") as t(tier, name, domain)"


@query(f"""select page_id, host, arg_max(tier, length(domain)) as tier, max_by(domain, length(domain)) as domain from (select page_id, {HOST} as host from pages)
  left join {_DOMAINS} on host = domain or ends_with(host, '.' || domain) group by page_id, host""")
def domain_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    dim = spark.createDataFrame(DOMAINS, "tier int, name string, domain string")
    return C.match_domains(pages(spark, sf), dim).select("page_id", "host", "matched.tier", "matched.domain")


@query(f"""select doc_id, case when regexp_matches({FOLD.format("text")}, '{word("fuer", "ist")}') then 'other topic'
  when not regexp_matches({FOLD.format("text")}, '{word("the", "que")}') and lang <> 'fr' then 'no topic term' end as reason from documents""")
def topic_check(spark: SparkSession, sf: str) -> DataFrame:
    topics, others = ["the", "que"], ["für", "ist"]
    r = C.check_topic(F.col("text"), topics, others, known=F.col("lang") == "fr", hits=F.col("hits"))
    return searched(spark, sf, topics, others).select("doc_id", r["reason"].alias("reason"))


_LOCAL = "timezone('Europe/Berlin', timezone('UTC', ts))"


@query(f"""select event_id, case when {_LOCAL} < timestamp '2024-01-10' then 'in the past' when {_LOCAL} >= timestamp '2024-01-18' then 'too far ahead' end as reason,
  (hour({_LOCAL}) between 14 and 22) or (hour({_LOCAL}) = 23 and minute({_LOCAL}) = 0 and floor(second({_LOCAL})) = 0) as usual_hours from events""")
def date_window_check(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", C.check_date_window(ts, "2024-01-10")["reason"].alias("reason"), C.usual_hours(ts).alias("usual_hours"))


@query(f"select doc_id, case when n_chars < 100 then 'URL rejected' when s is null then 'HTTP error' when s <> 200 then 'HTTP ' || s end as reason from {_PROBED}")
def working_link_check(spark: SparkSession, sf: str) -> DataFrame:
    return probed(spark, sf).select("doc_id", C.check_working_link(F.col("http_status"), F.col("n_chars") >= 100)["reason"].alias("reason"))


@query("""select page_id, case when html is null then 'page unreadable'
  when not regexp_matches(html, '<article[^>]*><h1>[^<]*</h1><p><b>') then 'no stream on the page' end as reason from pages""")
def page_element_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.check_direct_stream(F.col("html"), evidence="<article[^>]*><h1>[^<]*</h1><p><b>")["reason"].alias("reason"))


PLATFORMS = {"example.net": True, "example.org": False, "blog.tionsh.example.net": False}


@query(f"""select page_id, max_by(free, length(domain)) as platform_free from (select page_id, {HOST} as host from pages)
  left join (values {", ".join(f"('{k}', {v})" for k, v in PLATFORMS.items())}) as t(domain, free) on host = domain or ends_with(host, '.' || domain) group by page_id""")
def platform_rule(spark: SparkSession, sf: str) -> DataFrame:
    return C.platform_rule(pages(spark, sf), PLATFORMS).select("page_id", "platform_free")


@query("""select event_id, exists (select 1 from events s where s.event_type = 'signup' and s.user_id = e.user_id and cast(s.ts as date) =
  cast(e.ts as date)) as announced
  from events e where event_type = 'purchase'""")
def announcement_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return C.announcement_gate(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), F.lit(True), ["user_id", "day"]).select("event_id", "announced")


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where event_type = 'purchase' group by all having count(*) > 1")
def quota_violation(spark: SparkSession, sf: str) -> DataFrame:
    return C.quota_violation(table(spark, sf, "events").filter("event_type = 'purchase'"), ["user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")])


def page_checks(spark: SparkSession, sf: str) -> DataFrame:
    df = pages(spark, sf).withColumn("verdict", U.url_rule_verdict(F.col("url"), RULES))
    return C.decide(df.withColumn("checks", C.check_array({
        "url": C.result(F.col("verdict.reason")), "language": C.result(F.when(~F.col("path").startswith("/en"), "not English")),
        "page": C.check_direct_stream(F.col("html"), evidence="<article[^>]*><h1>[^<]*</h1><p><b>"), "length": C.result(F.when(F.length("html") > 4000, "too long")),
    })))


_CHECKED = f"""(select page_id, url, {HOST} as host, {_RULES} as c1, case when not starts_with({PATH}, '/en') then 'not English' end as c2,
  case when html is null then 'page unreadable' when not regexp_matches(html, '<article[^>]*><h1>[^<]*</h1><p><b>') then 'no stream on the page' end as c3, case
  when length(html) > 4000 then 'too long' end as c4 from pages)"""
_LOG = f"""(select page_id, host, n as check_no, check_name as "check", case when reason is null then 'PASS' else 'FAIL' end as status, reason from (
  select page_id, host, 1 as n, 'url' as check_name, c1 as reason from {_CHECKED} union all select page_id, host, 2, 'language', c2 from {_CHECKED}
  union all select page_id, host, 3, 'page', c3 from {_CHECKED} union all select page_id, host, 4, 'length', c4 from {_CHECKED}))"""


@query(f"""select page_id, case when coalesce(c1, c2, c3, c4) is null then 'CREATE' else 'SKIP' end as decision, coalesce(c1, c2, c3, c4) as reason, concat_ws('; ', c1, c2, c3, c4) as reasons,
  concat_ws(' ', case when c1 is null then 'PASS' else 'FAIL' end, case when c1 is not null then 'N/A' when c2 is null then 'PASS' else 'FAIL' end,
   case when coalesce(c1, c2) is not null then 'N/A' when c3 is null then 'PASS' else 'FAIL' end, case when coalesce(c1, c2, c3) is not null then 'N/A'
  when c4 is null then 'PASS' else 'FAIL' end) as short from {_CHECKED}""")
def decide(spark: SparkSession, sf: str) -> DataFrame:
    short = F.array_join(F.transform(C.short_circuit(F.col("checks")), lambda x: x["status"]), " ")
    return page_checks(spark, sf).select("page_id", "decision", "reason", F.array_join("reasons", "; ").alias("reasons"), short.alias("short"))


@query(f"""select doc_id, case when trim(source) = '' then 'no direct link' when reason is not null then 'URL not valid'
  when n_chars < 1000 then 'live stream not confirmed' when source = 'src3' then 'no source reference' end as missing from {_PROBED}""")
def creation_gate(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.when(F.col("source") != "src3", F.col("source"))
    return probed(spark, sf).select("doc_id", C.creation_gate(F.col("source"), F.col("probe.valid"), F.col("n_chars") >= 1000, ref).alias("missing"))


@query(f'select page_id, check_no, "check", status, reason from {_LOG}')
def validation_log(spark: SparkSession, sf: str) -> DataFrame:
    return C.validation_log(page_checks(spark, sf), ["page_id"])


@query(f"""select "check", host, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'FAIL') as failed,
  cast(count(*) filter (status = 'PASS') as double) / count(*) as pass_rate from {_LOG} group by all""")
def check_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_pass_rates(C.validation_log(page_checks(spark, sf), ["host"]), ["check", "host"])


# ---------------------------------------------------------------- entities

ALIASES = [("building", "Construction"), ("Furniture ", "Home"), ("household", "Home")]


@query("""select c_custkey, case when c_mktsegment = 'BUILDING' then 'Construction'
  when c_mktsegment in ('FURNITURE', 'HOUSEHOLD') then 'Home' else c_mktsegment end as segment from customer""")
def alias_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return D.normalise(table(spark, sf, "customer"), "c_mktsegment", spark.createDataFrame(ALIASES, "alias string, canonical string"), "segment").select("c_custkey", "segment")


@query("""select p_partkey, case when contains(p_name, ' ') then split_part(p_name, ' ', 1) end as first, case
  when contains(p_name, ' ') then substr(p_name, instr(p_name, ' ') + 1) end as second from part""")
def split_pair(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", D.split_pair(F.col("p_name"), " ").alias("p")).select("p_partkey", "p.*")


@query("""select least(lower(a.n_name), lower(b.n_name)) || '|' || greatest(lower(a.n_name), lower(b.n_name)) as pair, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey group by 1""")
def unordered_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    keyed = keyed.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = keyed.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("c"))  # few pairs are left before names are looked up
    a, b = (t("nation").select(F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab")
    named = counts.join(a, F.col("c_nationkey") == F.col("ka")).join(b, F.col("s_nationkey") == F.col("kb"))
    return named.groupBy(pair_key(F.col("a"), F.col("b")).alias("pair")).agg(F.sum("c").alias("n"))


_SUMMARY = "'[' || event_type || '] ' || 'user ' || user_id || ' vs ' || 'event'"


@query(f"""select event_id, {_SUMMARY} as summary, strftime({_LOCAL}, '%Y-%m-%dT%H:%M:%S') || '+01:00' as start_iso,
  strftime({_LOCAL} + case when event_type = 'purchase' then interval 180 minute else interval 150 minute end, '%Y-%m-%dT%H:%M:%S') || '+01:00' as end_iso,
  ts + case when event_type = 'purchase' then interval 180 minute else interval 150 minute end as end_ts, '6' as colour,
  'League: ' || event_type || chr(10) || 'Teams: user ' || user_id || ' vs event' || chr(10) || 'Date/Time: ' ||
  strftime({_LOCAL}, '%Y-%m-%dT%H:%M:%S') || '+01:00' || chr(10) || 'Free stream links:' || chr(10)
    || 'props: ' || props || chr(10) || 'Access: free' || chr(10) || 'Source: ' || event_id || ' at 2024-02-01' as description from events""")
def event_record(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("start_ts"), F.col("event_type").alias("league"), F.when(F.col("event_type") == "purchase", "playoff").otherwise("regular").alias("event_type"),
        F.concat(F.lit("user "), "user_id").alias("team1"), F.lit("event").alias("team2"), F.array(F.struct(F.lit("props").alias("source"), F.col("props").alias("url"))).alias("links"),
        F.lit("free").alias("access"), F.col("event_id").alias("source_ref"), F.lit("2024-02-01").alias("validated_at"),
    )
    out = D.event_record(e)
    return out.select(F.regexp_extract("description", r"Source: (\d+) at", 1).cast("long").alias("event_id"), "summary", "start_iso", "end_iso", "end_ts", "colour", "description")


_LEAGUE = "case when p_type = 'PROMO' then 'FIBA ' when p_type = 'LARGE' then ' EuroLeague' when p_type = 'SMALL' then '' else lower(p_type) end"
_KIND = "case when p_brand = 'Brand#2' then 'Final' when p_brand = 'Brand#3' then ' SEMIFINALS ' else 'playoff' end"


@query("""select p_partkey, case when p_type = 'SMALL' then null when p_type = 'PROMO' then '2'
  when p_type = 'LARGE' and p_brand in ('Brand#2', 'Brand#3') then '11' else '6' end as colour from part""")
def category_colour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", D.event_colour(F.expr(_LEAGUE), F.expr(_KIND)).alias("colour"))


# ---------------------------------------------------------------- reconciliation


@query("""with t as (select l_orderkey, l_linenumber, l_partkey, n_regionkey as tier from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey)
  select l_orderkey, l_linenumber, l_partkey, tier from t qualify tier = min(tier) over (partition by l_partkey)""")
def tier_prune(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("tier"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(region, F.col("l_suppkey") == F.col("s_suppkey"))
    return R.tier_prune(lines, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "tier")


_SITE, _TLD = rf"regexp_replace({HOST}, '\.[a-z]+$', '')", rf"regexp_extract({HOST}, '\.([a-z]+)$', 1)"


@query(rf"""select site, cast((n - 1) // 20 + 1 as int) as chunk, any_value(n_links) as n_links, string_agg(tier || ' ' || source || ' ' || url, ', ' order by tier, source, url) as links from
  (select *, row_number() over (partition by site order by tier, source, url) as n, count(*) over (partition by site) as n_links from
    (select distinct {_SITE} as site, case {_TLD} when 'com' then 1 when 'net' then 2 else 3 end as tier, {HOST} as source, url from pages)) group by 1, 2""")
def merge_links(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("host")
    tld = F.regexp_extract(h, r"\.([a-z]+)$", 1)
    df = pages(spark, sf).select(F.regexp_replace(h, r"\.[a-z]+$", "").alias("site"), F.when(tld == "com", 1).when(tld == "net", 2).otherwise(3).alias("tier"), h.alias("source"), "url")
    out = R.merge_links(df, ["site"], size=20)
    text = F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["tier"].cast("string"), x["source"], x["url"])), ", ")
    return out.select("site", "chunk", "n_links", text.alias("links"))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return tuple(e.filter(F.col("event_type") == kind).drop("event_type") for kind in ("signup", "purchase"))


_PAIRS = """select c.event_id, c.ts, c.user_id, p.event_id as m, abs(epoch_us(c.ts) - epoch_us(p.ts)) as gap
  from (select * from events where event_type = 'signup') c left join (select * from events where event_type = 'purchase') p
  on {} p.ts between c.ts - interval 30 minute and c.ts + interval 30 minute"""
_KEYED, _TIMED = f"({_PAIRS.format('c.user_id = p.user_id and')})", f"({_PAIRS.format('')})"


@query(f"select event_id, arg_min(m, struct_pack(a := gap, b := m)) filter (m is not null) as matched_event, count(m) as matches from {_KEYED} group by event_id")
def duplicate_match(spark: SparkSession, sf: str) -> DataFrame:
    c, p = sides(spark, sf)
    return R.duplicate_match(c, p, "event_id", "event_id", "ts", "ts", "user_id", "user_id").select("event_id", "matched_event", "matches")


@query(f"select event_id, ts, user_id from {_KEYED} where m is null")
def new_only(spark: SparkSession, sf: str) -> DataFrame:
    c, p = sides(spark, sf)
    return R.new_only(c, p, "event_id", "event_id", "ts", "ts", "user_id", "user_id")


@query(f"select event_id, count(m) as clashes from {_TIMED} group by event_id")
def slot_clash_counts(spark: SparkSession, sf: str) -> DataFrame:
    c, p = sides(spark, sf)
    return R.clash_counts(c, p, "event_id", "ts", "ts").withColumnRenamed("cand_id", "event_id")


@query("""select unnest(list_reduce(list([{'at': epoch_us(ts), 'id': event_id}] order by ts, event_id), lambda kept, x:
    case when x[1]['at'] - kept[len(kept)]['at'] > 1800000000 then list_concat(kept, x) else kept end))['id'] as event_id, user_id from events group by user_id""")
def new_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    return R.new_in_batch(table(spark, sf, "events"), "event_id", "ts", "user_id").select("event_id", "user_id")


_GREEDY = """select user_id, unnest(list_reduce(list([{{'at': epoch_us(ts), 'id': event_id}}] order by ts, event_id), lambda kept, x:
    case when x[1]['at'] - kept[len(kept)]['at'] > 1800000000 then list_concat(kept, x) else kept end)) as e from {} group by user_id"""


@query(f"""with early as (select e['id'] as event_id, user_id, e['at'] as micros from ({_GREEDY.format("events where event_type in ('purchase', 'click')")})),
  open as (select * from events l where event_type not in ('purchase', 'click')
    and not exists (select 1 from early s where s.user_id = l.user_id and abs(s.micros - epoch_us(l.ts)) <= 1800000000)),
  late as (select e['id'] as event_id, user_id, e['at'] as micros from ({_GREEDY.format("open")}))
  select event_id, user_id, strftime(make_timestamp(micros), '%Y-%m-%d') as day from (select * from early union all select * from late)""")
def event_store(spark: SparkSession, sf: str) -> DataFrame:
    """Events in two batches, the second twice, into a store, which is then compacted and read back."""
    e, path = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), scratch(spark, "store")
    first = F.col("event_type").isin("purchase", "click")
    for batch in (e.filter(first), e.filter(~first), e.filter(~first)):
        append_events(batch.drop("event_type"), path, start="ts", pair="user_id")
    compact(spark, path, "ts")
    return stored_events(spark, path).select("event_id", "user_id", F.date_format("event_day", "yyyy-MM-dd").alias("day"))


@query(f"""select case when m is null then 'created' else 'skipped' end as status, event_id, user_id,
  strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d %H:%M') as local_time,
  case when m is null then cast(event_id as varchar) else 'Event already exists: ' || m end as calendar_event from
  (select event_id, user_id, ts, arg_min(m, struct_pack(a := gap, b := m)) filter (m is not null) as m from {_KEYED} group by all)""")
def results_table(spark: SparkSession, sf: str) -> DataFrame:
    c, p = sides(spark, sf)
    found = R.duplicate_match(c, p, "event_id", "event_id", "ts", "ts", "user_id", "user_id").withColumn("local_time", F.date_format(to_local(F.col("ts"), "Europe/Berlin"), "yyyy-MM-dd HH:mm"))
    return R.results_table(found.filter("matched_event is null"), found.filter("matched_event is not null"), ["event_id", "user_id", "local_time"])


@query(f"""select *, case when found = 0 then 'no streams found' when found = rejected then 'found ' || found || ' candidates, none passed' end as message from (
  select count(*) as found, count(*) filter (r is not null) as rejected, count(*) filter (r is null and d) as duplicates, count(*) filter (r is null and not d) as created
  from (select {_RULES} as r, contains(url, '#') as d from pages))""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = U.url_rule_verdict(F.col("url"), RULES)
    return R.run_summary(table(spark, sf, "pages"), ~v["valid"], F.col("url").contains("#"))


@query(f"""select *, case when found = 0 then 'no streams found' when found = rejected then 'found ' || found || ' candidates, none passed' end as message from (
  select count(*) as found, count(*) filter (r is not null or q) as rejected, cast(0 as bigint) as duplicates, count(*) filter (r is null and not q) as created,
    count(*) filter (r is not null) as rejected_rules, count(*) filter (r is null and q) as rejected_query, cast(0 as bigint) as rejected_address
  from (select {_RULES} as r, contains(url, '?') as q from pages))""")
def run_summary_stages(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    bad = ~U.url_rule_verdict(url, RULES)["valid"]
    stages = {"rules": bad, "query": url.contains("?"), "address": url.isNull()}
    return R.run_summary(table(spark, sf, "pages"), bad | url.contains("?"), F.lit(False), stages=stages)


@query(f"""with v as (select page_id, url, coalesce(r, case when q then 'has a query' end) as r, r is null and q as q, d
    from (select page_id, url, {_RULES} as r, contains(url, '#') as d, contains(url, '?') as q from pages)),
  s as (select count(*) as found, count(*) filter (r is not null) as rejected, count(*) filter (r is null and d) as duplicates, count(*) filter (r is null and not d) as created,
    count(*) filter (r is not null and not q) as rejected_rules, count(*) filter (q) as rejected_query from v)
  select page_id, r as reason, s.* from v, s where r is not null union all select page_id, 'none', s.* from v, s where r is null and not d""")
def decided_run(spark: SparkSession, sf: str) -> DataFrame:
    """Pages decided and written in one pass: those accepted and rejected, each with the run's counts."""
    url = F.col("url")
    rule, query_ = U.url_rule_verdict(url, RULES)["reason"], F.when(url.contains("?"), "has a query")
    stages = {"rules": rule.isNotNull(), "query": query_.isNotNull()}
    accepted, rejected, summary = R.write_decided(table(spark, sf, "pages").select("page_id", "url"), scratch(spark, "decided"), F.coalesce(rule, query_), url.contains("#"), stages)
    n = summary.drop("message").first().asDict()
    rows = accepted.select("page_id", F.lit("none").alias("reason")).unionByName(rejected.select("page_id", "reason"))
    return rows.withColumns({k: F.lit(v).cast("long") for k, v in n.items()})


_HREFS = """(select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as link from pages)"""
HREF = r'href="([^"]+)"'


@query(f"""select page_id, link, failed from (select page_id, link, case when contains(link, ',') then 'comma in path'
  when contains(link, '.') then 'full stop in path' when regexp_matches(link, '/[A-Z]') then 'upper case' end as failed from {_HREFS}) where failed is not null""")
def audit_published(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "pages").select("page_id", F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1)).alias("links"))
    link = F.col("link")
    failed = F.when(link.contains(","), "comma in path").when(link.contains("."), "full stop in path").when(link.rlike("/[A-Z]"), "upper case")
    return R.audit_published(e, failed, ["page_id"])


@query(f"""with links as (select distinct page_id, url, link from (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as link from pages
  union all select page_id, url, url from pages)),
  judged as (select page_id, url as source_ref, link, s as http_status, case when contains(link, 'cheap-pills') then 'spam host'
  when contains(link, 'spam-farm') then 'link farm'
      when contains(link, '?page=') and not regexp_matches(link, '/fr([/?#]|$)') then 'listing page' when s is null then 'HTTP error'
  when s <> 200 then 'HTTP ' || s end as failed
    from (select *, case when length(link) % 5 = 0 then null when length(link) % 7 = 0 then 404 when length(link) % 11 = 0 then 301 else 200 end as s from links))
  select page_id, source_ref, '2024-02-01' as validated_at, link, http_status, failed from judged where failed is not null""")
def audit_links(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))
    e = table(spark, sf, "pages").select("page_id", F.col("url").alias("source_ref"), F.lit("2024-02-01").alias("validated_at"), F.concat(found, F.array("url")).alias("links"))
    n = F.length("url")
    status = F.when(n % 7 == 0, 404).when(n % 11 == 0, 301).otherwise(200)
    probes = e.select(F.explode("links").alias("url")).distinct().filter(n % 5 != 0).select("url", status.alias("http_status"), F.lit(None).cast("string").alias("final_url"))
    return R.audit_links(e, probes, RULES, ["page_id", "source_ref", "validated_at"])


@query(f"""select event_id, 'user ' || user_id as team1, 'event' as team2, 'event|user ' || user_id as pair_key, case
  when event_type = 'click' then 'CLICK' else event_type end as league,
  strftime({_LOCAL}, '%Y-%m-%dT%H:%M:%S') || '+01:00' as start, 'https://a.example/' || event_id as link, case when value < 5 then 'unknown'
  when value < 20 then 'restricted' else 'free' end as access,
  case when event_id % 2 = 0 then 'ref ' || event_id else 'https://a.example/' || event_id end as source_ref, '2024-02-01' as validated_at from events""")
def game_record(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("user "), "user_id", F.lit(" vs. event")).alias("teams"),
        F.concat(F.upper("event_type"), F.lit(": game")).alias("title"), F.when(F.col("event_type") != "click", F.col("event_type")).otherwise(" ").alias("league"),
        F.col("ts").alias("start_ts"), F.concat(F.lit("https://a.example/"), "event_id").alias("url"),
        F.when(F.col("value") >= 5, F.col("value") >= 20).alias("free_tier"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ref "), "event_id")).alias("source_ref"),
    )
    return D.game_record(e, "2024-02-01").select("event_id", "team1", "team2", "pair_key", "league", "start", "link", "access", "source_ref", "validated_at")


# ---------------------------------------------------------------- scoring and conformance


@query(r"""select page_id, split_part(x, '=', 1) as name, substr(x, instr(x, '=') + 1) as value from (
  select page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) as x from pages where contains(url, '?'))""")
def query_params(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", F.explode(S.key_values(F.col("query"), "&")).alias("name", "value"))


@query("""select doc_id, case when quality = 1 then 'CREATE' else 'SKIP' end as decision, case when quality = 0 then 'poor text' end as reason, case
  when toxic = 0 then 'quality=' || case when quality = 1 then 'PASS' else 'FAIL' end || ',toxic=PASS' else 'toxic=FAIL' end as checks from labels""")
def parse_expected(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("Decision="), F.when(F.col("quality") == 1, "CREATE").otherwise("SKIP"), F.lit("; reason="), F.when(F.col("quality") == 0, "poor text").otherwise(""),
        F.lit("; checks: "),
        F.when(F.col("toxic") == 0, F.concat(F.lit("quality="), F.when(F.col("quality") == 1, "PASS (fine)").otherwise("FAIL"), F.lit(", toxic=PASS"))).otherwise("toxic=FAIL; WARNING: look again"),
    )
    p = S.parse_expected(text)
    return table(spark, sf, "labels").select("doc_id", p["decision"].alias("decision"), p["reason"].alias("reason"), F.array_join(p["checks"], ",").alias("checks"))


@query(r"""select o_orderkey as id, o_orderpriority || ' expected PASS' as assertion, o_orderpriority || '=PASS' as needle from orders
  where not contains(o_orderpriority, ' ') union all select o_orderkey, o_orderpriority || ' expected PASS', null from orders where contains(o_orderpriority, ' ')""")
def regex_needles(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat("o_orderpriority", F.lit(" expected PASS"))).alias("assertions"))
    return S.assertion_needles(cases)


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    verdict = lambda good: F.when(good, "long=PASS").otherwise("long=FAIL")
    wanted = F.when(F.col("toxic") == 1, F.array(F.lit("long expected PASS"))).otherwise(F.array().cast("array<string>"))
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(verdict(F.col("quality") == 1), F.lit("\n")).alias("expected_output"), wanted.alias("assertions"))
    said = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), verdict(F.col("n_chars") >= 800).alias("output"))
    return S.score_cases(cases, said)


_SCORES = """(select l.doc_id as id, case when (d.n_chars >= 800) <> (quality = 1) then 'output differs'
  when toxic = 1 and d.n_chars < 800 then 'assertion not met' end as why, cast(toxic as bigint) as n_assertions from labels l join documents d on d.doc_id = l.doc_id)"""


@query(f"select id, why is null as passed, why, n_assertions from {_SCORES}")
def score_cases(spark: SparkSession, sf: str) -> DataFrame:
    return label_scores(spark, sf)


@query(f"""select count(*) filter (why is null) as cases_passed, count(*) filter (why is not null) as cases_failed,
  cast(coalesce(sum(n_assertions) filter (why is null), 0) as bigint) as assertions_evaluated from {_SCORES}""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_summary(label_scores(spark, sf))


@query("""select event_id, case when not json_valid(props) then 'not JSON'
  when json_type(props, '$.k') is null or json_type(props, '$.k') not in ('UBIGINT', 'BIGINT') then 'k is no number' else 'note is no text' end as problem from events""")
def structural_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.structural_report(table(spark, sf, "events"), "props", [("$.k", "BIGINT", "k is no number"), ("$.note", "STRING", "note is no text")]).select("event_id", "problem")


@query("""select doc_id, case when doc_id % 5 = 0 then 'assertions is no list' end as problem, case
  when doc_id % 5 > 0 then doc_id % 4 end as n_assertions, length(source) as output_length from documents""")
def structural_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    own = F.when(F.col("doc_id") % 5 > 0, F.array_repeat("source", (F.col("doc_id") % 4).cast("int")))
    raw = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("expected_output"), own.alias("assertions")))
    out = S.structural_report(d.withColumn("raw", raw), "raw", [("$.assertions", "ARRAY", "assertions is no list")], {"n_assertions": "$.assertions", "output_length": "$.expected_output"})
    return out.select("doc_id", "problem", "n_assertions", "output_length")


@query("""select event_id, concat_ws('; ', case when cast(props->>'$.k' as bigint) > 90 then 'k too large' end, case
  when value < 1 then 'value too small' end) as errors from events""")
def record_conformance(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    extra = [F.when(k > 90, "k too large"), F.when(F.col("value") < 1, "value too small")]
    return V.record_conformance(table(spark, sf, "events"), "props", ["k"], {"k": "BIGINT"}, extra).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(f"""select doc_id, concat_ws('; ', case when n_chars > 3000 then 'characters' end, case when len(string_split(text, chr(10))) > 12 then 'lines' end, case
  when not regexp_matches(text, '{word("the", "de", "und")}') then 'term' end) as errors from documents""")
def document_conformance(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"characters": F.col("n_chars") <= 3000, "lines": F.size(F.split("text", "\n")) <= 12, "term": C.has_word(F.col("text"), ["the", "de", "und"])}
    return V.measured_conformance(table(spark, sf, "documents"), limits).select("doc_id", F.array_join("errors", "; ").alias("errors"))


_LINES = "case when text = '' then 0 else len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) end"


@query(f"""select doc_id, concat_ws('; ', case when doc_id % 2 = 1 then 'missing keys: description' end, case when doc_id % 3 = 0 then 'name malformed' end, case
  when doc_id % 2 = 0 and doc_id % 1500 > 1024 then 'description too long' end,
  case when {_LINES} > 12 then 'body too long' end, case when not regexp_matches(text, '(^|\\n)## Usage(\\n|$)') then 'missing sections: ## Usage' end) as errors
  from (select doc_id, text || case when doc_id % 5 = 0 then chr(10) || '## Usage' || chr(10) else '' end as text from documents)""")
def document_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 3 == 0, "Doc ").otherwise("doc-"), i.cast("string"))
    described = F.when(i % 2 == 0, F.concat(F.lit("description: "), F.repeat(F.lit("x"), (i % 1500).cast("int")), F.lit("\n"))).otherwise("")
    front = F.concat(F.lit("---\nname: "), name, F.lit("\nversion: 1\ncategory: text\n"), described, F.lit("---\n"))
    text = F.concat(front, "text", F.when(i % 5 == 0, "\n## Usage\n").otherwise(""))
    out = V.document_conformance(table(spark, sf, "documents").select("doc_id", text.alias("text")), "text", None, headings=["## Usage"], max_lines=12)
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("""select l_orderkey as id, concat_ws('; ', case when o_orderstatus <> 'F' then 'skill_name is not F: ' || o_orderstatus end, case
  when l_orderkey % 7 = 0 then 'evals is no list' end,
  case when l_orderkey % 7 > 0 and count(distinct l_quantity) < count(*) then 'repeated id' end) as errors from lineitem join orders on l_orderkey = o_orderkey
  group by l_orderkey, o_orderstatus""")
def corpus_conformance(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("id"))).alias("evals"))
    own = cases.join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = F.to_json(F.struct(F.col("o_orderstatus").alias("skill_name"), F.when(F.col("l_orderkey") % 7 > 0, F.col("evals")).alias("evals")))
    return V.corpus_conformance(own.select(F.col("l_orderkey").alias("id"), raw.alias("raw")), "raw", "F").select("id", F.array_join("errors", "; ").alias("errors"))


@query("""select distinct o_orderpriority || '-' || o_custkey % 50 as name, o_orderpriority || '-' || o_custkey % 50 || ': not there, so its references were not looked at' as warning
  from orders
  where o_custkey % 50 not in (select c_custkey % 50 from customer where c_acctbal > 9900)""")
def missing_documents(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, k: F.concat(p, F.lit("-"), (k % 50).cast("string")).alias("name")
    o = table(spark, sf, "orders")
    there = table(spark, sf, "customer").filter("c_acctbal > 9900").select((F.col("c_custkey") % 50).alias("k")).distinct()
    documents = o.join(there, F.col("o_custkey") % 50 == F.col("k"), "left_semi").select(name(F.col("o_orderpriority"), F.col("o_custkey")))
    return V.missing_documents(o.select(name(F.col("o_orderpriority"), F.col("o_custkey"))), documents)


@query("""select p_brand || '-' || p_type as "check", case when count(*) filter (p_size > 25) = 0 then 'no failing fixture' else 'its fixtures pass' end as problem
  from part group by 1 having count(*) filter (p_size > 45) = 0""")
def unproven_checks(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.concat("p_brand", F.lit("-"), "p_type").alias("check"), "p_size")
    return V.unproven_checks(part, part.filter("p_size > 25").select("check", F.when(F.col("p_size") > 45, "FAIL").otherwise("PASS").alias("verdict")))


@query(f"select distinct link as reference from {_HREFS} where link not in (select link from {_HREFS} where contains(url, '://blog.tionsh.example.net/'))")
def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    links = pages(spark, sf).select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))).alias("reference"))
    return V.dangling_references(links, links.filter("host = 'blog.tionsh.example.net'").withColumnRenamed("reference", "path"))


@query(r"""select c_custkey as id, case when not regexp_matches(c_name, '^Customer#[0-9]{9}$') then 'malformed' end as problem from customer
  union all select -page_id - 1, case when regexp_matches(url, '(?i)YOUR_|HERE|TODO|FIXME|XXX|\.\.\.|placeholder|example|sample') then 'placeholder' else 'malformed' end from pages""")
def identifier_conformance(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), V.identifier_problem(F.col("c_name"), r"^Customer#[0-9]{9}$").alias("problem"))
    return customers.unionByName(table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("id"), V.identifier_problem(F.col("url")).alias("problem")))


@query(f"""with found as (select 'characters' as c from documents where n_chars > 3000 union all select 'lines' from documents where len(string_split(text, chr(10))) > 12
    union all select 'term' from documents where not regexp_matches(text, '{word("the", "de", "und")}'))
  select r.c as "check", count(f.c) as n_errors, case when count(f.c) > 0 then 'FAIL' else 'PASS' end as verdict
  from (values ('characters'), ('lines'), ('term'), ('unused')) as r(c) left join found f on f.c = r.c group by r.c""")
def conformance_verdict(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"characters": F.col("n_chars") <= 3000, "lines": F.size(F.split("text", "\n")) <= 12, "term": C.has_word(F.col("text"), ["the", "de", "und"])}
    found = V.measured_conformance(table(spark, sf, "documents"), limits).select(F.explode("errors").alias("check"))
    return V.conformance_verdict(spark.createDataFrame([(c,) for c in (*limits, "unused")], "check string"), found)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through the URL rules, the domain join and the checks: how many per decision and first reason."""
    dim = spark.createDataFrame(DOMAINS, "tier int, name string, domain string")
    df = C.match_domains(page_checks(spark, sf), dim)
    decision = F.when(F.col("matched").isNull(), "SKIP").otherwise(F.col("decision"))
    return df.groupBy(decision.alias("decision"), F.coalesce("reason", F.when(F.col("matched").isNull(), "domain not approved"), F.lit("all checks pass")).alias("reason")).agg(F.count("*").alias("n"))


