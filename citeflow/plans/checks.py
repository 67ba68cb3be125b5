"""Queries over checks: verdicts, state machines, queues. Events are a check log (user_id the link, event_id the order);
part, supplier and lineitem stand for links, sites and citations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow import policy
from citeflow.functions import net, urls
from citeflow.operators import classify, queues, reports, state
from citeflow.plans.registry import register, table, values
from citeflow.sources import dumps

_VERDICT = "CASE event_type WHEN 'error' THEN 'hard_404' WHEN 'click' THEN 'temporarily_unavailable' WHEN 'purchase' THEN 'dns_failure' WHEN 'view' THEN 'live' ELSE 'parked' END"
_CADENCE = "CASE state WHEN 'hard_404' THEN least(2592000 * CAST(pow(2, streak - 1) AS BIGINT), 15552000) WHEN 'temporarily_unavailable' THEN CASE WHEN streak > 5 THEN 604800 ELSE 3600 * CAST(pow(2, streak - 1) AS BIGINT) END WHEN 'dns_failure' THEN 604800 WHEN 'live' THEN 7776000 ELSE 604800 END"


@register(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS made, {_VERDICT} AS s FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i, first_value(s) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS state FROM e),
f AS (SELECT user_id, state, least(coalesce(min(CASE WHEN s <> state THEN i - 1 END), max(i)), 20) AS streak, coalesce(min(CASE WHEN s NOT IN ('dns_failure', 'temporarily_unavailable', 'tls_failure') THEN i - 1 END), max(i)) AS fails, max(CASE WHEN i = 1 THEN made END) AS made FROM r GROUP BY 1, 2)
SELECT user_id, state, streak::BIGINT AS streak, state = 'hard_404' AND streak >= 3 AS terminal, (made + {_CADENCE})::BIGINT AS next_check_at, fails::BIGINT AS consecutive_failures FROM f""")
def url_transition(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("at"), F.expr(_VERDICT).alias("s"))
    return state.url_states(e, "user_id", "event_id", "s", "at")


_SITE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'parked' WHEN 'AUTOMOBILE' THEN 'unregistered' WHEN 'FURNITURE' THEN 'expiring' ELSE 'registered' END"
_ENDS = "DATE '2024-01-20' + CAST(c_custkey % 200 AS INT)"


@register(f"SELECT c_custkey AS site, {_SITE} AS state, CAST(CASE {_SITE} WHEN 'active' THEN CASE WHEN c_custkey % 200 BETWEEN 0 AND 60 THEN 3 ELSE 90 END WHEN 'parked' THEN 7 WHEN 'unregistered' THEN 3 WHEN 'expiring' THEN 1 ELSE 30 END AS INT) AS recheck_days FROM customer")
def domain_transition(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.expr(_SITE).alias("state"), F.expr(_ENDS).cast("string").alias("expiry"))
    return c.select("site", "state", state.domain_recheck_days(F.col("state"), F.col("expiry"), F.expr("TIMESTAMP '2024-01-20 00:00:00'")).cast("int").alias("recheck_days"))


@register(f"""WITH l AS (SELECT user_id AS url, event_id AS check_id, {_VERDICT} AS now FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
j AS (SELECT event_id AS check_id, '1+a' AS v, CASE WHEN event_id % 4 = 0 THEN 'live' ELSE {_VERDICT} END AS c FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, '1+b', 'parked' FROM events WHERE event_id % 5 = 0),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY v DESC) = 1)
SELECT url, l.check_id, b.c AS was, CASE WHEN b.v = '1+b' THEN b.c ELSE now END AS classification, CASE WHEN b.v = '1+b' THEN 'current' WHEN b.c <> now THEN 'changed' ELSE 'same' END AS outcome FROM l LEFT JOIN b ON b.check_id = l.check_id""")
def reclassify_latest(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("check_id"), F.expr(_VERDICT).alias("told"))
    one = e.where("check_id % 3 < 2").select("check_id", F.lit("1+a").alias("classifier_version"), F.when(F.col("check_id") % 4 == 0, "live").otherwise(F.col("told")).alias("classification"))
    two = e.where("check_id % 5 = 0").select("check_id", F.lit("1+b").alias("classifier_version"), F.lit("parked").alias("classification"))
    return state.reclassify(e, one.unionByName(two), "1+b", F.col("told"))


@register(f"""WITH j AS (SELECT event_id, '1+a' AS classifier_version, {_VERDICT} AS classification FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, '1+b', 'parked' FROM events WHERE event_id % 5 = 0)
SELECT user_id, e.event_id, classifier_version, classification FROM events e LEFT JOIN j ON j.event_id = e.event_id QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e.event_id DESC, classifier_version DESC NULLS LAST) <= 40""")
def check_history(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.expr(_VERDICT).alias("told"))
    one = e.where("event_id % 3 < 2").select("event_id", F.lit("1+a").alias("classifier_version"), F.col("told").alias("classification"))
    two = e.where("event_id % 5 = 0").select("event_id", F.lit("1+b").alias("classifier_version"), F.lit("parked").alias("classification"))
    return state.history(e.select("user_id", "event_id"), one.unionByName(two), "user_id", "event_id", 40)


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def last_checks(spark, d):
    e, none = table(spark, d, "events").select("user_id", "event_id", "event_type"), spark.createDataFrame([], "event_id bigint, classifier_version string")
    return state.history(e, none, "user_id", "event_id", 5).select("user_id", "event_id", "event_type")


ERRORS = (
    [(k, "dns_failure", 1.0) for k in ("dns_nxdomain", "dns_error", "dns_error:SERVFAIL")] + [(k, "tls_failure", 1.0) for k in ("tls_cert_expired", "tls_hostname_mismatch", "tls_chain_untrusted", "tls_error")]
    + [(k, "temporarily_unavailable", 0.9) for k in ("connect_timeout", "read_timeout", "pool_timeout", "timeout", "connect_error", "read_error", "protocol_error", "connection_refused")]
    + [(k, "unclassified", 0.5) for k in ("redirect_loop", "too_many_redirects", "no_host", "unsupported_protocol", "blocked_address")] + [(k, "unclassified", 0.3) for k in ("http_error:X", "unexpected:Y", "dns", "permanent")]
)


@register(values(ERRORS, "error_kind, classification, confidence").replace("SELECT *", "SELECT error_kind, classification, confidence::DOUBLE AS confidence"))
def error_kinds(spark, d):
    rows = spark.createDataFrame([(k,) for k, *_ in ERRORS], "error_kind string")
    v = classify.classify_url(F.lit("allowed"), F.lit(True), F.col("error_kind"), F.lit(None).cast("int"), classify.verdict("live", 0.9, "HTTP 200"))
    return rows.select("error_kind", v["classification"].alias("classification"), v["confidence"].alias("confidence"))


_BIG = 9999
CONTENT = [  # title, body, url, final_url, redirects, length, crossed, then what is told
    ("Home", "hello", "http://a.com/x", "http://a.com/x", 0, 100, False, "live", "HTTP 200"), ("Home", "hello", "http://a.com/x", "http://a.com/", 1, 100, False, "soft_404", "deep path to root;thin body:100"), ("Home", "hello", "http://a.com/x", "http://a.com/", 0, 100, False, "live", "HTTP 200"),
    ("Home", "hello", "http://a.com/", "http://b.com/", 2, _BIG, True, "redirect", "2 redirect(s) to http://b.com/;cross-domain handover"), ("Page not found", "x", "http://a.com/x", "http://a.com/x", 0, _BIG, False, "soft_404", "title:not found"), ("x", "Sorry, this page is gone", "http://a.com/x", "http://a.com/x", 0, 12, False, "soft_404", "body:sorry, this page;thin body:12"),
    ("x", "sedoparking.com related searches", "http://a.com/", "http://a.com/", 0, _BIG, False, "parked", "parking:sedoparking.com;weak:related searches"), ("x", "Buy this domain", "http://a.com/", None, 0, _BIG, False, "for_sale", "sale:buy this domain"), ("x", "buy this domain sedoparking.com", "http://a.com/", None, 0, _BIG, False, "for_sale", "sale:buy this domain;parking:sedoparking.com"),
    (None, None, "http://a.com/x", "http://a.com/x", None, None, None, "live", "HTTP 200"),
]


@register(values([(i, *r[7:]) for i, r in enumerate(CONTENT)], "case_no, classification, reasons"))
def content_reasons(spark, d):
    rows = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(CONTENT)], "case_no int, title string, body string, url string, final_url string, redirects int, length int, crossed boolean")
    v = classify.classify_content(*(F.col(c) for c in ("title", "body", "url", "final_url", "redirects", "length", "crossed")))
    return rows.select("case_no", v.alias("v")).select("case_no", "v.classification", F.array_join("v.reasons", ";").alias("reasons"))


_URLS = "p_partkey AS url_hash, p_name AS url, p_partkey % 120 AS domain_id, CASE p_size % 6 WHEN 0 THEN 'hard_404' WHEN 1 THEN 'live' WHEN 2 THEN 'parked' WHEN 3 THEN 'dns_failure' WHEN 4 THEN 'soft_404' ELSE 'redirect' END AS state, p_size = 50 AS terminal, CASE WHEN p_size % 5 > 0 THEN p_size * 10 END AS next_check_at, CASE WHEN p_size % 7 > 0 THEN p_size * 3 END AS last_checked"
_SITES = "s_suppkey AS domain_id, CASE WHEN s_nationkey = 0 THEN '' ELSE s_name END AS registrable_domain, CASE s_nationkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'expiring' WHEN 2 THEN 'parked' WHEN 3 THEN 'unregistered' ELSE 'unknown' END AS state, s_nationkey = 24 AS terminal, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 5 END AS next_check_at, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS last_checked, s_suppkey % 17 AS wiki_page_count"
_LINKS = "l_orderkey * 10 + l_linenumber AS id, l_orderkey AS page_id, l_linestatus AS dump_run, l_partkey AS url_hash, CASE WHEN l_quantity < 10 THEN 'done' ELSE 'pending' END AS enrich_status"
_PAGES = "o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS dump_run, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey // 100 END AS ms_offset, 'page ' || o_orderkey AS title"
_WITH = f"WITH urls AS (SELECT {_URLS} FROM part), sites AS (SELECT {_SITES} FROM supplier), links AS (SELECT {_LINKS} FROM lineitem), wiki AS (SELECT {_PAGES} FROM orders)"


def _made(spark, d, name, exprs):
    return table(spark, d, name).select(F.expr(f"struct({exprs.replace('//', 'div')})").alias("r")).select("r.*")


def _urls(spark, d):
    return _made(spark, d, "part", _URLS)


def _sites(spark, d):
    return _made(spark, d, "supplier", _SITES)


def _links(spark, d):
    return _made(spark, d, "lineitem", _LINKS)


def _wiki(spark, d):
    return _made(spark, d, "orders", _PAGES)


_DEATH = "CASE u.state WHEN 'dns_failure' THEN 6 WHEN 'parked' THEN 4 WHEN 'soft_404' THEN 2 WHEN 'hard_404' THEN 2 ELSE 0 END"
_WEIGHT = "CASE state WHEN 'unregistered' THEN 50 WHEN 'expiring' THEN 35 WHEN 'parked' THEN 20 WHEN 'unknown' THEN 3 ELSE 0 END"


@register(f"{_WITH} SELECT url_hash, url, coalesce(registrable_domain, '') AS site FROM urls u LEFT JOIN sites s ON s.domain_id = u.domain_id WHERE NOT u.terminal AND (u.next_check_at IS NULL OR u.next_check_at <= 300) ORDER BY u.last_checked IS NOT NULL, {_DEATH} DESC, u.last_checked NULLS FIRST, url_hash LIMIT 200")
def due_urls_ranked(spark, d):
    return queues.due_urls(_urls(spark, d), _sites(spark, d), F.lit(300), 200)


_DUE = "(next_check_at IS NULL OR next_check_at <= 400) AND registrable_domain <> '' AND NOT terminal"


@register(f"{_WITH} SELECT domain_id, registrable_domain FROM sites s WHERE {_DUE} AND (last_checked IS NULL OR EXISTS (SELECT 1 FROM urls u WHERE u.domain_id = s.domain_id AND u.state IN ('dns_failure', 'for_sale', 'hard_404', 'parked', 'soft_404', 'tls_failure'))) ORDER BY last_checked IS NOT NULL, {_WEIGHT} DESC, wiki_page_count DESC, domain_id LIMIT 40")
def due_domains_ranked(spark, d):
    return queues.due_domains(_sites(spark, d), _urls(spark, d), F.lit(400), limit=40)


@register(f"{_WITH} SELECT domain_id, registrable_domain FROM sites WHERE registrable_domain <> '' AND NOT terminal AND state IN ('parked', 'unknown')")
def due_domains_forced(spark, d):
    return queues.due_domains(_sites(spark, d), _urls(spark, d), F.lit(0), ["parked", "unknown"], force=True)


_ENRICH = f"{_WITH}, c AS (SELECT e.id, e.page_id, p.ms_offset, p.title, e.dump_run FROM links e JOIN urls u ON u.url_hash = e.url_hash LEFT JOIN sites s ON s.domain_id = u.domain_id JOIN wiki p ON p.page_id = e.page_id AND p.dump_run = e.dump_run WHERE (u.state IN ('parked', 'dns_failure') OR s.state = 'expiring') AND e.enrich_status = 'pending' AND p.ms_offset IS NOT NULL)"


def _enrichable(spark, d):
    return queues.enrichable(_links(spark, d), _urls(spark, d), _sites(spark, d), _wiki(spark, d), ["parked", "dns_failure"], ["expiring"])


@register(f"{_ENRICH} SELECT id, page_id, ms_offset::BIGINT AS ms_offset, title FROM c ORDER BY ms_offset, page_id, id LIMIT 500")
def enrich_queue(spark, d):
    return queues.enrich_order(_enrichable(spark, d), 500).select("id", "page_id", F.col("ms_offset").cast("bigint").alias("ms_offset"), "title")


@register(f"{_ENRICH} SELECT dump_run, count(*)::BIGINT AS pending FROM c GROUP BY 1")
def enrich_pending(spark, d):
    return _enrichable(spark, d).groupBy("dump_run").agg(F.count(F.lit(1)).alias("pending"))


@register(f"{_ENRICH} SELECT ms_offset::BIGINT AS ms_offset, string_agg(page_id || ':' || id, ',' ORDER BY page_id, id) AS members FROM c GROUP BY 1")
def block_members(spark, d):
    b = queues.by_block(_enrichable(spark, d))
    return b.select(F.col("ms_offset").cast("bigint").alias("ms_offset"), F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["page_id"].cast("string"), m["id"].cast("string"))), ",").alias("members"))


@register(f"{_WITH} SELECT id, page_id FROM links WHERE page_id IN (SELECT doc_id FROM labels)")
def slice_links(spark, d):
    return queues.in_slice(_links(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))).select("id", "page_id")


@register(f"{_WITH} SELECT coalesce(nullif(s.registrable_domain, ''), u.url) AS unit, count(*)::BIGINT AS n FROM urls u LEFT JOIN sites s ON s.domain_id = u.domain_id GROUP BY 1")
def site_units(spark, d):
    u = _urls(spark, d).join(_sites(spark, d).select("domain_id", "registrable_domain"), "domain_id", "left")
    return queues.by_site(u, "registrable_domain", "url").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


_STAGES = "o_orderkey AS stage, o_custkey AS done, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey + o_orderkey % 500 END AS total, o_orderkey % 40 AS started_at, o_orderkey % 40 + o_custkey % 90 AS updated_at, CASE WHEN o_orderstatus = 'F' THEN 1 END AS finished_at, CASE WHEN o_orderkey % 3 = 0 THEN 'ok' END AS outcome"


@register(f"WITH s AS (SELECT {_STAGES} FROM orders) SELECT stage, round(least(100.0, 100.0 * done / total)::DOUBLE, 6) AS percent, round(CASE WHEN updated_at > started_at AND done > 0 THEN done::DOUBLE / (updated_at - started_at) END, 6) AS rate, round(CASE WHEN total IS NOT NULL AND updated_at > started_at AND done > 0 THEN greatest(0, total - done) / (done::DOUBLE / (updated_at - started_at)) END, 6) AS eta, CASE WHEN finished_at IS NULL AND 170 - updated_at > 90 THEN 'stalled' WHEN finished_at IS NULL THEN 'running' ELSE coalesce(outcome, 'done') END AS status FROM s")
def stage_views(spark, d):
    s = queues.stage_view(_made(spark, d, "orders", _STAGES), F.lit(170))
    return s.select("stage", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("percent", "rate", "eta")), "status")


_RETRY = [("120", 120.0), (" 2.5 ", 2.5), ("-3", 0.0), ("Wed, 21 Oct 2026 07:28:00 GMT", 480.0), ("Tue, 20 Oct 2026 07:28:00 GMT", 0.0), ("soon", None), ("", None), (None, None)]


@register(values([(i, *r) for i, r in enumerate(_RETRY)], "case_no, value, seconds").replace("SELECT *", "SELECT case_no, seconds::DOUBLE AS seconds"))
def retry_after(spark, d):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_RETRY)], "case_no int, value string")
    return rows.select("case_no", net.retry_after(F.col("value"), F.expr("TIMESTAMP '2026-10-21 07:20:00 UTC'")).alias("seconds"))


@register("SELECT l_orderkey AS k, l_linenumber AS n, least(60.0, pow(2.0, greatest(l_linenumber - 1, 0)))::DOUBLE AS ceiling, l_returnflag = 'R' AND l_linenumber < 4 AS again FROM lineitem")
def backoff_ceilings(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), net.backoff_ceiling(n).alias("ceiling"), net.should_retry(n, F.col("l_returnflag") == "R", 4).alias("again"))


_ROBOTS = [(None, True, False), (200, True, True), (200, False, False), (404, False, True), (403, False, True), (429, True, False), (500, True, False), (503, True, False), (302, False, True)]


@register(values([(i, a) for i, (_, _, a) in enumerate(_ROBOTS)], "case_no, allowed"))
def robots_status(spark, d):
    rows = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(_ROBOTS)], "case_no int, status int, rules boolean")
    return rows.select("case_no", net.robots_verdict(F.col("status"), F.col("rules"))["allowed"].alias("allowed"))


_ADDRESSES = [("169.254.169.254", "cloud metadata endpoint"), ("0.0.0.0", "unspecified"), ("127.1.2.3", "loopback"), ("169.254.1.1", "link-local"), ("224.0.0.1", "multicast"), ("10.0.0.1", "private range"), ("172.31.255.255", "private range"), ("172.32.0.1", None), ("192.168.1.1", "private range"), ("8.8.8.8", None), ("240.0.0.1", "private range"), ("::1", "loopback"), ("::ffff:127.0.0.1", "loopback"), ("fe80::1", "link-local"), ("2606:4700::1111", None), ("example.com", None), ("256.1.1.1", None)]


@register(values(_ADDRESSES, "address, reason"))
def refused_addresses(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _ADDRESSES], "address string").select("address", net.refused_address(F.col("address")).alias("reason"))


@register("SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag = 'A' OR l_linestatus = 'F' AND l_returnflag = 'R' AS expiring FROM lineitem")
def expiring_statuses(spark, d):
    s = F.array(F.when(F.col("l_returnflag") == "A", " Pending Delete ").otherwise("active"), F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "serverHold").otherwise("auto renew period"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), net.is_expiring(s).alias("expiring"))


@register("SELECT user_id, n::BIGINT AS repeats, n >= 3 AS terminal FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) UNION ALL SELECT -1, 5, false")
def terminal_links(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("repeats")).select("user_id", "repeats", state.is_terminal(F.lit("hard_404"), F.col("repeats")).alias("terminal"))
    return e.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(5).cast("bigint").alias("repeats"), state.is_terminal(F.lit("live"), F.lit(5)).alias("terminal")))


_REGISTRY = [("uk", "https://rdap.uk/"), ("co.uk", "https://rdap.co.uk/"), ("COM", "https://rdap.com/"), ("net", "https://rdap.net/")]


@register(f"WITH b AS ({values(_REGISTRY, 'tld, base_url')}), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.uk' ELSE '' END AS domain FROM pages) SELECT page_id, CASE WHEN domain LIKE '%.co.uk' THEN 'https://rdap.co.uk/' WHEN domain LIKE '%.uk' THEN 'https://rdap.uk/' WHEN domain LIKE '%.com' THEN 'https://rdap.com/' WHEN domain LIKE '%.net' THEN 'https://rdap.net/' END AS base_url FROM p")
def registry_suffix(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.expr("CASE page_id % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.uk' ELSE '' END")).alias("domain"))
    return dumps.registry_urls(p, spark.createDataFrame(_REGISTRY, "tld string, base_url string")).select("page_id", "base_url")


_CROSSED = [("http://www.bbc.co.uk/x", "http://news.bbc.co.uk/", False), ("http://bbc.co.uk/", "http://itv.co.uk/", True), ("http://10.0.0.1/", "http://a.com/", False), ("http://a.com/", None, False), ("http://a.github.io/", "http://b.github.io/", True)]


@register(values([(i, r[2]) for i, r in enumerate(_CROSSED)], "case_no, crossed"))
def crossed_domains(spark, d):
    rows = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(_CROSSED)], "case_no int, a string, b string")
    return rows.select("case_no", urls.crossed_domain(F.col("a"), F.col("b")).alias("crossed"))


@register(values([(h, a) for h, a in (("example.com", True), ("127.0.0.1", False), ("en.wikipedia.org", False), ("dx.doi.org", False), ("foo.blogspot.com", True))], "host, acquireable"))
def acquireable_hosts(spark, d):
    return spark.createDataFrame([("example.com",), ("127.0.0.1",), ("en.wikipedia.org",), ("dx.doi.org",), ("foo.blogspot.com",)], "host string").select("host", urls.acquireable(F.col("host")).alias("acquireable"))


@register("SELECT o_orderkey AS k, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' WHEN s < 86400 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 86400 || 'd ' || s % 86400 // 3600 || 'h' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 100000) AS BIGINT) AS s FROM orders)")
def durations(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), reports.duration(F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 100000)).alias("shown"))


_SETTINGS = [("API_KEY", "x", "<redacted>"), ("github_token", "y", "<redacted>"), ("DB_PASSWORD", "", ""), ("HOME", "/root", "/root"), ("KEYBOARD", "us", "us"), ("A_SECRET", None, None)]


@register(values([(n, s) for n, _, s in _SETTINGS], "name, shown"))
def redacted_settings(spark, d):
    return spark.createDataFrame([r[:2] for r in _SETTINGS], "name string, value string").select("name", net.redacted(F.col("name"), F.col("value")).alias("shown"))


@register("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def unexpired_cache(spark, d):
    return queues.unexpired(table(spark, d, "events").withColumn("expires_at", F.col("ts").cast("string")), F.expr("TIMESTAMP '2024-01-15 00:00:00'")).select("event_id", "user_id")


@register(f"SELECT version FROM (VALUES ('{policy.fingerprint()[:2]}')) AS t(version)")
def classifier_version(spark, d):
    return spark.range(1).select(F.substring(F.lit(policy.fingerprint()), 1, 2).alias("version"))
