"""The registered queries of the link-health engine over the driver's tables, with their DuckDB equivalents.

Roles: pages are observed URLs; events are an append-only check log (user_id the key, event_id the order, event_type
the verdict); customer, orders and lineitem are sites, URLs and links; documents are articles, labels annotations.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeflow import policy
from citeflow.functions import pages, urls
from citeflow.operators import classify, graph, state
from citeflow.plans.registry import oracle_sql, queries, register as _query, table as _t, values as _values
from citeflow.sources import dumps, wikitext

_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_NORM = r"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ||
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END ||
  CASE WHEN array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: NOT starts_with(p, 'utm_')), '&') = '' THEN ''
    ELSE '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: NOT starts_with(p, 'utm_')), '&') END"""


@_query(f"SELECT page_id, {_NORM} AS url_normalized, sha256({_NORM}) AS url_hash FROM pages")
def url_normalize(spark, d):
    u = urls.canonical(_t(spark, d, "pages").select("page_id", "url"), "url", "url_normalized")
    return u.select("page_id", "url_normalized", urls.url_hash(F.col("url_normalized")).alias("url_hash"))


@_query(f"SELECT {_HOST} AS host, count(*)::BIGINT AS cites, count(DISTINCT {_NORM})::BIGINT AS urls FROM pages GROUP BY 1 ORDER BY cites DESC, urls DESC, host")
def host_rollup(spark, d):
    u = _t(spark, d, "pages").select(urls.normalize_host(urls.host_of(urls.part(F.col("url"), 2))).alias("host"), urls.normalize(F.col("url")).alias("u"))
    return u.groupBy("host").agg(F.count(F.lit(1)).alias("cites"), F.count_distinct("u").alias("urls")).orderBy(F.desc("cites"), F.desc("urls"), "host")


@_query(f"SELECT regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS registrable, count(*)::BIGINT AS cites, count(DISTINCT {_HOST})::BIGINT AS hosts FROM pages GROUP BY 1")
def registrable_rollup(spark, d):
    h = _t(spark, d, "pages").select(urls.normalize_host(urls.host_of(urls.part(F.col("url"), 2))).alias("h"))
    return h.groupBy(urls.suffix_analysis(F.col("h"))["registrable"].alias("registrable")).agg(F.count(F.lit(1)).alias("cites"), F.count_distinct("h").alias("hosts"))


@_query(f"WITH u AS (SELECT page_id, {_NORM} AS u FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n, count(*) OVER (PARTITION BY u) AS c FROM u) SELECT page_id AS first_page, u AS url_normalized, c::BIGINT AS cite_count FROM r WHERE n = 1")
def url_dedup_counts(spark, d):
    u = _t(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("url_normalized"))
    return u.groupBy("url_normalized").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("cite_count"))


NORMALIZED = [
    ("HTTP://Example.COM/Path", "http://example.com/Path"), ("http://a.com:80/x", "http://a.com/x"), ("https://a.com:443/x#f", "https://a.com/x"), ("https://a.com:8443", "https://a.com:8443/"), ("http://a.com/a/./b/../c", "http://a.com/a/c"),
    ("http://a.com/../a//b", "http://a.com/a//b"), ("http://a.com/%7Euser%2fx%41", "http://a.com/~user%2FxA"), ("http://a.com/?b=1&utm_source=x&a=2", "http://a.com/?b=1&a=2"), ("http://a.com/?q=a%20b", "http://a.com/?q=a%20b"), ("http://a.com/?q=a%20b~&fbclid=1", "http://a.com/?q=a+b~"),
    ("http://u:p@a.com/", "http://a.com/"), ("https://web.archive.org/web/20200101000000id_/https:/x.org/y", "https://x.org/y"), ("https://archive.ph/newest/http://x.org/z", "http://x.org/z"), ("https://ghostarchive.org/archive/1", "https://ghostarchive.org/archive/1"), ("http://A.com./x", "http://a.com/x"), ("http://BÜCHER.de:8080/ü?x=1", "http://xn--bcher-kva.de:8080/ü?x=1"), ("https://straße.de", "https://xn--strae-oqa.de/"), ("http://www.例え.jp/a", "http://www.xn--r8jz45g.jp/a"),
]


@_query(_values(NORMALIZED, "raw, url"))
def url_normalize_cases(spark, d):
    return spark.createDataFrame([(r,) for r, _ in NORMALIZED], "raw string").transform(urls.canonical, "raw", "url")


RECONSTRUCTED = [
    ("http://edu.berkeley.housing.www.", "/housing/", "http://www.housing.berkeley.edu/housing/"), ("http://uk.co.linearb.:8080", None, "http://linearb.co.uk:8080"), ("http://V4.66.102.9.104.", "/a", "http://66.102.9.104/a"), ("HTTPS://com.example.", "", "https://example.com"), ("nothing", "/x", None),
]


@_query(_values(RECONSTRUCTED, "domain_index, path, url"))
def reconstruct_url(spark, d):
    rows = spark.createDataFrame([r[:2] for r in RECONSTRUCTED], "domain_index string, path string")
    return rows.select("domain_index", "path", urls.reconstruct(F.col("domain_index"), F.col("path")).alias("url"))


DROPPED = [
    ("https://en.wikipedia.org/wiki/X", "wikimedia_internal"), ("https://doi.org/10.1/x", "identifier_resolver"), ("https://dx.doi.org/1", "identifier_resolver"), ("mailto:a@b.c", "not_crawlable_scheme"), ("ftp://a.com/x", "not_crawlable_scheme"), ("http:///x", "no_host"), ("https://notwikipedia.org/", None), ("https://mydoi.org/", None),
]


@_query(f"SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM ({_values(DROPPED, 'raw, reason')} UNION ALL SELECT url, NULL FROM pages) GROUP BY 1")
def drop_reason_counts(spark, d):
    rows = spark.createDataFrame([(r,) for r, _ in DROPPED], "raw string").unionByName(_t(spark, d, "pages").select(F.col("url").alias("raw")))
    return rows.groupBy(F.coalesce(urls.drop_reason(F.col("raw")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


HOSTS = [("news.bbc.co.uk", "bbc.co.uk", False), ("foo.blogspot.com", "foo.blogspot.com", True), ("wbc.poznan.pl", "wbc.poznan.pl", True), ("blogspot.com", "", False), ("127.0.0.1", "", False), ("a.b.ck", "a.b.ck", False), ("www.ck", "www.ck", False), ("host.unlisted", "", False), ("example.com", "example.com", False)]


@_query(_values([(h, r) for h, r, _ in HOSTS], "host, registrable"))
def registrable_cases(spark, d):
    return spark.createDataFrame([(h,) for h, *_ in HOSTS], "host string").select("host", urls.suffix_analysis(F.col("host"))["registrable"].alias("registrable"))


@_query(r"SELECT page_id, nullif(substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), 1, 512), '') AS title, length(regexp_replace(regexp_replace(html, '(?is)(<script\b.*?</script>|<style\b.*?</style>)', '', 'g'), '(?is)\sstyle=\"[^\"]*\"', '', 'g'))::BIGINT AS clean_len FROM pages")
def title_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", pages.title(F.col("html")).alias("title"), F.length(pages.clean_html(F.col("html"))).cast("bigint").alias("clean_len"))


@_query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages) SELECT page_id, href, count(*)::BIGINT AS n FROM h GROUP BY ALL""")
def html_links_explode(spark, d):
    x = _t(spark, d, "pages").select("page_id", F.explode(pages.links(F.col("html"))).alias("l"))
    return x.groupBy("page_id", F.col("l.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_TITLE = r"lower(coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''))"


@_query(f"""WITH s AS (SELECT page_id, length(html) AS n, {_any('lower(html)', policy.PARKING_PROVIDERS + policy.PARKING_PHRASES)} AS park, {_any('lower(html)', policy.SALE_PHRASES)} AS sale,
  (CASE WHEN {_any(_TITLE, policy.SOFT_TITLES)} THEN 2 ELSE 0 END + CASE WHEN {_any('lower(html)', policy.SOFT_PHRASES)} THEN 2 ELSE 0 END + CASE WHEN length(html) < 512 THEN 1 ELSE 0 END) AS soft FROM pages)
SELECT page_id, CASE WHEN sale AND park THEN 'for_sale' WHEN park THEN 'parked' WHEN sale THEN 'for_sale' WHEN soft >= 2 THEN 'soft_404' ELSE 'live' END AS classification, soft::BIGINT AS soft_score FROM s""")
def classify_content(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", "html", pages.title(F.col("html")).alias("title"))
    v = p.select("page_id", classify.classify_content(F.col("title"), F.col("html"), F.col("url"), F.col("url"), F.lit(0), F.length("html")).alias("v"))
    return v.select("page_id", "v.classification", F.col("v.soft_score").cast("bigint").alias("soft_score"))


_STATUS = "CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 503 ELSE 403 END"


@_query(f"SELECT event_id, CASE s WHEN 404 THEN 'hard_404' WHEN 503 THEN 'temporarily_unavailable' WHEN 200 THEN 'live' WHEN 403 THEN 'live' ELSE 'unclassified' END AS classification, CASE s WHEN 404 THEN 1.0 WHEN 503 THEN 1.0 WHEN 200 THEN 0.9 WHEN 403 THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence FROM (SELECT event_id, {_STATUS} AS s FROM events)")
def classify_status(spark, d):
    e = _t(spark, d, "events").withColumn("s", F.expr(_STATUS))
    v = classify.classify_url(F.lit("allowed"), F.lit(True), F.lit(None).cast("string"), F.col("s"), classify.verdict("live", 0.9, "HTTP 200"))
    return e.select("event_id", v.alias("v")).select("event_id", "v.classification", "v.confidence")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_check_per_key(spark, d):
    return state.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def latest_successful_check(spark, d):
    return state.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") != "error").select("user_id", "event_id", "event_type")


_FAIL = "WITH f AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), c AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS n FROM f)"


@_query("WITH r AS (SELECT user_id, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS event_type FROM events) SELECT user_id, event_type, coalesce(min(CASE WHEN s <> event_type THEN i - 1 END), max(i))::BIGINT AS streak FROM r WHERE i <= 20 GROUP BY 1, 2")
def verdict_streak(spark, d):
    return state.streak(_t(spark, d, "events"), "user_id", "event_id", "event_type")


@_query(f"{_FAIL} SELECT event_id, n::BIGINT AS consecutive_failures FROM c")
def consecutive_failures(spark, d):
    e = state.failures(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type").isin("error", "click"))
    return e.select("event_id", "consecutive_failures")


@_query(f"{_FAIL} SELECT user_id, max(n)::BIGINT AS worst, max(n) >= 5 AS tripped FROM c GROUP BY 1")
def circuit_breaker(spark, d):
    e = state.failures(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type").isin("error", "click"))
    return e.groupBy("user_id").agg(F.max("consecutive_failures").alias("worst"), (F.max("consecutive_failures") >= policy.BREAKER).alias("tripped"))


RECHECKS = [("hard_404", 0, 2592000), ("hard_404", 1, 5184000), ("hard_404", 3, 15552000), ("temporarily_unavailable", 0, 3600), ("temporarily_unavailable", 4, 57600), ("temporarily_unavailable", 5, 604800), ("live", 3, 7776000), ("parked", 0, 604800), ("other", 0, 2592000)]


@_query(_values(RECHECKS, "state, repeats, seconds"))
def recheck_cadence(spark, d):
    return spark.createDataFrame([r[:2] for r in RECHECKS], "state string, repeats int").select("state", "repeats", state.recheck_seconds(F.col("state"), F.col("repeats")).cast("int").alias("seconds"))


_NOW = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
_CHECKED = "SELECT user_id, max(ts) + INTERVAL 1 DAY * (user_id % 9) AS next_at, user_id % 11 = 0 AS terminal FROM events GROUP BY user_id"


def _scheduled(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    return e.select("user_id", (F.col("t") + F.make_interval(days=(F.col("user_id") % 9).cast("int"))).cast("timestamp_ntz").alias("next_at"), (F.col("user_id") % 11 == 0).alias("terminal"))


@_query(f"SELECT user_id, next_at FROM ({_CHECKED}) WHERE NOT terminal AND next_at <= TIMESTAMP '2024-02-01 00:00:00'")
def due_queue(spark, d):
    return graph.due(_scheduled(spark, d), F.col("next_at"), F.col("terminal"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("user_id", "next_at")


@_query(f"SELECT count(*) FILTER (terminal)::BIGINT AS terminal, count(*) FILTER (NOT terminal AND next_at IS NULL)::BIGINT AS never, count(*) FILTER (NOT terminal AND next_at <= n)::BIGINT AS due, count(*) FILTER (NOT terminal AND next_at > n AND next_at <= n + INTERVAL 7 DAY)::BIGINT AS soon, count(*) FILTER (NOT terminal AND next_at > n + INTERVAL 7 DAY)::BIGINT AS later FROM ({_CHECKED}), (SELECT TIMESTAMP '2024-01-31 00:00:00' AS n)")
def schedule_buckets(spark, d):
    return graph.schedule_buckets(_scheduled(spark, d), F.col("next_at"), F.col("terminal"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))


@_query("SELECT user_id, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before <> event_type")
def version_flip_report(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, d, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before")).where("before <> event_type")


@_query("SELECT l_partkey AS part, count(*)::BIGINT AS cite_count, count(DISTINCT l_orderkey)::BIGINT AS distinct_page_count FROM lineitem GROUP BY 1")
def link_counts_per_key(spark, d):
    return graph.link_counts(_t(spark, d, "lineitem").select("l_partkey", "l_orderkey"), "l_partkey", "l_orderkey").withColumnRenamed("l_partkey", "part")


@_query("""WITH u AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS custkey, coalesce(u.n, 0)::BIGINT AS url_count, coalesce(l.n, 0)::BIGINT AS wiki_link_count, coalesce(l.p, 0)::BIGINT AS wiki_page_count FROM customer LEFT JOIN u ON u.k = c_custkey LEFT JOIN l ON l.k = c_custkey""")
def link_counts_per_parent(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_partkey")
    return graph.parent_counts(_t(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), o, li, "custkey", "orderkey", "l_partkey")


@_query("SELECT o_custkey AS custkey, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS filled, count(*)::BIGINT AS total, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 AND 2 * count(*) FILTER (o_orderstatus = 'F') >= count(*) THEN 'for_sale' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 AND 2 * count(*) FILTER (o_orderstatus = 'O') >= count(*) THEN 'parked' END AS lifted FROM orders GROUP BY 1")
def state_tally(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count(F.lit(1)).alias("total"))
    return o.withColumn("lifted", classify.lifted_state(F.col("filled"), F.col("open"), F.col("total")))


_SCORE = """WITH k AS (SELECT o_custkey AS c, count(DISTINCT l_partkey) AS p, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_discount > 0.09 AND l_tax < 0.01) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
u AS (SELECT o_custkey AS c, bool_or(o_orderstatus = 'F') AS dead, bool_or(o_orderstatus = 'P') AS soft FROM orders GROUP BY 1)
SELECT c_custkey AS custkey, (CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 20 ELSE 0 END + least(3 * coalesce(p, 0), 30) + CASE WHEN dead THEN 6 WHEN soft THEN 2 ELSE 0 END + CASE WHEN a THEN 8 WHEN r THEN 4 ELSE 0 END + CASE WHEN f > 0 THEN 5 ELSE 0 END + CASE WHEN x > 0 THEN 7 ELSE 0 END - CASE WHEN c_nationkey = 0 THEN 15 ELSE 0 END)::BIGINT AS candidate_score
FROM customer LEFT JOIN k ON k.c = c_custkey LEFT JOIN u ON u.c = c_custkey"""


def _scored(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    k = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("p"), F.collect_set(F.expr("CASE l_returnflag WHEN 'A' THEN 'citation' WHEN 'R' THEN 'further_reading' END")).alias("kinds"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if((F.col("l_discount") > 0.09) & (F.col("l_tax") < 0.01)).alias("x"))
    u = o.groupBy("o_custkey").agg(F.collect_set(F.expr("CASE o_orderstatus WHEN 'F' THEN 'dns_failure' WHEN 'P' THEN 'soft_404' END")).alias("url_states"))
    c = _t(spark, d, "customer").join(k.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(u.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    none = F.array().cast("array<string>")
    sites = c.select(
        F.col("c_custkey").alias("custkey"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'unregistered' WHEN 'MACHINERY' THEN 'parked' ELSE 'active' END").alias("state"), F.coalesce("p", F.lit(0)).alias("wiki_page_count"),
        F.coalesce("url_states", none).alias("url_states"), F.coalesce("kinds", none).alias("kinds"), F.coalesce("f", F.lit(0)).alias("dead_tags"), graph.removed_links(F.col("x"), F.lit(0)).alias("removed"), (F.col("c_nationkey") == 0).alias("is_private"),
    )
    return graph.score(sites)


@_query(_SCORE)
def candidate_score(spark, d):
    return _scored(spark, d).select("custkey", "candidate_score")


@_query(f"SELECT custkey, candidate_score FROM ({_SCORE}) ORDER BY candidate_score DESC, custkey LIMIT 100")
def export_ranked(spark, d):
    return _scored(spark, d).select("custkey", "candidate_score").orderBy(F.desc("candidate_score"), "custkey").limit(100)


_PART = "CASE WHEN {1} <> 0 THEN '{{\"name\":\"' || {0} || '\",\"points\":' || ({1}) || '}}' END"
_PARTS = [
    ("'state:' || CASE c_mktsegment WHEN 'BUILDING' THEN 'unregistered' WHEN 'MACHINERY' THEN 'parked' ELSE 'active' END", "CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 20 ELSE 0 END"), ("'pages'", "least(3 * coalesce(p, 0), 30)"),
    ("CASE WHEN dead THEN 'url:dns_failure' ELSE 'url:soft_404' END", "CASE WHEN dead THEN 6 WHEN soft THEN 2 ELSE 0 END"), ("CASE WHEN a THEN 'kind:citation' ELSE 'kind:further_reading' END", "CASE WHEN a THEN 8 WHEN r THEN 4 ELSE 0 END"),
    ("'dead_tag'", "CASE WHEN f > 0 THEN 5 ELSE 0 END"), ("'removed'", "CASE WHEN x > 0 THEN 7 ELSE 0 END"), ("'private_suffix'", "CASE WHEN c_nationkey = 0 THEN -15 ELSE 0 END"),
]
_TOLD = "'[' || concat_ws(',', " + ", ".join(_PART.format(n, p) for n, p in _PARTS) + ") || ']'"


@_query(_SCORE.replace(" AS candidate_score", f" AS candidate_score, {_TOLD} AS score_explanation"))
def score_components(spark, d):
    return _scored(spark, d).select("custkey", "candidate_score", "score_explanation")


@_query("SELECT l_partkey AS part, l_orderkey AS orderkey, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'A') DESC, l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def representative_link(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_shipdate")
    return graph.first_by(li, ["part"], F.desc_nulls_last(F.col("l_returnflag") == "A"), F.desc("l_shipdate"), F.asc("orderkey"), F.asc("line")).select("part", "orderkey", "line")


@_query("SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def domains_due_exists_or(spark, d):
    seen = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return _t(spark, d, "customer").join(seen, "c_custkey", "left").where((F.col("c_acctbal") < 0) | F.col("seen")).select(F.col("c_custkey").alias("custkey"))


@_query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' OR c_mktsegment = 'BUILDING'")
def enrich_candidates(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").where((F.col("o_orderstatus") == "P") | (F.col("c_mktsegment") == "BUILDING")).select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))


_RUNS = "l AS (SELECT DISTINCT CAST(ts AS DATE) AS run, user_id, event_type FROM events), p AS (SELECT DISTINCT run, user_id FROM l)"
_A, _B = "DATE '2024-01-10'", "DATE '2024-01-11'"


def _runs(spark, d):
    return _t(spark, d, "events").select(F.to_date("ts").alias("run"), "user_id", "event_type")


@_query(f"""WITH {_RUNS}, b AS (SELECT user_id FROM p WHERE run = {_A} INTERSECT SELECT user_id FROM p WHERE run = {_B})
SELECT user_id, event_type, 'removed' AS transition FROM l x WHERE run = {_A} AND user_id IN (SELECT * FROM b) AND NOT EXISTS (SELECT 1 FROM l y WHERE y.run = {_B} AND y.user_id = x.user_id AND y.event_type = x.event_type)
UNION ALL SELECT user_id, event_type, 'added' FROM l x WHERE run = {_B} AND user_id IN (SELECT * FROM b) AND NOT EXISTS (SELECT 1 FROM l y WHERE y.run = {_A} AND y.user_id = x.user_id AND y.event_type = x.event_type)""")
def run_diff(spark, d):
    return graph.run_diff(_runs(spark, d), F.expr(_A), F.expr(_B), "run", ["user_id"], "event_type").select("user_id", "event_type", "transition")


@_query(f"WITH {_RUNS} SELECT (SELECT count(*) FROM (SELECT user_id FROM p WHERE run = {_A} INTERSECT SELECT user_id FROM p WHERE run = {_B}))::BIGINT AS both_runs, (SELECT count(*) FROM (SELECT user_id FROM p WHERE run = {_A} EXCEPT SELECT user_id FROM p WHERE run = {_B}))::BIGINT AS only_old, (SELECT count(*) FROM (SELECT user_id FROM p WHERE run = {_B} EXCEPT SELECT user_id FROM p WHERE run = {_A}))::BIGINT AS only_new")
def run_overlap(spark, d):
    return graph.run_overlap(_runs(spark, d), F.expr(_A), F.expr(_B), "run", ["user_id"]).withColumnRenamed("both", "both_runs")


@_query("SELECT run, lag(run) OVER (ORDER BY run) AS previous FROM (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events)")
def prev_run(spark, d):
    return _runs(spark, d).select("run").distinct().select("run", F.lag("run").over(Window.orderBy("run")).alias("previous"))


_GAPS = "SELECT l_partkey AS part, min(l_orderkey) AS first_run, count(*)::BIGINT AS citations FROM lineitem x WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_partkey = x.l_partkey AND y.l_returnflag = 'R' AND y.l_discount > 0.08) AND l_partkey NOT IN (SELECT doc_id FROM labels) GROUP BY 1"


@_query(_GAPS)
def gap_targets(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("run"), "l_returnflag", "l_discount")
    dead, told = _t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("part")), _t(spark, d, "labels").select(F.col("doc_id").alias("part"))
    return graph.gap_targets(li, dead, told, "part", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), "run").withColumnRenamed("run", "first_run")


@_query("SELECT CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic IS NULL THEN 'unknown' WHEN quality = 0 THEN 'lost' WHEN toxic = 1 THEN 'lost' ELSE 'recoverable' END AS verdict, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def gap_verdict_counts(spark, d):
    x = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").withColumn("told", F.lit(True)), "doc_id", "left")
    v = classify.gap_verdict(F.when(F.col("toxic").isNotNull(), F.col("quality") == 1), F.when(F.col("toxic") == 1, "404").otherwise("200"))
    return x.groupBy(F.when(F.col("told").isNull(), "pending").otherwise(v).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT 'customer' AS t, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, d):
    parts = [_t(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t in ("customer", "orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query("SELECT event_type, count(*)::BIGINT AS n, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM events)) AS pct FROM events GROUP BY 1")
def state_distribution(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("pct", F.format_string("%.2f%%", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@_query("SELECT CASE WHEN c = 1 THEN '1' WHEN c = 2 THEN '2' WHEN c < 5 THEN '3-4' WHEN c < 10 THEN '5-9' WHEN c < 25 THEN '10-24' ELSE '25+' END AS bucket, count(*)::BIGINT AS n, round(avg(f::INT), 6) AS rate FROM (SELECT o_custkey, count(*) AS c, bool_or(o_orderstatus = 'P') AS f FROM orders GROUP BY 1) GROUP BY 1")
def find_rate_curve(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"), F.bool_or(F.col("o_orderstatus") == "P").alias("f"))
    return o.groupBy(F.expr("CASE WHEN c = 1 THEN '1' WHEN c = 2 THEN '2' WHEN c < 5 THEN '3-4' WHEN c < 10 THEN '5-9' WHEN c < 25 THEN '10-24' ELSE '25+' END").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("f").cast("int")), 6).alias("rate"))


@_query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(n_chars) OVER () AS total FROM documents) WHERE freed < total - 200000")
def lru_eviction(spark, d):
    return state.evict(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", "doc_id", 200_000).select("doc_id")


@_query("WITH a AS (SELECT event_id // 3 AS domain, event_id % 3 AS r, CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'nxdomain' WHEN 'click' THEN 'servfail' ELSE 'timeout' END AS s FROM events), g AS (SELECT domain, min(CASE WHEN s = 'ok' THEN s END) AS ok, count(*) FILTER (s = 'nxdomain') AS nx, count(*) FILTER (s = 'servfail') AS sf, count(*) FILTER (s = 'timeout') AS t, count(DISTINCT s) = 1 AS resolvers_agreed FROM a GROUP BY 1) SELECT domain, CASE WHEN ok IS NOT NULL THEN 'ok' WHEN nx >= 2 THEN 'nxdomain' WHEN nx = 1 THEN 'error' WHEN sf > 0 THEN 'servfail' WHEN t > 0 THEN 'timeout' ELSE 'error' END AS dns_status, resolvers_agreed FROM g")
def dns_quorum(spark, d):
    a = _t(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("domain"), (F.col("event_id") % 3).alias("resolver_no"), F.expr("CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'nxdomain' WHEN 'click' THEN 'servfail' ELSE 'timeout' END").alias("status"))
    return classify.dns_quorum(a).select("domain", "dns_status", "resolvers_agreed")


DOMAINS = [
    ("nxdomain", True, "not_found", False, None, "unregistered"), ("nxdomain", True, "no_rdap_for_tld", False, None, "no_rdap_for_tld"), ("nxdomain", True, "unavailable", False, None, "unknown"), ("nxdomain", False, "registered", True, None, "unknown"), ("ok", False, "registered", True, "parked", "expiring"),
    ("ok", False, "registered", False, "parked", "parked"), ("ok", False, "registered", False, None, "active"), ("ok", False, "no_rdap_for_tld", False, None, "active"), ("error", False, "no_rdap_for_tld", False, None, "no_rdap_for_tld"), ("no_records", False, "unavailable", False, None, "active"), ("timeout", False, "unavailable", False, None, "unknown"),
]


@_query(_values([(i, r[5]) for i, r in enumerate(DOMAINS)], "case_no, classification"))
def domain_verdict(spark, d):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(DOMAINS)], "case_no int, dns string, confirmed boolean, rdap string, expiring boolean, lifted string")
    v = classify.classify_domain(*(F.col(c) for c in ("dns", "confirmed", "rdap", "expiring", "lifted")))
    return rows.select("case_no", v["classification"].alias("classification"))


@_query("SELECT source, sum(n_chars)::BIGINT AS bytes, count(*)::BIGINT AS docs FROM documents GROUP BY 1")
def block_batching(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("docs"))


NAMES = [("Miramar Inn", True), ("Blue Cafe", True), ("share", False), ("12", False), ("4 min", False), ("Hotel", False), ("Sea & Sand", True), ("$$$", False), ("ab", False)]


@_query(_values(NAMES, "name, valid"))
def business_name_valid(spark, d):
    return spark.createDataFrame([(n,) for n, _ in NAMES], "name string").select("name", pages.valid_business_name(F.col("name")).alias("valid"))


@_query("SELECT p_brand AS brand, count(*) FILTER (p_size < 10)::BIGINT AS small, count(*) FILTER (p_size >= 10)::BIGINT AS large FROM part GROUP BY 1")
def record_flatten_map(spark, d):
    m = _t(spark, d, "part").groupBy("p_brand", F.when(F.col("p_size") < 10, "small").otherwise("large").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("p_brand").alias("brand")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return pages.flatten_map(m, "m", ["small", "large"]).fillna(0)


@_query(_values([("1", "http://edu.berkeley.", "/a'b,(c)"), ("2", "http://com.bbc.", None)], "el_id, domain_index, path"))
def dump_tuple_scan(spark, d):
    line = "INSERT INTO `externallinks` VALUES (1,10,'http://edu.berkeley.','/a\\'b,(c)'),(2,12,'http://com.bbc.',NULL);"
    return dumps.insert_rows(spark.createDataFrame([(line,)], "value string"), "externallinks").select(F.col("fields")[0].alias("el_id"), F.col("fields")[2].alias("domain_index"), F.col("fields")[3].alias("path"))


_TEXT = "Lead.\n== History ==\nX <ref name=\"hist\">{{cite web |url=http://a.com/x |archive-url=http://w/1}}</ref> {{dead link}}\n=== Details ===\n[http://b.com/y Deep Link]"
_FOUND = [
    ("http://a.com/x", True, "History", 2, None, "citation", "hist", "cite web", _TEXT, True, "http://w/1", None), ("http://www.b.com/y/", True, "Details", 3, "Deep Link", "inline", None, None, _TEXT[_TEXT.index("[http") - 150 :] if len(_TEXT) > 300 else _TEXT, True, "http://w/1", None),
    ("http://none", False, None, None, None, None, None, None, None, False, None, None),
]


@_query(_values(_FOUND, "url, found, section, section_level, anchor_text, link_kind, ref_name, template_name, context_excerpt, dead_link_tagged, archive_url, archive_date"))
def wikitext_extract(spark, d):
    text = "Lead.\n== History ==\nX <ref name=\"hist\">{{cite web |url=http://a.com/x |archive-url=http://w/1}}</ref> {{dead link}}\n=== Details ===\n[http://b.com/y Deep Link]"
    rows = spark.createDataFrame([(text, "http://a.com/x"), (text, "http://www.b.com/y/"), (text, "http://none")], "text string, url string")
    return rows.select("url", wikitext.link_context("text", "url").alias("c")).select("url", "c.*")


from citeflow.plans import checks, reports  # noqa: E402, F401  (they register their queries)

__all__ = ["oracle_sql", "queries"]
