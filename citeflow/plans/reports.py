"""Queries of reports, run differences and page records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeflow.functions import pages
from citeflow.operators import export, reports
from citeflow.plans.checks import _LINKS, _SITES, _URLS, _WITH, _links, _made, _sites, _urls, _wiki
from citeflow.plans.registry import register, table, values
from citeflow.sources import dumps

_PCT = "coalesce(CASE WHEN {1} <> 0 THEN printf('%.2f%%', 100.0 * {0} / {1}) END, '')"
_N = "n AS (SELECT (SELECT count(DISTINCT page_id) FROM wiki) AS pages, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM urls) AS urls, (SELECT count(*) FROM sites) AS domains, (SELECT count(*) FROM urls WHERE last_checked IS NOT NULL) AS crawled, (SELECT count(*) FROM sites WHERE last_checked IS NOT NULL) AS checked, (SELECT count(*) FROM sites WHERE state IN ('parked', 'expiring') AND wiki_page_count >= 5 AND registrable_domain <> '') AS candidates)"
_STEPS = [("pages", None), ("links", None), ("urls", "links"), ("domains", "urls"), ("crawled", "urls"), ("checked", "domains"), ("candidates", "domains")]


@register(f"{_WITH}, {_N} " + " UNION ALL ".join(f"SELECT {i} AS stage_no, '{n}' AS stage, {n}::BIGINT AS n, {_PCT.format(n, of) if of else chr(39) * 2} AS share FROM n" for i, (n, of) in enumerate(_STEPS)))
def funnel(spark, d):
    return reports.funnel(_wiki(spark, d), _links(spark, d), _urls(spark, d), _sites(spark, d), ["parked", "expiring"], 5)


@register(f"{_WITH} SELECT state, count(*)::BIGINT AS n FROM urls WHERE NOT terminal AND (next_check_at IS NULL OR next_check_at <= 300) GROUP BY 1")
def due_by_state(spark, d):
    return reports.due_by_state(_urls(spark, d), F.col("next_check_at"), F.col("terminal"), F.lit(300))


_DIFF = "l_partkey AS url_hash, l_orderkey AS page_id, 'en' AS lang, CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'added' END AS transition"
_DIFFS = f"{_WITH}, diffs AS (SELECT {_DIFF} FROM lineitem WHERE l_discount > 0.05)"


def _diffs(spark, d):
    return _made(spark, d, "lineitem", f"{_DIFF}, l_discount").where("l_discount > 0.05").drop("l_discount")


@register(f"{_DIFFS} SELECT transition, count(*)::BIGINT AS n, count(DISTINCT domain_id)::BIGINT AS domains FROM diffs LEFT JOIN urls ON urls.url_hash = diffs.url_hash GROUP BY 1")
def diff_summary(spark, d):
    return reports.diff_summary(_diffs(spark, d), _urls(spark, d))


@register(f"{_DIFFS} SELECT registrable_domain, count(*)::BIGINT AS n FROM diffs JOIN urls ON urls.url_hash = diffs.url_hash JOIN sites ON sites.domain_id = urls.domain_id WHERE transition = 'removed' GROUP BY 1 ORDER BY n DESC, registrable_domain LIMIT 10")
def top_removed(spark, d):
    return reports.top_removed(_diffs(spark, d), _urls(spark, d), _sites(spark, d))


@register(f"{_DIFFS} SELECT domain_id, count(*)::BIGINT AS removed FROM (SELECT DISTINCT diffs.url_hash, page_id, lang, domain_id FROM diffs JOIN urls ON urls.url_hash = diffs.url_hash WHERE transition = 'removed') GROUP BY 1")
def removal_counts(spark, d):
    return reports.removal_counts(_diffs(spark, d), _urls(spark, d))


@register(f"{_WITH} SELECT count(*)::BIGINT AS citations, count(DISTINCT page_id)::BIGINT AS articles FROM links WHERE url_hash IN (SELECT url_hash FROM urls WHERE state = 'dns_failure')")
def gap_reach(spark, d):
    return reports.reach(_links(spark, d), _urls(spark, d).where("state = 'dns_failure'"))


_TITLES = "CASE l_linenumber WHEN 1 THEN 'Category:' WHEN 2 THEN 'Star Trek:' WHEN 3 THEN 'User talk:' ELSE '' END || l_orderkey"


@register(f"WITH t AS (SELECT {_TITLES} AS title FROM lineitem), c AS (SELECT regexp_extract(title, '^(Category|User talk):', 1) AS namespace, count(*) AS n, min(title) AS example FROM t GROUP BY 1) SELECT namespace, n::BIGINT AS n, example, round(n::DOUBLE / (SELECT count(*) FROM t), 6) AS share FROM c WHERE namespace <> ''")
def namespace_report(spark, d):
    return reports.namespace_report(_made(spark, d, "lineitem", f"{_TITLES} AS title"), "title")


_TOLD = "o_custkey % 50 AS dumped, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 60 END AS live, o_orderkey % 11 = 0 AS truncated, o_orderkey % 17 > 0 AS ok"


@register(f"WITH t AS (SELECT *, coalesce(live, 0) AS x FROM (SELECT {_TOLD} FROM orders)), o AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN truncated THEN 'truncated' WHEN x = 0 AND dumped > 0 THEN 'vanished' WHEN x < dumped THEN 'reduced' WHEN x > dumped THEN 'beyond_slice' ELSE 'unchanged' END AS outcome FROM t) SELECT outcome, count(*)::BIGINT AS n, sum(CASE WHEN outcome IN ('vanished', 'reduced') THEN dumped - x ELSE 0 END)::BIGINT AS citations_lost FROM o GROUP BY 1")
def verify_outcomes(spark, d):
    return reports.verify_summary(_made(spark, d, "orders", _TOLD))


@register(f"{_WITH} SELECT domain_id, registrable_domain, state FROM sites WHERE state IN ('parked', 'expiring') AND wiki_page_count >= 5 AND registrable_domain <> ''")
def export_filter(spark, d):
    return reports.export_candidates(_sites(spark, d), ["parked", "expiring"], 5).select("domain_id", "registrable_domain", "state")


@register("SELECT c_custkey AS custkey, o_orderkey AS last_order, o_orderstatus AS status FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_answer(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    return reports.latest_per(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), "custkey", "last_order", o)


@register("SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def run_counters(spark, d):
    return reports.tally(table(spark, d, "events"), "user_id", "event_type")


@register("WITH s AS (SELECT supplier.*, count(l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL) SELECT '\"' || replace(s_name, '#', '\"\"') || ', x\",' || s_nationkey || ',' || n || concat_ws('', list_transform(range(18), lambda i: ',')) AS value FROM s")
def candidate_csv(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "supplier").join(li, "s_suppkey", "left")
    rows = s.select(F.concat(F.replace("s_name", F.lit("#"), F.lit('"')), F.lit(", x")).alias("domain"), F.col("s_nationkey").alias("state"), F.coalesce("n", F.lit(0)).alias("score"))
    return export.csv_lines(export.laid_out(rows))


@register("""SELECT '{"candidate_score":' || c_nationkey || ',"domain":"' || c_name || '","score_explanation":[{"name":"pages","points":' || c_nationkey || '}],"state":null}' AS value FROM customer""")
def candidate_jsonl(spark, d):
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(F.col("c_name").alias("domain"), n.alias("candidate_score"), F.to_json(F.array(F.struct(F.lit("pages").alias("name"), n.alias("points")))).alias("score_explanation"), F.lit(None).cast("string").alias("state"))
    return export.json_lines(rows)


_PART = """<h1>Genuine Toyota 123-45</h1><span class="price">$9</span><p class="price-section-price">$ 12.50</p><div class="price-section-retail">List <span>$20.00</span></div><div class="price-section-save">You Save: $7.50 (37%)</div>
<table class="x pn-spec-list"><tr><td>Part Number</td><td>A-1</td></tr><tr><td>Item Size</td><td>10 cm</td></tr><tr><td>Part Number (old)</td><td>A-2</td></tr><tr><td>Brand Description</td><td>OEM</td></tr><tr><td>lone</td></tr></table>"""


@register(values([("Genuine Toyota 123-45", "12.50", "20.00", "7.50", "37", "A-2", "10 cm", None, "OEM", None, 4), ("", None, None, None, None, None, None, None, None, None, 0)], "name, price, msrp, saved, saved_percent, part_number, dimensions, weight, brand, description, n"))
def part_details(spark, d):
    x = spark.createDataFrame([(_PART,), ("<p>",)], "html string").select(pages.part_details(F.col("html")).alias("x"))
    return x.select(*(f"x.{c}" for c in "name price msrp saved saved_percent part_number dimensions weight brand description".split()), F.size("x.specifications").alias("n"))


_LIST = '<div class="pl-pat-im-sub"><a class="pl-pat-im-link" href="/n1">N-1</a> <a class="pl-pat-im-link" href="/p1"><b>Oil</b>  filter</a></div><div class="pl-pat-im-sub"><a class="pl-pat-im-link" href="/n2">N-2</a></div>'


@register(values([(0, "N-1", "Oil filter", "/p1")], "pos, number, name, url"))
def part_list(spark, d):
    return spark.createDataFrame([(_LIST,)], "html string").select(F.posexplode(pages.part_list(F.col("html"))).alias("pos", "x")).select("pos", "x.number", "x.name", "x.url")


_CATEGORIES = '<ul class="category-part-list"><li><a href="/brakes">Brakes</a></li><li><a>none</a></li><li><a class="y" href="engine"> Engine </a></li></ul>'


@register(values([("Brakes", "https://x.com/brakes"), ("Engine", "https://x.com/engine")], "name, url"))
def category_list(spark, d):
    return spark.createDataFrame([(_CATEGORIES,)], "html string").select(F.inline(pages.category_list(F.col("html"), F.lit("https://x.com/"))))


_NEWS = '<div class="newsdetail newstitleblock rh_gr_right_sec"><h2><a href=" /deal/1 ">Half price</a></h2><a href="/other">x</a></div><div class="newsdetail newstitleblock">no link</div>'


@register(values([("Half price", "/deal/1")], "name, url"))
def deals(spark, d):
    return spark.createDataFrame([(_NEWS,)], "html string").select(F.inline(pages.deals(F.col("html"))))


_CARD = '<div class="qBF1Pd fontHeadlineSmall">Blue Cafe</div><span class="ZkP5Je" aria-label="4.2 stars 556 Reviews"></span><div class="W4Efsd"><span>Coffee shop</span><span>12 Main St</span></div>'


@register(values([("Blue Cafe", "4.2", "556", "Coffee shop", "12 Main St", "https://www.google.com/maps/search/Blue+Cafe"), *[("UNKNOWN",) * 6]], "name, rating, reviews, type, address, maps_url"))
def map_cards(spark, d):
    x = spark.createDataFrame([(_CARD,), ("<p>",)], "html string").select(pages.map_card(F.col("html")).alias("x"))
    return x.select("x.name", "x.rating", "x.reviews", "x.type", "x.address", "x.maps_url")


@register("SELECT p_brand AS brand, min(p_name) AS name, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS compatibility, count(*) FILTER (p_size < 10)::BIGINT AS small, count(*) FILTER (p_size >= 10)::BIGINT AS large FROM part GROUP BY 1")
def record_table(spark, d):
    kinds = table(spark, d, "part").groupBy("p_brand", F.when(F.col("p_size") < 10, "small").otherwise("large").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("name"), F.collect_set("p_type").alias("types"))
    rows = kinds.groupBy(F.col("p_brand").alias("brand")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("specifications"), F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("compatibility"))
    return export.record_table(rows).fillna(0)


_FIELDS = [("Tel. 555-0100 ", "12 Main St", "https://a.com", "1,234 reviews", "$ 9.50", "mailto:x@a.com?subject=hi"), ("12", "short", "/local", "none", "$", "tel:1"), (None,) * 6]
_CLEAN = [("555-0100", "12 Main St", "https://a.com", "1234", "9.50", "x@a.com"), (None,) * 6, (None,) * 6]


@register(values([(i, *r) for i, r in enumerate(_CLEAN)], "case_no, phone, address, website, reviews, price, mail"))
def listing_fields(spark, d):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_FIELDS)], "case_no int, phone string, address string, website string, reviews string, price string, mail string")
    return rows.select("case_no", *(getattr(pages, c)(F.col(c)).alias(c) for c in ("phone", "address", "website", "reviews", "price", "mail")))


_LINE = "CASE WHEN l_linenumber = 2 THEN '== H' || l_partkey || ' ==' WHEN l_linenumber = 5 THEN '=== K ===' ELSE 'text' END"


@register(f"""WITH l AS (SELECT l_orderkey AS article, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS number, {_LINE} AS line FROM lineitem), h AS (SELECT *, nullif(regexp_extract(line, '^={{2,}} (.*) ={{2,}}$', 1), '') AS h FROM l)
SELECT article, number::BIGINT AS number, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY article ORDER BY number), '(lead)') AS section FROM h""")
def nearest_heading(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint").alias("number"), F.expr(_LINE).alias("line"))
    return pages.nearest_heading(li, "article", "number", "line").select("article", "number", "section")


_ANSWERS = [
    ("a.com", 0, 200, '{"query":{"exturlusage":[{"title":"A"},{"title":"B"}]},"continue":{"eucontinue":"1"}}'), ("a.com", 1, 200, '{"query":{"exturlusage":[{"title":"B"},{"title":"C"}]}}'), ("b.com", 0, 200, '{"error":{"code":"maxlag"}}'), ("c.com", 0, 429, "busy"), ("d.com", 0, 200, "not json"), ("e.com", 0, 200, '{"query":{"exturlusage":[]}}'),
    *[("f.com", i, 200, '{"query":{"exturlusage":[{"title":"T%d"}]},"continue":{"eucontinue":"x"}}' % i) for i in range(4)],
]


@register(values([("a.com", 3, False, None), ("b.com", None, False, "api:maxlag"), ("c.com", None, False, "http:429"), ("d.com", None, False, "malformed_json"), ("e.com", 0, False, None), ("f.com", 4, True, None)], "domain, live_page_count, truncated, error_kind").replace("SELECT *", "SELECT domain, live_page_count::BIGINT AS live_page_count, truncated, error_kind"))
def live_usage(spark, d):
    return dumps.live_usage(spark.createDataFrame(_ANSWERS, "domain string, page_no int, http_status int, payload string"))


_RDAP_ROWS = [
    ('{"entities":[{"roles":["abuse"],"handle":"X"},{"roles":["registrar"],"handle":"H1","vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Nice Registrar"]]]}],"events":[{"eventAction":"expiration","eventDate":"2027-01-01"}],"status":["active"]}', "Nice Registrar", "2027-01-01"),
    ('{"entities":[{"roles":["registrar"],"handle":"H2"}]}', "H2", None), ("{}", None, None),
]


@register(values([(i, *r[1:]) for i, r in enumerate(_RDAP_ROWS)], "case_no, registrar, expiry"))
def registry_answers(spark, d):
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(_RDAP_ROWS)], "case_no int, payload string").select("case_no", dumps.rdap(F.col("payload")).alias("x")).select("case_no", "x.registrar", "x.expiry")


@register("SELECT page_id, url_hash, coalesce(quality = 1, false) AS cached FROM (SELECT l_orderkey AS page_id, l_partkey AS url_hash FROM lineitem) LEFT JOIN labels ON doc_id = page_id")
def page_cache_lookup(spark, d):
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("cached"))
    return _links(spark, d).select("page_id", "url_hash").join(cache, "page_id", "left").select("page_id", "url_hash", F.coalesce("cached", F.lit(False)).alias("cached"))


del _LINKS, _SITES, _URLS
