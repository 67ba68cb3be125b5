"""What reports and summaries show, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow import policy


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole != 0, F.format_string("%.2f%%", 100.0 * part / whole)), F.lit(""))


def duration(seconds: Column) -> Column:
    """As 59s, 2m 5s, 3h 7m or 4d 1h."""
    s = seconds.cast("bigint")
    two = lambda a, x, b, y: F.format_string(f"%d{x} %d{y}", F.floor(s / a).cast("bigint"), F.floor(s % a / b).cast("bigint"))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, two(60, "m", 1, "s")).when(s < 86_400, two(3600, "h", 60, "m")).otherwise(two(86_400, "d", 3600, "h"))


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by key, the most common first."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def funnel(pages: DataFrame, links: DataFrame, urls: DataFrame, sites: DataFrame, states: list[str], min_pages: int) -> DataFrame:
    """(stage_no, stage, n, share): one row a stage. pages: (page_id); urls: (last_checked); sites: (state, wiki_page_count, registrable_domain, last_checked)."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    wanted = F.col("state").isin(*states) & (F.col("wiki_page_count") >= min_pages) & (F.col("registrable_domain") != "")
    one = reduce(
        DataFrame.crossJoin,  # of one-row aggregates
        (
            pages.agg(F.count_distinct("page_id").alias("pages")), n(links, "links"), urls.agg(F.count(F.lit(1)).alias("urls"), F.count("last_checked").alias("crawled")),
            sites.agg(F.count(F.lit(1)).alias("domains"), F.count("last_checked").alias("checked"), F.count_if(wanted).alias("candidates")),
        ),
    )
    steps = [("pages", None), ("links", None), ("urls", "links"), ("domains", "urls"), ("crawled", "urls"), ("checked", "domains"), ("candidates", "domains")]
    told = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(name).alias("n"), (percent(F.col(name), F.col(of)) if of else F.lit("")).alias("share")) for i, (name, of) in enumerate(steps)]
    return one.select(F.inline(F.array(*told)))


def due_by_state(rows: DataFrame, next_at: Column, terminal: Column, now: Column) -> DataFrame:
    return tally(rows.where(~terminal & (next_at.isNull() | (next_at <= now))), "state")


def diff_summary(diff: DataFrame, urls: DataFrame) -> DataFrame:
    """(transition, n, domains) of a run diff's links; domains: distinct sites that they touch."""
    return diff.join(urls.select("url_hash", "domain_id"), "url_hash", "left").groupBy("transition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain_id").alias("domains"))


def top_removed(diff: DataFrame, urls: DataFrame, sites: DataFrame, limit: int = 10) -> DataFrame:
    """(registrable_domain, n): the sites of which most links were removed."""
    gone = diff.where("transition = 'removed'").join(urls.select("url_hash", "domain_id"), "url_hash").groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    return gone.join(sites.select("domain_id", "registrable_domain"), "domain_id").groupBy("registrable_domain").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "registrable_domain").limit(limit)


def removal_counts(diff: DataFrame, urls: DataFrame) -> DataFrame:
    """(domain_id, removed): distinct (link, page, language) that some pair of runs shows as removed."""
    gone = diff.where("transition = 'removed'").select("url_hash", "page_id", "lang").distinct()
    return gone.join(urls.select("url_hash", "domain_id"), "url_hash").groupBy("domain_id").agg(F.count(F.lit(1)).alias("removed"))


def reach(links: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: the citations of a set of links, and the distinct pages that hold them."""
    return links.join(urls.select("url_hash").distinct(), "url_hash", "left_semi").agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("page_id").alias("articles"))


def namespace_report(titles: DataFrame, title: str, sample: int | None = None) -> DataFrame:
    """(namespace, n, example, share): titles with a known prefix, by it, an example being the first in order; share is of all titles."""
    rows = titles if sample is None else titles.limit(sample)
    name = F.regexp_extract(F.col(title), "^(" + "|".join(policy.NAMESPACES) + "):", 1)
    counted = rows.groupBy(name.alias("namespace")).agg(F.count(F.lit(1)).alias("n"), F.min(title).alias("example"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.where("namespace <> ''").crossJoin(F.broadcast(total)).select("namespace", "n", "example", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def verify_outcome(dumped: Column, live: Column, truncated: Column, ok: Column) -> Column:
    """What the live site's count of citing pages says about the dump's."""
    n = F.coalesce(live, F.lit(0))
    return F.when(~ok, "failed").when(truncated, "truncated").when((n == 0) & (dumped > 0), "vanished").when(n < dumped, "reduced").when(n > dumped, "beyond_slice").otherwise("unchanged")


def verify_summary(told: DataFrame) -> DataFrame:
    """(outcome, n, citations_lost) of (dumped, live, truncated, ok)."""
    o = told.withColumn("outcome", verify_outcome(*(F.col(c) for c in ("dumped", "live", "truncated", "ok"))))
    lost = F.when(F.col("outcome").isin("vanished", "reduced"), F.col("dumped") - F.coalesce("live", F.lit(0))).otherwise(0)
    return o.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(lost).cast("bigint").alias("citations_lost"))


def export_candidates(sites: DataFrame, states: list[str], min_pages: int) -> DataFrame:
    return sites.where(F.col("state").isin(*states) & (F.col("wiki_page_count") >= min_pages) & (F.col("registrable_domain") != ""))


def latest_per(rows: DataFrame, parent: str, order: str, log: DataFrame) -> DataFrame:
    """rows, each with its latest row of log, if any: a left join on an aggregate."""
    rest = [c for c in log.columns if c != parent]
    last = log.groupBy(parent).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return rows.join(last, parent, "left").select(*rows.columns, *(F.col(f"_last.{c}").alias(c) for c in rest))
