"""Everything that the tables hold about one link or one site, and the data of report pages: several DataFrames each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.functions import urls
from citeflow.operators import reports


def resolve(tables: dict[str, DataFrame], target: str) -> tuple[str, str]:
    """(url, hash), (domain, name) or (unknown, target). What has a slash is looked for as a link first, then as its site."""
    spark = tables["urls"].sparkSession
    one = spark.createDataFrame([(target if "://" in target else f"http://{target}",)], "t string").transform(urls.canonical, "t", "u")
    host = urls.normalize_host(urls.host_of(urls.part(F.col("u"), 2)))
    told = one.select(urls.url_hash(F.col("u")).alias("hash"), urls.suffix_analysis(host)["registrable"].alias("site")).first()
    if "/" in target:
        if tables["urls"].where(F.col("url_hash") == told["hash"]).limit(1).count():
            return "url", told["hash"]
        return ("domain", told["site"]) if told["site"] else ("unknown", target)
    name = told["site"] or target
    return ("domain", name) if tables["domains"].where(F.col("registrable_domain") == name).limit(1).count() else ("unknown", target)


def gather(tables: dict[str, DataFrame], target: str, checks: int = 40, domain_checks: int = 20, citations: int = 40) -> dict[str, DataFrame]:
    """The rows of domain, urls, checks (with every version's verdict), domain_checks and citations that belong to the target, the latest first.
    Filters on one key reach the scans; a target that is unknown gives an empty dict.
    """
    kind, name = resolve(tables, target)
    if kind == "unknown":
        return {}
    if kind == "domain":
        domain = tables["domains"].where(F.col("registrable_domain") == name)
        links = tables["urls"].join(domain.select("domain_id"), "domain_id", "left_semi")
    else:
        links = tables["urls"].where(F.col("url_hash") == name)
        domain = tables["domains"].join(links.select("domain_id"), "domain_id", "left_semi")
    mine = links.select("url_hash")
    seen = tables["url_checks"].join(mine, "url_hash", "left_semi").join(tables["url_classifications"].drop("url_hash"), "check_id", "left")
    found = {"domain": domain, "urls": links.orderBy("url"), "checks": seen.orderBy(F.desc("checked_at"), F.desc("check_id")).limit(checks)}
    if kind == "domain":
        own = tables["domain_checks"].join(domain.select("domain_id"), "domain_id", "left_semi").join(tables["domain_classifications"].drop("domain_id"), "check_id", "left")
        found["domain_checks"] = own.orderBy(F.desc("checked_at"), F.desc("check_id")).limit(domain_checks)
    cites = tables["links"].join(mine, "url_hash", "left_semi").join(tables["pages"], ["page_id", "dump_run"])
    found["citations"] = cites.orderBy(F.desc(F.col("enrich_status") == "done"), "title", "id").limit(citations)
    return found


def report(pages: DataFrame, links: DataFrame, urls_: DataFrame, sites: DataFrame, states: list[str], min_pages: int, limit: int = 3000) -> dict[str, DataFrame]:
    """A report's funnel, states, candidates (the best `limit`) and, in one row, whether there are more."""
    wanted = reports.export_candidates(sites, states, min_pages)
    return {
        "funnel": reports.funnel(pages, links, urls_, sites, states, min_pages), "states": reports.tally(sites, "state"),
        "rows": wanted.orderBy(F.desc("candidate_score"), F.desc("wiki_page_count"), "registrable_domain").limit(limit), "truncated": wanted.agg((F.count(F.lit(1)) > limit).alias("truncated")),
    }


def gap_page(gaps: DataFrame, links: DataFrame, verdict: Column) -> dict[str, DataFrame]:
    """The data of a page on archive gaps: links by verdict, and the citations and pages that each verdict's links have."""
    told = gaps.withColumn("verdict", verdict)
    reach = links.join(told.select("url_hash", "verdict"), "url_hash").groupBy("verdict").agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("page_id").alias("articles"))
    return {"verdicts": reports.tally(told, "verdict"), "reach": reach}


class Refresher:
    """For foreachBatch: calls `make` on a micro-batch, but no more often than every `seconds`; the last one always counts when force is given."""

    def __init__(self, make: Callable[[DataFrame], None], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock, self.last = make, seconds, clock, None

    def __call__(self, batch: DataFrame, number: int, force: bool = False) -> bool:
        now = self.clock()
        if not force and self.last is not None and now - self.last < self.seconds:
            return False
        self.make(batch)
        self.last = now
        return True
