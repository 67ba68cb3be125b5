"""Queues: what is due, in which order, and how work is grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow import policy
from citeflow.operators.graph import due, priority


def _least(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def due_urls(urls: DataFrame, sites: DataFrame, now: Column, limit: int | None = None, force: bool = False, weights: dict[str, int] = policy.DEATH_POINTS) -> DataFrame:
    """(url_hash, url, site): links to be checked, those never seen first, then by the weight of their state, the longest unseen first.
    urls: (url_hash, url, domain_id, state, terminal, next_check_at, last_checked); sites: (domain_id, registrable_domain).
    """
    rows = due(urls, F.col("next_check_at"), F.col("terminal"), now, force).join(sites.select("domain_id", "registrable_domain"), "domain_id", "left")
    order = [F.col("last_checked").isNotNull(), priority(F.col("state"), weights).desc(), F.col("last_checked").asc_nulls_first(), F.col("url_hash")]
    return _least(rows, order, limit).select("url_hash", "url", F.coalesce("registrable_domain", F.lit("")).alias("site"))


def due_domains(sites: DataFrame, urls: DataFrame, now: Column, states: list[str] | None = None, limit: int | None = None, force: bool = False) -> DataFrame:
    """(domain_id, registrable_domain): sites to be checked. Without states, those never checked and those with a link in an interesting state.
    sites: (domain_id, registrable_domain, state, terminal, next_check_at, last_checked, wiki_page_count); urls: (domain_id, state).
    """
    rows = sites.where((F.col("registrable_domain") != "") & ~F.col("terminal"))
    if states:
        rows = rows.where(F.col("state").isin(*states))
    else:
        seen = urls.where(F.col("state").isin(*policy.INTERESTING)).select("domain_id").distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(seen, "domain_id", "left").where(F.col("last_checked").isNull() | F.col("_seen")).drop("_seen")
    if not force:
        rows = rows.where(F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))
    order = [F.col("last_checked").isNotNull(), priority(F.col("state"), policy.STATE_POINTS).desc(), F.desc("wiki_page_count"), F.col("domain_id")]
    return _least(rows, order, limit).select("domain_id", "registrable_domain")


def enrichable(links: DataFrame, urls: DataFrame, sites: DataFrame, pages: DataFrame, states: list[str], site_states: list[str], run: str | None = None) -> DataFrame:
    """Pending links whose own state or whose site's is wanted and whose page has an offset; count() is what is pending.
    links: (id, page_id, dump_run, url_hash, enrich_status); urls: (url_hash, domain_id, state); sites: (domain_id, state); pages: (page_id, dump_run, ms_offset, title).
    """
    rows = links.where("enrich_status = 'pending'") if run is None else links.where((F.col("enrich_status") == "pending") & (F.col("dump_run") == run))
    seen = rows.join(urls.select("url_hash", "domain_id", F.col("state").alias("url_state")), "url_hash").join(sites.select("domain_id", F.col("state").alias("site_state")), "domain_id", "left")
    wanted = seen.where(F.col("url_state").isin(*states) | F.coalesce(F.col("site_state").isin(*site_states), F.lit(False)))
    return wanted.join(pages.where("ms_offset is not null").select("page_id", "dump_run", "ms_offset", "title"), ["page_id", "dump_run"])


def enrich_order(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """By offset, so that pages of one compressed block are read together."""
    return _least(candidates, [F.col("ms_offset"), F.col("page_id"), F.col("id")], limit)


def by_block(candidates: DataFrame) -> DataFrame:
    """(ms_offset, members): the (page_id, id) of each block, in order; a block holds some hundred pages."""
    return candidates.groupBy("ms_offset").agg(F.array_sort(F.collect_list(F.struct("page_id", "id"))).alias("members"))


def by_site(tasks: DataFrame, site: str, url: str) -> DataFrame:
    """tasks with those of one site (of one link, where there is no site) in one partition and together."""
    unit = F.coalesce(F.nullif(F.col(site), F.lit("")), F.col(url))
    return tasks.withColumn("unit", unit).repartition("unit").sortWithinPartitions("unit")


def in_slice(links: DataFrame, index: DataFrame, page: str = "page_id") -> DataFrame:
    """Links of the pages that an index slice holds."""
    return links.join(index.select(page), page, "left_semi")


def unexpired(cache: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return cache.where(F.try_to_timestamp(F.col(expires)) > now)


def stage_view(progress: DataFrame, now: Column) -> DataFrame:
    """progress (stage, done, total, started_at, updated_at, finished_at, outcome; times in seconds) with percent, rate, eta and status."""
    span = F.greatest(F.lit(0.0), F.col("updated_at").cast("double") - F.col("started_at"))
    rate = F.when((span > 0) & (F.col("done") > 0), F.col("done") / span)
    total = F.nullif(F.col("total"), F.lit(0))
    running = F.col("finished_at").isNull()
    stalled = running & (now - F.col("updated_at") > policy.STALL_SECONDS)
    return progress.withColumns(
        {"percent": F.least(F.lit(100.0), 100.0 * F.col("done") / total), "rate": rate, "eta": F.when(total.isNotNull(), F.greatest(F.lit(0), total - F.col("done")) / rate),
         "status": F.when(stalled, "stalled").when(running, "running").otherwise(F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.lit("done")))}
    )
