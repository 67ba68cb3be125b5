"""Relational operators over the page - URL - site graph: counts, differences of runs, gaps, scores, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow import policy


def link_counts(links: DataFrame, key: str, page: str) -> DataFrame:
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("cite_count"), F.count_distinct(page).alias("distinct_page_count"))


def parent_counts(parents: DataFrame, urls: DataFrame, links: DataFrame, parent: str, url: str, page: str) -> DataFrame:
    """(parent, url_count, wiki_link_count, wiki_page_count), 0 for parents without rows; URLs and links do not fan out."""
    a = urls.groupBy(parent).agg(F.count(F.lit(1)).alias("url_count"))
    b = links.join(urls.select(url, parent), url).groupBy(parent).agg(F.count(F.lit(1)).alias("wiki_link_count"), F.count_distinct(page).alias("wiki_page_count"))
    return parents.select(parent).join(a, parent, "left").join(b, parent, "left").fillna(0)


def due(rows: DataFrame, next_at: Column, terminal: Column, now: Column, force: bool = False) -> DataFrame:
    return rows if force else rows.where(~terminal & (next_at.isNull() | (next_at <= now)))


def priority(state: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), state), F.lit(0))


def schedule_buckets(rows: DataFrame, next_at: Column, terminal: Column, now: Column, soon_days: int = 7) -> DataFrame:
    """One row of disjoint counts: terminal, never, due, soon, later."""
    soon = now + F.make_interval(days=F.lit(soon_days))
    live = ~terminal
    return rows.agg(
        F.count_if(terminal).alias("terminal"), F.count_if(live & next_at.isNull()).alias("never"), F.count_if(live & (next_at <= now)).alias("due"),
        F.count_if(live & (next_at > now) & (next_at <= soon)).alias("soon"), F.count_if(live & (next_at > soon)).alias("later"),
    )


def run_diff(links: DataFrame, old: Column, new: Column, run: str, page: list[str], url: str) -> DataFrame:
    """Links of pages that both runs hold and that only one of the runs has: (page.., url, transition)."""
    pages = lambda r: links.where(F.col(run) == r).select(*page).distinct()
    both = pages(old).intersect(pages(new))

    def one(a: Column, b: Column, name: str) -> DataFrame:
        mine = links.where(F.col(run) == a).select(*page, url).distinct()
        other = links.where(F.col(run) == b).select(*page, url)
        return mine.join(both, page, "left_semi").join(other, [*page, url], "left_anti").withColumn("transition", F.lit(name))

    return one(old, new, "removed").unionByName(one(new, old, "added"))


def run_overlap(links: DataFrame, old: Column, new: Column, run: str, page: list[str]) -> DataFrame:
    pages = lambda r: links.where(F.col(run) == r).select(*page).distinct()
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    parts = (count(pages(old).intersect(pages(new)), "both"), count(pages(old).subtract(pages(new)), "only_old"), count(pages(new).subtract(pages(old)), "only_new"))
    return reduce(DataFrame.crossJoin, parts)


def gap_targets(links: DataFrame, dead: DataFrame, answered: DataFrame, url: str, archived: Column, run: str) -> DataFrame:
    """(url, first_run, citations) of dead URLs of which no citation is archived and that no archive has answered for."""
    covered = links.where(archived).select(url)
    return links.join(dead, url, "left_semi").join(covered, url, "left_anti").join(answered, url, "left_anti").groupBy(url).agg(F.min(run).alias("first_run"), F.count(F.lit(1)).alias("citations"))


def first_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def score(sites: DataFrame, points: dict[str, int] = policy.STATE_POINTS) -> DataFrame:
    """sites (state, wiki_page_count, url_states array, kinds array, dead_tags, removed, is_private) with candidate_score and
    score_explanation, the JSON of the components that are not 0.
    """

    def first_of(states: Column, table: dict[str, int]) -> tuple[Column, Column]:
        hits = F.filter(F.array(*map(F.lit, table)), lambda s: F.array_contains(states, s))
        name = F.get(hits, 0)
        return name, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name), F.lit(0))

    death, death_points = first_of(F.col("url_states"), policy.DEATH_POINTS)
    kind, kind_points = first_of(F.col("kinds"), policy.KIND_POINTS)
    parts = [
        (F.concat(F.lit("state:"), F.col("state")), priority(F.col("state"), points)),
        (F.lit("pages"), F.least(F.col("wiki_page_count") * policy.PAGE_POINTS, F.lit(policy.PAGE_CAP))),
        (F.concat(F.lit("url:"), death), death_points),
        (F.concat(F.lit("kind:"), kind), kind_points),
        (F.lit("dead_tag"), F.when(F.col("dead_tags") > 0, policy.DEAD_TAG_POINTS).otherwise(0)),
        (F.lit("removed"), F.when(F.col("removed") > 0, policy.REMOVAL_POINTS).otherwise(0)),
        (F.lit("private_suffix"), F.when(F.col("is_private"), policy.PRIVATE_SUFFIX_POINTS).otherwise(0)),
    ]
    told = F.filter(F.array(*(F.struct(n.alias("name"), p.cast("int").alias("points")) for n, p in parts)), lambda c: c["points"] != 0)
    return sites.withColumn("candidate_score", reduce(Column.__add__, (p.cast("bigint") for _, p in parts))).withColumn("score_explanation", F.to_json(told))


def removed_links(dropped: Column, lost_live: Column) -> Column:
    """The greater of what the dumps and the live site say went, not their sum."""
    return F.greatest(F.coalesce(dropped, F.lit(0)), F.coalesce(lost_live, F.lit(0)))
