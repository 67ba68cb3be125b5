"""Folds of append-only logs to current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow import policy
from citeflow.sources import dumps


def latest(log: DataFrame, key: list[str], order: str, where: Column | None = None) -> DataFrame:
    """The row of each key with the greatest order, as one aggregate without a sort."""
    rows = log if where is None else log.where(where)
    rest = [c for c in log.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def _ends(log: DataFrame, key: str, order: str, state: str, carried: list[str], failed: Column | None = None) -> DataFrame:
    """(key, latest, other, good, carried.., order): log's rows, each with its key's latest state, the last order of another state and the last that
    did not fail. Made of aggregates, so that a key with very many rows is folded before it moves.
    """
    last = log.groupBy(key, F.col(state).alias("s")).agg(F.max(order).alias("o"))
    good = F.max(F.when(~failed, F.col("o")) if failed is not None else F.lit(None).cast(log.schema[order].dataType))
    ends = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "s"))).alias("x"), good.alias("good"))  # as many as there are states
    return log.select(key, F.col(order).alias("o"), *carried).join(ends.select(key, "good", F.element_at("x", -1)["s"].alias("latest"), F.try_element_at("x", F.lit(-2))["o"].alias("other")), key)


def streak(log: DataFrame, key: str, order: str, state: str, look_back: int = policy.LOOK_BACK) -> DataFrame:
    """(key, state, streak): how many of the last look_back rows, from the latest on, hold the latest state."""
    since = _ends(log, key, order, state, []).where(F.col("other").isNull() | (F.col("o") > F.col("other")))
    return since.groupBy(key, F.col("latest").alias(state)).agg(F.least(F.count(F.lit(1)), F.lit(look_back)).cast("bigint").alias("streak"))


def url_states(log: DataFrame, key: str, order: str, state: str, at: str) -> DataFrame:
    """(key, state, streak, terminal, next_check_at, consecutive_failures) after all verdicts of a log, `at` being when each was made (seconds).
    A link is next checked at the cadence of its state, longer with each repeat; the failures that end the log are counted.
    """
    ends = _ends(log, key, order, state, [at], F.col("s").isin(*policy.FAILURES))
    repeats, failures_ = F.count_if(F.col("other").isNull() | (F.col("o") > F.col("other"))), F.count_if(F.col("good").isNull() | (F.col("o") > F.col("good")))
    folded = ends.groupBy(key, F.col("latest").alias("state")).agg(F.least(repeats, F.lit(policy.LOOK_BACK)).alias("streak"), failures_.alias("consecutive_failures"), F.max_by(at, "o").alias("at"))
    next_at = F.col("at") + recheck_seconds(F.col("state"), F.col("streak") - 1)
    return folded.select(key, "state", "streak", is_terminal(F.col("state"), F.col("streak")).alias("terminal"), next_at.alias("next_check_at"), "consecutive_failures")


def domain_recheck_days(state: Column, expiry: Column, now: Column) -> Column:
    """Days to the next check of a site: by its state, and soon where an active registration is about to end."""
    days = F.create_map(*(F.lit(x) for kv in policy.DOMAIN_DAYS.items() for x in kv))
    usual = F.coalesce(F.try_element_at(days, state), F.lit(policy.DOMAIN_DEFAULT_DAYS))
    ending = (state == "active") & dumps.expires_within(expiry, policy.EXPIRY_WATCH_DAYS, now)
    return F.when(ending, F.least(usual, F.lit(policy.EXPIRY_RECHECK_DAYS))).otherwise(usual)


def reclassify(checks: DataFrame, judged: DataFrame, version: str, verdict: Column, key: str = "url", check: str = "check_id", force: bool = False) -> DataFrame:
    """(key, check, was, classification, outcome) of the latest check of each key. judged: (check, classifier_version, classification), of which the greatest
    version counts. outcome: current (judged by this version before, and not force), changed, or same.
    """
    last = latest(checks, [key], check)
    before = judged.groupBy(check).agg(F.max_by(F.struct("classifier_version", "classification"), "classifier_version").alias("b"))
    both = last.join(before, check, "left").withColumn("now", verdict)
    current = F.coalesce(F.col("b.classifier_version") == version, F.lit(False)) & F.lit(not force)
    changed = F.coalesce(F.col("b.classification") != F.col("now"), F.lit(False))
    return both.select(key, check, F.col("b.classification").alias("was"), F.when(current, F.col("b.classification")).otherwise(F.col("now")).alias("classification"), F.when(current, "current").when(changed, "changed").otherwise("same").alias("outcome"))


def history(checks: DataFrame, judged: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """checks with each version's verdict on them, so a row for each version, or one without; of each key the latest `most` rows."""
    fanned = checks.join(judged, order, "left")
    if most is None:
        return fanned
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc_nulls_last("classifier_version"))
    return fanned.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def failures(log: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """log with consecutive_failures: the run of failures that ends in each row."""
    w = Window.partitionBy(key).orderBy(order)
    island = log.withColumn("_f", failed).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(key, "_island").orderBy(order)
    return island.withColumn("consecutive_failures", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(inside).cast("bigint")).drop("_f", "_island")


def recheck_seconds(state: Column, repeats: Column) -> Column:
    days = F.create_map(*(x for k, v in policy.RECHECK_DAYS.items() for x in (F.lit(k), F.lit(v * 86_400))))
    grown = F.pow(F.lit(2.0), F.least(repeats, F.lit(40)).cast("double"))
    transient = policy.TRANSIENT_SECONDS * grown
    return (
        F.when(state == "hard_404", F.least(F.lit(policy.RECHECK_DAYS["hard_404"] * 86_400.0) * grown, F.lit(policy.HARD_CAP_DAYS * 86_400.0)))
        .when(state == "temporarily_unavailable", F.when(transient > policy.TRANSIENT_CAP, float(policy.TRANSIENT_AFTER)).otherwise(transient))
        .otherwise(F.coalesce(F.try_element_at(days, state), F.lit(policy.RECHECK_DEFAULT_DAYS * 86_400)).cast("double"))
        .cast("bigint")
    )


def is_terminal(state: Column, consecutive: Column) -> Column:
    return (state == "hard_404") & (consecutive >= policy.CONFIRMATIONS)


def append_once(log: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key the log has not; of equal keys one."""
    return new.dropDuplicates(key).join(log.select(*key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    return latest(table.unionByName(new), key, order)


def evict(cache: DataFrame, size: str, used: str, tie: str, budget: int, cells: int = 1024) -> DataFrame:
    """The rows of a cache that go, oldest first (by used, then tie; both numbers), until the rest fits; none where the budget is not positive.

    Only the range of `used` in which that point lies is ordered: ranges are summed and cut again until one holds few rows or one value.
    """
    if budget <= 0:
        return cache.limit(0)
    total, low, high, n = cache.agg(F.coalesce(F.sum(size), F.lit(0)), F.min(used), F.max(used), F.count(F.lit(1))).first()
    need, freed = total - budget, 0
    if need <= 0:
        return cache.limit(0)
    while n > policy.ORDERED_ROWS and low < high:
        width = -(-(high - low + 1) // cells)
        sums = cache.where(F.col(used).between(low, high)).groupBy(F.floor((F.col(used) - low) / F.lit(width)).cast("bigint").alias("cell")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        for cell, held, rows in sorted(map(tuple, sums.collect())):  # `cells` rows at most
            if freed + held >= need:
                low, high, n = low + cell * width, min(high, low + (cell + 1) * width - 1), rows
                break
            freed += held
    w = Window.orderBy(F.col(used).asc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, -1)
    last = cache.where(F.col(used).between(low, high)).withColumn("_freed", F.coalesce(F.sum(size).over(w), F.lit(0)) + freed)
    return cache.where(F.col(used) < low).unionByName(last.where(F.col("_freed") < need).drop("_freed"))
