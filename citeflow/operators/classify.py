"""Rule engines: verdicts as one CASE chain over stored observations, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow import policy
from citeflow.functions import urls


def found(text: Column, needles: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n))


def signals(title: Column, body: Column, use) -> Column:
    """use(s), s being a struct of the lists of what is found in title and body; each text and list is made once a row."""

    def lists(x: Column) -> Column:
        return F.struct(
            found(x["both"], policy.PARKING_PROVIDERS + policy.PARKING_PHRASES).alias("strong"), found(x["both"], policy.PARKING_WEAK).alias("weak"), found(x["both"], policy.SALE_PHRASES).alias("sale"),
            found(x["title"], policy.SOFT_TITLES).alias("soft_title"), found(x["body"], policy.SOFT_PHRASES).alias("soft_body"),
        )

    def texts(t: Column) -> Column:
        title, body = F.lower(F.coalesce(t["title"], F.lit(""))), F.lower(F.coalesce(t["body"], F.lit("")))
        return F.struct(title.alias("title"), body.alias("body"), F.concat_ws(" ", title, body).alias("both"))

    return urls.let(F.struct(title.alias("title"), body.alias("body")), lambda t: urls.let(texts(t), lambda x: urls.let(lists(x), use)))


def to_root(url: Column, final_url: Column, redirects: Column) -> Column:
    """A redirect from below the root of a site to a root."""
    path = lambda u: F.regexp_extract(u, r"^[A-Za-z][^:]*://[^/?#]*([^?#]*)", 1)
    deep = lambda u: path(u).rlike("[^/]")
    return F.coalesce((redirects > 0) & (final_url != "") & deep(url) & ~deep(final_url), F.lit(False))


def soft_404_score(s: Column, at_root: Column, length: Column) -> Column:
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    return one(F.size(s["soft_title"]) > 0, 2) + one(F.size(s["soft_body"]) > 0, 2) + one(at_root) + one(F.coalesce(length, F.lit(0)) < policy.THIN_BODY)


def verdict(name: str, confidence: float | Column, *reasons: Column | str) -> Column:
    told = [F.lit(r) if isinstance(r, str) else r for r in reasons]
    return _verdict(name, confidence, F.array(*told))


def _verdict(name: str | Column, confidence: float | Column, reasons: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("classification"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), reasons.cast("array<string>").alias("reasons"))


def classify_content(title: Column, body: Column, url: Column, final_url: Column, redirects: Column, length: Column, crossed: Column | None = None, status: Column | None = None) -> Column:
    """Verdict on a page that was answered with 2xx, with the soft-404 score as a fourth field."""
    named = lambda prefix, hits: F.transform(hits, lambda h: F.concat(F.lit(prefix), h))
    only = lambda c, reason: F.when(c, F.array(reason)).otherwise(F.array().cast("array<string>"))
    at_root, n = to_root(url, final_url, redirects), F.coalesce(redirects, F.lit(0))

    def decide(s: Column) -> Column:
        strong, sale, score = F.size(s["strong"]), F.size(s["sale"]), soft_404_score(s, at_root, length)
        thin = F.coalesce(length, F.lit(0))
        soft = F.concat(named("title:", s["soft_title"]), named("body:", s["soft_body"]), only(at_root, F.lit("deep path to root")), only(thin < policy.THIN_BODY, F.concat(F.lit("thin body:"), thin.cast("string"))))
        moved = F.concat(F.array(F.concat(n.cast("string"), F.lit(" redirect(s) to "), F.coalesce(final_url, F.lit("")))), only(F.lit(False) if crossed is None else F.coalesce(crossed, F.lit(False)), F.lit("cross-domain handover")))
        v = (
            F.when((sale > 0) & ((strong > 0) | (sale >= 2)), _verdict("for_sale", 0.9, F.concat(named("sale:", s["sale"]), named("parking:", s["strong"]))))
            .when(strong > 0, _verdict("parked", 0.85, F.concat(named("parking:", s["strong"]), named("weak:", s["weak"]))))
            .when(sale > 0, _verdict("for_sale", 0.6, named("sale:", s["sale"])))
            .when(score >= 2, _verdict("soft_404", F.least(F.lit(0.5) + F.lit(0.15) * score, F.lit(0.9)), soft))
            .when(n > 0, _verdict("redirect", 0.95, moved))
            .otherwise(verdict("live", 0.9, F.concat(F.lit("HTTP "), F.coalesce((F.lit(200) if status is None else status).cast("string"), F.lit("")))))
        )
        return F.struct(v["classification"].alias("classification"), v["confidence"].alias("confidence"), v["reasons"].alias("reasons"), score.alias("soft_score"))

    return signals(title, body, decide)


def classify_url(robots: Column, fetched: Column, error_kind: Column, status: Column, content: Column) -> Column:
    """Verdict on a stored check; content is the verdict that a 2xx answer would get."""
    kinds = F.create_map(*(x for k, (name, sure) in policy.ERROR_KINDS.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(sure).alias("sure")))))
    known = F.try_element_at(kinds, F.split_part(error_kind, F.lit(":"), F.lit(1)))
    http = F.concat(F.lit("HTTP "), status.cast("string"))
    return (
        F.when(F.coalesce(F.contains(F.lower(robots), F.lit("disallow")), F.lit(False)), verdict("blocked_by_robots", 1.0, robots))
        .when(~F.coalesce(fetched, F.lit(False)), verdict("unclassified", 0.0, "no observation"))
        .when((error_kind != "") & known.isNotNull(), _verdict(known["name"], known["sure"], F.array(F.concat(F.lit("error_kind="), error_kind))))
        .when(error_kind != "", verdict("unclassified", 0.3, F.concat(F.lit("unmapped error_kind="), error_kind)))
        .when(status.isNull(), verdict("unclassified", 0.0, "neither status nor error"))
        .when(status.isin(404, 410), verdict("hard_404", 1.0, http))
        .when((status == 429) | (status >= 500), verdict("temporarily_unavailable", 1.0, http))
        .when(status.between(200, 299), F.struct(*(content[c].alias(c) for c in ("classification", "confidence", "reasons"))))
        .when(status.between(400, 499), verdict("live", 0.8, http))
        .otherwise(verdict("unclassified", 0.2, http))
    )


def lifted_state(for_sale: Column, parked: Column, total: Column) -> Column:
    return F.when((for_sale > 0) & (for_sale * 2 >= total), "for_sale").when((parked > 0) & (parked * 2 >= total), "parked")


def dns_quorum(answers: DataFrame, key: str = "domain") -> DataFrame:
    """(key, dns_status, resolvers_agreed, confirmed_nxdomain) of answers (key, resolver_no, status)."""
    n = lambda s: F.count_if(F.col("status") == s)
    some = F.min(F.when(F.col("status").isin("ok", "no_records"), F.struct("resolver_no", "status")))["status"]
    folded = answers.groupBy(key).agg(some.alias("some"), n("nxdomain").alias("nx"), n("servfail").alias("sf"), n("timeout").alias("to"), (F.count_distinct("status") == 1).alias("resolvers_agreed"))
    status = F.coalesce("some", F.when(F.col("nx") >= 2, "nxdomain").when(F.col("nx") == 1, "error").when(F.col("sf") > 0, "servfail").when(F.col("to") > 0, "timeout").otherwise("error"))
    return folded.select(key, status.alias("dns_status"), "resolvers_agreed", ((status == "nxdomain") & (F.col("nx") >= 2)).alias("confirmed_nxdomain"))


def classify_domain(dns: Column, confirmed: Column, rdap: Column, expiring: Column, lifted: Column) -> Column:
    resolves = dns.isin("ok", "no_records")
    v = verdict
    return (
        F.when(confirmed & (rdap == "not_found"), v("unregistered", 1.0, "nxdomain", "not found"))
        .when(confirmed & (rdap == "no_rdap_for_tld"), v("no_rdap_for_tld", 0.5, "nxdomain"))
        .when(confirmed & (rdap == "unavailable"), v("unknown", 0.4, "nxdomain"))
        .when((dns == "nxdomain") & ~confirmed, v("unknown", 0.3, "single nxdomain"))
        .when((rdap == "registered") & expiring, v("expiring", 0.95, "status"))
        .when(lifted.isNotNull(), F.struct(lifted.alias("classification"), F.lit(0.85).alias("confidence"), F.array(F.lit("urls")).alias("reasons")))
        .when(rdap == "registered", v("active", 0.95, "registered"))
        .when((rdap == "no_rdap_for_tld") & resolves, v("active", 0.7, "resolves"))
        .when(rdap == "no_rdap_for_tld", v("no_rdap_for_tld", 0.5, "no registry data"))
        .when(resolves, v("active", 0.6, "resolves"))
        .otherwise(v("unknown", 0.2, "no evidence"))
    )


def gap_verdict(has_snapshot: Column, status: Column) -> Column:
    """Could not ask is unknown; asked and nothing there is lost."""
    return F.when(has_snapshot.isNull(), "unknown").when(~has_snapshot, "lost").when(status.isNotNull() & ~status.isin("200", "203", "226"), "lost").otherwise("recoverable")
