"""URL algebra as native column expressions.

Each function takes and returns columns; null in gives null out. Python runs in ascii_hosts alone, which canonical() calls for
the rows that need it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow import policy

_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, by the generic syntax; '' where there is none."""
    return F.regexp_extract(url, _URI, group)


def host_of(authority: Column) -> Column:
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.regexp_replace(bare, r":\d*$", "")


def port_of(authority: Column) -> Column:
    return F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int")


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once: nested column functions would otherwise repeat it at every mention."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_host(host: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(host), r"\.+$", ""))


def ascii_hosts(host: Column) -> Column:
    """Hosts in their IDNA form by UTS 46, not transitional; those that have none are kept."""

    def of(col: pa.Array) -> pa.Array:
        import idna

        def one(h):
            if h is None or h.isascii():
                return h
            try:
                return idna.encode(h, uts46=True, transitional=False).decode("ascii")
            except idna.IDNAError:
                return h

        return pa.array([one(h) for h in col.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(host)


def remove_dot_segments(path: Column) -> Column:
    """'.' goes; '..' takes the segment before it, unless that is empty or absent; empty segments stay."""
    keep = lambda acc, s: (
        F.when(s == ".", acc)
        .when(s == "..", F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ""), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/")


def normalize_percent(text: Column) -> Column:
    """Escapes of unreserved characters are decoded, the others get capital digits."""
    tokens = F.regexp_extract_all(text, F.lit(r"(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))

    def one(t: Column) -> Column:
        code = F.conv(F.substring(t, 2, 2), 16, 10).cast("int")
        char = F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.chr(code))
        return F.when(char.rlike(r"^[A-Za-z0-9._~\-]$"), char).when(char.isNotNull(), F.upper(t)).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def strip_tracking(query: Column) -> Column:
    """Tracking parameters go, in place. What is left is encoded anew only if one went."""
    pairs = F.split(query, "&")
    tracked = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(policy.TRACKING)
    kept = F.filter(pairs, lambda p: ~tracked(p) & (p != ""))

    def encode(p: Column) -> Column:
        at = F.instr(p, "=")
        code = lambda c: F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("%7E"), F.lit("~"))
        name = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)
        value = F.when(at > 0, F.substr(p, at + 1)).otherwise(F.lit(""))
        return F.concat(code(name), F.lit("="), code(value))

    return F.when(F.exists(pairs, tracked), F.array_join(F.transform(kept, encode), "&")).otherwise(query)


def repair_scheme(url: Column) -> Column:
    fixed = F.regexp_replace(url, r"^(https?):/+", "$1://")
    return F.when(fixed.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), fixed).otherwise(F.concat(F.lit("http://"), F.regexp_replace(fixed, "^/+", "")))


def _unwrap_once(url: Column) -> Column:
    """struct(url, date) of what a snapshot's URL holds; nulls where it is none."""
    stamp = r"(\d{4,14})"
    wayback = f"^/[wW][eE][bB]/{stamp}(?:[a-zA-Z]{{2}}_|)/(.+)$"
    today = f"^/(?:[A-Za-z0-9]{{5}}|oldest|newest|{stamp})/(https?://.+)$"

    def of(x: Column) -> Column:
        get = lambda i: F.when(x["host"].isin(policy.WAYBACK), F.regexp_extract(x["rest"], wayback, i)).when(x["host"].isin(policy.ARCHIVE_TODAY), F.regexp_extract(x["rest"], today, i))
        inner = F.nullif(get(2), F.lit(""))
        return F.struct(F.when(inner.isNotNull(), repair_scheme(inner)).alias("url"), F.nullif(get(1), F.lit("")).alias("date"))

    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*)$", 1)
    return let(F.struct(F.lower(host_of(part(url, 2))).alias("host"), rest.alias("rest")), of)


def unwrap_archive(url: Column) -> Column:
    """struct(url, archive_url, archive_date): snapshots are unwrapped up to twice; the outer one is told."""
    return let(
        url, lambda u: let(_unwrap_once(u), lambda one: F.struct(F.coalesce(_unwrap_once(one["url"])["url"], one["url"], u).alias("url"), F.when(one["url"].isNotNull(), u).alias("archive_url"), one["date"].alias("archive_date")))
    )


def under(host: Column, sites: list[str]) -> Column:
    """host is one of sites or below one, at label boundaries."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.coalesce(F.arrays_overlap(tails, F.array(*map(F.lit, sites))), F.lit(False))


def is_ip(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains(":")


def suffix_analysis(host: Column) -> Column:
    """struct(registrable, suffix, is_private): the longest rule of policy.SUFFIXES that matches; '' where there is none.
    A wildcard rule covers one more label; an exception to it ends one label later.
    """
    rules = F.create_map(*(x for s, p in policy.SUFFIXES.items() for x in (F.lit(s), F.lit(p))))

    def of(labels: Column) -> Column:
        n = F.size(labels)
        tail = lambda i: F.array_join(F.slice(labels, i, n), ".")
        excepted = lambda i: F.map_contains_key(rules, F.concat(F.lit("!"), tail(i)))
        wild = lambda i: F.map_contains_key(rules, F.concat(F.lit("*."), F.array_join(F.slice(labels, i + 1, n), ".")))
        fits = F.filter(F.sequence(F.lit(1), n), lambda i: F.map_contains_key(rules, tail(i)) | (wild(i) & ~excepted(i)) | ((i > 1) & excepted(F.greatest(i - 1, F.lit(1)))))

        def told(first: Column) -> Column:
            good = first.isNotNull() & (first > 1)
            return F.struct(
                F.when(good, tail(F.greatest(first - 1, F.lit(1)))).otherwise("").alias("registrable"),
                F.when(good, tail(F.greatest(first, F.lit(1)))).otherwise("").alias("suffix"),
                F.coalesce(F.when(good, F.try_element_at(rules, tail(F.greatest(first, F.lit(1))))), F.lit(False)).alias("is_private"),
            )

        return let(F.get(fits, 0), told)

    return let(F.when(is_ip(host), F.array(F.lit(""))).otherwise(F.split(host, r"\.")), of)


def drop_reason(url: Column) -> Column:
    def of(x: Column) -> Column:
        return (
            F.when(~x["scheme"].isin("http", "https"), "not_crawlable_scheme").when(x["host"] == "", "no_host").when(under(x["host"], policy.WIKI_SITES), "wikimedia_internal").when(under(x["host"], policy.RESOLVERS), "identifier_resolver")
        )

    return let(F.struct(F.lower(part(url, 1)).alias("scheme"), normalize_host(host_of(part(url, 2))).alias("host")), of)


def acquireable(host: Column) -> Column:
    """No address, and no wiki's or resolver's host. A private suffix does not exclude a host."""
    return ~(is_ip(host) | under(host, policy.WIKI_SITES) | under(host, policy.RESOLVERS))


def is_archive_host(host: Column) -> Column:
    return F.lower(host).isin(policy.WAYBACK + policy.ARCHIVE_TODAY)


def normalize(raw: Column) -> Column:
    """The canonical form of a URL: archives unwrapped, host lower, default port, dots, tracking, user and fragment gone."""

    def build(x: Column) -> Column:
        default = ((x["scheme"] == "http") & (x["port"] == 80)) | ((x["scheme"] == "https") & (x["port"] == 443))
        shown = F.when(x["port"].isNull() | default, "").otherwise(F.concat(F.lit(":"), x["port"].cast("string")))
        return F.concat(x["scheme"], F.lit("://"), x["host"], shown, F.when(x["path"] == "", "/").otherwise(x["path"]), F.when(x["query"] == "", "").otherwise(F.concat(F.lit("?"), x["query"])))

    def cut(u: Column) -> Column:
        authority = part(u, 2)
        path = let(remove_dot_segments(part(u, 3)), normalize_percent)
        return F.struct(F.lower(part(u, 1)).alias("scheme"), normalize_host(host_of(authority)).alias("host"), port_of(authority).alias("port"), path.alias("path"), let(part(u, 4), strip_tracking).alias("query"))

    return let(unwrap_archive(F.trim(raw))["url"], lambda u: let(cut(u), build))


def canonical(rows: DataFrame, url: str, to: str) -> DataFrame:
    """rows with `to`: normalize(url), with a host beyond ASCII in its IDNA form. Other rows send a null to Python."""
    plain = rows.withColumn(to, normalize(F.col(url)))
    before = F.regexp_extract(F.col(to), r"^([a-z][a-z0-9+.\-]*://)", 1)
    host = F.regexp_extract(F.col(to), r"^[a-z][a-z0-9+.\-]*://([^/:?#]*)", 1)
    wide = F.when(host.rlike(r"[^\x00-\x7F]"), host)
    name = ascii_hosts(wide)
    return plain.withColumn(to, F.when(name.isNotNull(), F.concat(before, name, F.substr(F.col(to), F.length(before) + F.length(host) + 1))).otherwise(F.col(to)))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def reconstruct(domain_index: Column, path: Column) -> Column:
    """URL of a reversed domain index and a path; null where there is no scheme or host."""
    scheme = F.lower(F.regexp_extract(domain_index, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_extract(domain_index, r"^[A-Za-z][A-Za-z0-9+.\-]*://(.*)$", 1)
    port = F.regexp_extract(rest, r"\.:(\d{1,5})$", 1)
    valid = port.try_cast("int").between(1, 65535)
    host = F.when(valid, F.regexp_replace(rest, r":\d+$", "")).otherwise(rest)
    name = (
        F.when(host.rlike(r"^V[46]\."), F.regexp_replace(F.regexp_replace(host, r"^V[46]\.", ""), r"\.$", ""))
        .otherwise(F.array_join(F.reverse(F.filter(F.split(host, r"\."), lambda x: x != "")), "."))
    )
    opaque = (rest == "") & (scheme != "") & domain_index.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^/]")
    url = F.concat(scheme, F.lit("://"), name, F.when(valid, F.concat(F.lit(":"), port)).otherwise(""), F.coalesce(path, F.lit("")))
    return F.when(opaque, F.concat(domain_index, F.coalesce(path, F.lit("")))).when((scheme != "") & (name != ""), url)


def crossed_domain(a: Column, b: Column) -> Column:
    x, y = suffix_analysis(normalize_host(host_of(part(a, 2))))["registrable"], suffix_analysis(normalize_host(host_of(part(b, 2))))["registrable"]
    return (x != "") & (y != "") & (x != y)


def page_range(text: Column) -> Column:
    """struct(first, last) of p1p41242 or 1-41242."""
    shape = r"^p?(\d+)[p\-](\d+)$"
    return F.struct(F.regexp_extract(text, shape, 1).try_cast("bigint").alias("first"), F.regexp_extract(text, shape, 2).try_cast("bigint").alias("last"))


def is_namespaced(title: Column) -> Column:
    return title.rlike("^(" + "|".join(policy.NAMESPACES) + "):")


def article_url(lang: Column, title: Column, section: Column | None = None) -> Column:
    """An article's address; section: the heading to go to, if any."""
    spaced = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    page = F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), spaced(title))
    return page if section is None else F.concat(page, F.when(section != "", F.concat(F.lit("#"), spaced(section))).otherwise(""))
