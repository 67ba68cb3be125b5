"""What an answer from the network means: retries, robots rules, refused addresses, registry statuses, secrets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeflow import policy

_TRANSIENT_HTTP = (429, 500, 502, 503, 504)


def backoff_ceiling(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """The longest wait before the attempt-th retry, from 1: base doubled each time, at most cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))


def backoff(attempt: Column, seed: int, base: float = 1.0, cap: float = 60.0) -> Column:
    """A wait drawn evenly from 0 to the ceiling."""
    return backoff_ceiling(attempt, base, cap) * F.rand(seed)


def should_retry(attempt: Column, transient: Column, most: int) -> Column:
    return transient & (attempt < most)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or the time left to an HTTP date; 0 at least, null where it is neither. now: a timestamp."""
    date = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z]+,\s*", ""), r"\s+(GMT|UTC)$", "")
    at = F.unix_timestamp(F.try_to_timestamp(F.concat(date, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))
    told = F.coalesce(F.trim(value).try_cast("double"), (at - F.unix_timestamp(now)).cast("double"))
    return F.greatest(F.lit(0.0), told) if told is None else F.when(told.isNotNull(), F.greatest(F.lit(0.0), told))


def robots_verdict(status: Column, rules_allow: Column) -> Column:
    """struct(allowed, reason) of the answer for a robots file: no answer and server errors deny, other client errors allow."""
    told = lambda ok, why: F.struct((F.lit(ok) if isinstance(ok, bool) else ok).alias("allowed"), why.alias("reason"))
    http = F.concat(F.lit("robots.txt "), status.cast("string"))
    return (
        F.when(status.isNull(), told(False, F.lit("robots.txt unreachable: disallow")))
        .when(status.between(200, 299), told(rules_allow, F.when(rules_allow, "allowed by rules").otherwise("disallow by rules")))
        .when((status == 429) | (status >= 500), told(False, F.concat(http, F.lit(": disallow"))))
        .otherwise(told(True, http))
    )


def robots_allow(body: Column, agent: Column, url: Column) -> Column:
    """Whether the rules of a robots file let the agent fetch the URL; null in gives null out."""

    def of(body: pa.Array, agent: pa.Array, url: pa.Array) -> pa.Array:
        from urllib.robotparser import RobotFileParser

        held: dict[str, RobotFileParser] = {}
        out = []
        for b, a, u in zip(body.to_pylist(), agent.to_pylist(), url.to_pylist(), strict=True):
            if None in (b, a, u):
                out.append(None)
                continue
            if b not in held:
                held.clear() if len(held) > 1000 else None
                held[b] = RobotFileParser()
                held[b].parse(b.splitlines())
            out.append(held[b].can_fetch(a, u))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(of, "boolean")(body, agent, url)


#: IPv4 ranges that are refused, the first that holds an address naming why.
REFUSED = (
    ("169.254.169.254", 32, "cloud metadata endpoint"), ("0.0.0.0", 32, "unspecified"), ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link-local"), ("224.0.0.0", 4, "multicast"),
    ("0.0.0.0", 8, "private range"), ("10.0.0.0", 8, "private range"), ("172.16.0.0", 12, "private range"), ("192.168.0.0", 16, "private range"), ("192.0.0.0", 29, "private range"), ("192.0.0.170", 31, "private range"), ("192.0.2.0", 24, "private range"),
    ("198.18.0.0", 15, "private range"), ("198.51.100.0", 24, "private range"), ("203.0.113.0", 24, "private range"), ("240.0.0.0", 4, "private range"),
)


def _number(address: str) -> int:
    return sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))


def refused_ipv4(address: Column) -> Column:
    """Why an IPv4 literal must not be contacted; null where it may, or is none."""
    octets = F.split(address, r"\.")
    n = F.aggregate(F.transform(octets, lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    shape = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    why = F.lit(None).cast("string")
    for base, bits, name in reversed(REFUSED):
        low = _number(base)
        why = F.when(n.between(low, low + (1 << (32 - bits)) - 1), name).otherwise(why)
    return F.when(shape, why)


def refused_address(address: Column) -> Column:
    """Why an address literal must not be contacted; IPv6, which alone goes to Python, as the IPv4 address that it maps."""

    def of(col: pa.Array) -> pa.Array:
        import ipaddress

        def one(a):
            try:
                ip = ipaddress.ip_address(a)
            except ValueError:
                return None
            ip = getattr(ip, "ipv4_mapped", None) or ip
            if str(ip) == "169.254.169.254":
                return "cloud metadata endpoint"
            for test, name in (("unspecified", "unspecified"), ("loopback", "loopback"), ("link_local", "link-local"), ("multicast", "multicast"), ("private", "private range"), ("reserved", "reserved")):
                if getattr(ip, f"is_{test}"):
                    return name
            return None

        return pa.array([None if a is None else one(a) for a in col.to_pylist()], pa.string())

    return F.coalesce(refused_ipv4(address), F.arrow_udf(of, "string")(F.when(address.contains(":"), address)))


def is_expiring(statuses: Column) -> Column:
    """Whether a registry status says that a registration is winding down."""
    return F.coalesce(F.exists(statuses, lambda s: F.lower(F.trim(s)).isin(policy.EXPIRING_STATUSES)), F.lit(False))


def redacted(name: Column, value: Column) -> Column:
    """A setting's value, hidden where its name says that it is a secret; an empty one is shown."""
    secret = F.upper(name).rlike("|".join(policy.SECRET_NAMES))
    return F.when((value != "") & secret, "<redacted>").otherwise(value)
