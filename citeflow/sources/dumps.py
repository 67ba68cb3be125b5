"""Readers of link dumps, page indexes and registry answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
_TOKEN = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()'\s;][^,()';]*)|([(),;])", re.S)
_ESCAPE = re.compile(r"\\(.)|''", re.S)


def parse_tuples(values: str) -> Iterator[list[str | None]]:
    """The tuples of the VALUES part of an INSERT statement; a bare NULL is None; it ends at a semicolon outside strings."""
    row: list[str | None] | None = None
    for m in _TOKEN.finditer(values):
        text, bare, sign = m.groups()
        if sign == "(":
            row = []
        elif sign == ")":
            if row is not None:
                yield row
            row = None
        elif sign == ";" and row is None:
            return
        elif row is not None and sign is None:
            if text is not None:
                row.append(_ESCAPE.sub(lambda e: "'" if e[1] is None else _ESCAPES.get(e[1], e[1]), text))
            else:
                row.append(None if bare.strip().upper() == "NULL" else bare.strip())


def insert_rows(lines: DataFrame, table: str, column: str = "value") -> DataFrame:
    """(fields array<string>) of each tuple of the table's INSERT lines."""
    prefix = f"insert into `{table}` values ".lower()
    wanted = lines.where(F.lower(F.substring(column, 1, len(prefix))) == prefix).select(F.substr(F.col(column), F.lit(len(prefix) + 1)))

    def of(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = list(parse_tuples(text))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 10_000], pa.list_(pa.string()))], names=["fields"])

    return wanted.mapInArrow(of, "fields array<string>")


def read_links(spark: SparkSession, path: str, table: str = "externallinks") -> DataFrame:
    f = F.col("fields")
    rows = insert_rows(spark.read.text(path), table).where(F.size(f) >= 4)
    return rows.select(f[0].try_cast("bigint").alias("el_id"), f[1].try_cast("bigint").alias("el_from"), f[2].alias("el_to_domain_index"), F.nullif(f[3], F.lit("")).alias("el_to_path"))


def index_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(offset, page_id, title) of offset:page_id:title lines; a title may hold colons; others are skipped."""
    get = lambda i: F.regexp_extract(F.col(column), r"^(\d+):(\d+):(.*)$", i)
    return lines.select(get(1).try_cast("bigint").alias("offset"), get(2).try_cast("bigint").alias("page_id"), get(3).alias("title")).where("offset is not null and page_id is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return index_rows(spark.read.text(path))


def dump_run(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"-(\d{8})-", 1), F.lit(""))


def dump_lang(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^([a-z][a-z_-]*?)wiki[_-]", 1), F.lit("")), F.lit("en"))


def check_same_run(names: DataFrame, name: str = "name", kind: str = "kind") -> str:
    """The one dump run that all files of (name, kind) belong to; an error where the kinds differ or a run cannot be told. A kind's files are few."""
    runs = names.select(kind, dump_run(F.col(name)).alias("run")).distinct().collect()
    found = {r["run"] for r in runs}
    if None in found or not runs:
        raise ValueError("the dump run cannot be told from the file names")
    if len(found) > 1:
        raise ValueError(f"files of several dump runs: {', '.join(sorted(found))}")
    return found.pop()


def latest_dump(names: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """(name): the last, in the order of names, of those that the pattern matches."""
    return names.where(F.col(name).rlike(pattern)).agg(F.max(name).alias(name))


def pages_of(block: Column) -> Column:
    """array of struct(page_id, title, text, redirect) of a fragment of page elements; redirect is the title that a page points to, if any."""
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.transform(
        F.regexp_extract_all(block, F.lit(r"(?s)<page>(.*?)</page>"), F.lit(1)),
        lambda p: F.struct(
            F.regexp_extract(p, r"<id>(\d+)</id>", 1).try_cast("bigint").alias("page_id"), unescape(F.regexp_extract(p, r"(?s)<title>(.*?)</title>", 1)).alias("title"), unescape(F.regexp_extract(p, r"(?s)<text[^>]*>(.*?)</text>", 1)).alias("text"),
            F.nullif(unescape(F.regexp_extract(p, r'<redirect title="([^"]*)"', 1)), F.lit("")).alias("redirect"),
        ),
    )


def read_blocks(spark: SparkSession, offsets: DataFrame, path: str, most: int = 64 << 20, ratio: int = 400) -> DataFrame:
    """(offset, block): the text of the compressed stream that begins at each offset of a file that every executor can read.
    Each is one bz2 stream; one that grows beyond `most` bytes, or `ratio` times what was read, is an error. offsets: (offset).
    """

    def of(batches):
        import bz2

        with open(path, "rb") as f:
            for batch in batches:
                for offset in batch.column(0).to_pylist():
                    f.seek(offset)
                    reader, out, taken, size = bz2.BZ2Decompressor(), [], 0, 0
                    while not reader.eof:
                        raw = f.read(1 << 16)
                        if not raw:
                            raise ValueError(f"the stream at {offset} does not end")
                        taken += len(raw)
                        out.append(reader.decompress(raw, most + 1 - size))
                        size += len(out[-1])
                        while not reader.eof and not reader.needs_input and size <= most:
                            out.append(reader.decompress(b"", most + 1 - size))
                            size += len(out[-1])
                        if size > most or size > ratio * max(taken, 1 << 16):
                            raise ValueError(f"the stream at {offset} is too large")
                    yield pa.RecordBatch.from_arrays([pa.array([offset], pa.int64()), pa.array([b"".join(out).decode("utf-8", "replace")], pa.string())], names=["offset", "block"])

    del spark
    return offsets.select(F.col("offset").cast("bigint")).distinct().sort("offset").mapInArrow(of, "offset bigint, block string")


_RDAP = "struct<events:array<struct<eventAction:string,eventDate:string>>,entities:array<struct<roles:array<string>,handle:string,vcardArray:array<string>>>,status:array<string>>"


def rdap(payload: Column) -> Column:
    """struct(expiry, registrar, statuses) of a registry answer. The registrar is named by its card; its handle stands in where the card has no name."""
    x = F.from_json(payload, _RDAP)
    expiry = F.get(F.filter(x["events"], lambda e: e["eventAction"] == "expiration"), 0)["eventDate"]
    first = F.get(F.filter(x["entities"], lambda e: F.array_contains(e["roles"], "registrar")), 0)
    items = F.from_json(F.get(first["vcardArray"], 1), "array<array<string>>")
    name = F.get(F.get(F.filter(items, lambda i: (F.get(i, 0) == "fn") & (F.size(i) >= 4)), 0), 3)
    registrar = F.coalesce(name, F.nullif(first["handle"], F.lit("")))
    return F.struct(expiry.alias("expiry"), registrar.alias("registrar"), F.coalesce(F.filter(x["status"], lambda s: s != ""), F.array().cast("array<string>")).alias("statuses"))


def registry_urls(domains: DataFrame, bootstrap: DataFrame, domain: str = "domain") -> DataFrame:
    """domains with base_url, of the longest suffix of whole labels that the bootstrap (tld, base_url) lists; null where there is none."""
    labels = F.split(F.regexp_replace(F.lower(F.col(domain)), r"^\.+|\.+$", ""), r"\.")
    tails = F.transform(labels, lambda _, i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("tail")))
    keyed = domains.select(domain).distinct()
    each = keyed.select(domain, F.explode(tails).alias("t")).select(domain, "t.i", "t.tail")
    base = bootstrap.groupBy(F.lower("tld").alias("tail")).agg(F.min("base_url").alias("base_url"))
    found = each.join(base, "tail").groupBy(domain).agg(F.min_by("base_url", "i").alias("base_url"))
    return domains.join(found, domain, "left")


_USAGE = "struct<error:struct<code:string>,continue:map<string,string>,query:struct<exturlusage:array<struct<title:string>>>,_bad:string>"


def live_usage(answers: DataFrame, most_pages: int = 4) -> DataFrame:
    """(domain, live_page_count, truncated, error_kind) of an API's answers (domain, page_no from 0, http_status, payload), which are read in order up to the
    first without a continuation; an answer of 200 that holds an error is one. Counts are of distinct titles, null where there is an error.
    """
    x = F.from_json("payload", _USAGE, {"columnNameOfCorruptRecord": "_bad"})
    kind = F.when(F.col("http_status") != 200, F.concat(F.lit("http:"), F.col("http_status").cast("string"))).when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "malformed_json").when(F.col("x.error").isNotNull(), F.concat(F.lit("api:"), F.coalesce("x.error.code", F.lit("unknown"))))
    rows = answers.where(F.col("page_no") < most_pages).withColumn("x", x).withColumn("kind", kind)
    more = F.coalesce(F.size(F.map_keys("x.continue")) > 0, F.lit(False))
    titles = F.filter(F.transform(F.coalesce("x.query.exturlusage", F.array().cast("array<struct<title:string>>")), lambda e: e["title"]), lambda t: t != "")
    read = rows.select("domain", "page_no", "kind", more.alias("more"), titles.alias("titles"))
    ends = read.groupBy("domain").agg(F.min(F.when(~F.col("more") | F.col("kind").isNotNull(), F.col("page_no"))).alias("end"))
    used = read.join(ends, "domain").where(F.col("end").isNull() | (F.col("page_no") <= F.col("end")))
    folded = used.groupBy("domain").agg(F.array_size(F.array_distinct(F.flatten(F.collect_list("titles")))).cast("bigint").alias("n"), F.bool_or(F.col("more") & (F.col("page_no") == most_pages - 1)).alias("truncated"), F.min("kind").alias("error_kind"))
    return folded.select("domain", F.when(F.col("error_kind").isNull(), F.col("n")).alias("live_page_count"), "truncated", "error_kind")


def expires_within(expiry: Column, days: Column | int, now: Column) -> Column:
    left = F.unix_timestamp(F.try_to_timestamp(expiry)) - F.unix_timestamp(now)
    return F.coalesce(left.between(0, (F.lit(days) if isinstance(days, int) else days) * 86_400), F.lit(False))


def availability(payload: Column, error: Column) -> Column:
    """struct(has_snapshot, url, timestamp, status): has_snapshot is null where the archive could not be asked."""
    x = F.from_json(payload, "struct<archived_snapshots:struct<closest:struct<available:boolean,url:string,timestamp:string,status:string>>>")["archived_snapshots"]["closest"]
    has = F.when(error.isNull() & payload.isNotNull(), F.coalesce(x["available"], F.lit(False)))
    return F.struct(has.alias("has_snapshot"), F.when(has, x["url"]).alias("url"), F.when(has, x["timestamp"]).alias("timestamp"), F.when(has, x["status"]).alias("status"))
