"""Deterministic ranked exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.functions import pages


def ranked(rows: DataFrame, score: str, pages: str, name: str) -> DataFrame:
    return rows.orderBy(F.desc(score), F.desc(pages), F.asc(name))


#: The columns of a candidate export, in order.
COLUMNS = "domain state score wiki_pages wiki_links last_checked registrar expiry public_suffix private_suffix example_article example_article_url example_section example_anchor example_link_kind dead_link_tagged wiki_removed wiki_pages_live wiki_verified_at archive_url score_explanation".split()


def laid_out(rows: DataFrame) -> DataFrame:
    """rows with COLUMNS as strings, in order; a column that rows lack is empty."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON with sorted keys; a score_explanation is shown as what it holds, where it is JSON."""
    names = sorted(rows.columns)
    inlined = [F.try_parse_json(F.col(c)).alias(c) if c == "score_explanation" else F.col(c) for c in names]
    return rows.select(F.to_json(F.struct(*inlined), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as a CSV line; a field is quoted where it holds a comma, a quote or a line end."""

    def field(c: str):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return rows.select(F.concat_ws(",", *(field(c) for c in rows.columns)).alias("value"))


def _put(told: DataFrame, path: str, head: str, first: str = "") -> str:
    """Writes head, then first and the lines of told in their order, partition by partition; the digest covers what follows head."""
    digest = hashlib.sha256(first.encode())
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(head + first)
        for r in told.toLocalIterator():
            digest.update(r[0].encode() + b"\n")
            f.write(r[0] + "\n")
    return digest.hexdigest()


def write_jsonl(rows: DataFrame, path: str, meta: dict) -> str:
    """Writes a meta line and the rows in their order; the digest that is returned covers the rows alone. For ranked reports, which people read."""
    return _put(json_lines(rows), path, json.dumps(meta, sort_keys=True) + "\n")


def write_candidates(rows: DataFrame, path: str, about: list[str]) -> str:
    """Writes comment lines of provenance, the header and COLUMNS of rows in their order; the digest covers header and rows."""
    return _put(csv_lines(laid_out(rows)), path, "".join(f"# {x}\n" for x in about), ",".join(COLUMNS) + "\n")


def write_csv(rows: DataFrame, folder: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    (rows if columns is None else rows.select(*columns)).write.mode(mode).option("header", True).csv(folder)


def write_both(rows: DataFrame, folder: str) -> None:
    """The rows as CSV and as JSON lines, in two folders below the one given."""
    write_csv(rows, f"{folder}/csv")
    rows.write.mode("overwrite").json(f"{folder}/json")


#: The columns of part records that lead, in order.
LEADING = ("brand", "part_number", "name", "price", "dimensions", "weight", "description", "compatibility")


def record_table(rows: DataFrame) -> DataFrame:
    """Part records with their specifications as columns, compatibility as one text, the LEADING columns first."""
    flat = pages.flatten_map(rows, "specifications") if "specifications" in rows.columns else rows
    if "compatibility" in flat.columns and flat.schema["compatibility"].dataType.typeName() == "array":
        flat = flat.withColumn("compatibility", F.array_join("compatibility", "; "))
    return flat.select(*(c for c in LEADING if c in flat.columns), *(f"`{c}`" for c in flat.columns if c not in LEADING))


def append_records(rows: DataFrame, folder: str) -> None:
    """Appends part records; Parquet keeps their columns by name, so that later ones may have others (read with mergeSchema)."""
    record_table(rows).write.mode("append").parquet(folder)


def write_log(rows: DataFrame, folder: str, *partition: str) -> None:
    rows.write.mode("append").partitionBy(*partition).parquet(folder)
