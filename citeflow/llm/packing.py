"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut to pieces of at most CAPACITY tokens. Pieces are dealt to shards by hash; each shard is
packed alone, longest piece first. Open bins are ordered by what is left in them and carry two bitmaps: the
sources and the duplicate clusters that they hold. The search starts at the bin with the least room that still fits and
goes on to its successors until one is compatible, that is, shares neither bit with the piece; that is the tightest
compatible bin. A bin thus never holds two documents of one source or two copies of one text.
Only keys, sizes and ids are shuffled, no text.

Defined cases: null, empty and white-space texts have no token and are in no bin; a null source is a
source of its own; a row without a cluster (null) conflicts with no copy; equal sizes are taken in the order of (doc_id, null first, row key);
rows repeated as a whole are copies and go to different bins; the pieces of one document longer than CAPACITY may not share a bin either; an
empty table gives an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.mixing import n_tokens

CAPACITY = 2048
#: Documents to a shard, on average.
SHARD_ROWS = 2048
SCHEMA = "shard int, bin int, offset int, doc_id bigint, piece int, start_token bigint, n_tokens int"


def best_fit(size: list[int], source: list[int], cluster: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece in the order given. source, cluster: bit numbers; -1 for none."""
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    bins, offsets = [], []
    for n, s, c in zip(size, source, cluster, strict=True):
        sbit, cbit = (1 << s) if s >= 0 else 0, (1 << c) if c >= 0 else 0
        i = bisect_left(order, (n, -1))
        while i < len(order) and (sources[order[i][1]] & sbit or clusters[order[i][1]] & cbit):
            i += 1
        if i < len(order):
            room, b = order.pop(i)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= sbit
        clusters[b] |= cbit
        bins.append(b)
        offsets.append(capacity - room)
        if room > n:
            insort(order, (room - n, b))
    return bins, offsets


def _pack_shard(capacity: int):
    def of(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        doc = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else table["doc_id"].fill_null(-(1 << 63)).to_numpy()
        null = np.asarray(table["doc_id"].is_null())
        tokens, key = table["n"].to_numpy(), table["row"].to_numpy()
        whole = (tokens + capacity - 1) // capacity
        row = np.repeat(np.arange(len(tokens)), whole)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        size = np.minimum(capacity, tokens[row] - piece * capacity)
        by = np.lexsort((piece, key[row], doc[row], -size))
        row, piece, size = row[by], piece[by], size[by]
        source = np.unique(np.asarray(table["source"].fill_null("\0null").to_pylist(), object).astype(str), return_inverse=True)[1]
        # a cluster needs a bit only where the shard holds it twice
        cluster = table["cluster"]
        value = cluster.fill_null(0).to_numpy()
        _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
        several = (count[inverse] > 1) & ~np.asarray(cluster.is_null())
        bit = np.full(len(value), -1)
        bit[several] = np.unique(inverse[several], return_inverse=True)[1]
        bins, offsets = best_fit(size.tolist(), source[row].tolist(), bit[row].tolist(), capacity)
        return pa.table(
            {
                "shard": pa.array(np.full(len(row), shard, np.int32)),
                "bin": pa.array(bins, pa.int32()),
                "offset": pa.array(offsets, pa.int32()),
                "doc_id": pa.array(doc[row], pa.int64(), mask=null[row]),
                "piece": pa.array(piece.astype(np.int32)),
                "start_token": pa.array((piece * capacity).astype(np.int64)),
                "n_tokens": pa.array(size.astype(np.int32)),
            }
        )

    return of


def copy_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(text), "\\s+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = SHARD_ROWS, size: Column | None = None) -> DataFrame:
    """SCHEMA: where each piece of each document lies. cluster: a column that names a row's duplicate cluster, such as the root of
    ngram_join.groups; by default copy_cluster. size: a row's tokens, such as token_counts' n_tokens; by default its words.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (n_tokens(text) if size is None else F.coalesce(size.cast("bigint"), F.lit(0))).alias("n"), F.xxhash64("doc_id", "text").alias("row"), F.col("source").cast("string").alias("source"),
        (copy_cluster(text) if cluster is None else cluster.cast("bigint")).alias("cluster"),
    ).where("n > 0")
    shards = max(1, docs.count() // shard_rows)
    dealt = rows.withColumn("shard", F.pmod(F.hash("row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), SCHEMA)
