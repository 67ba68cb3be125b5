"""N-gram Jaccard self-join of documents by a grouped prefix join.

A text is the set of its word n-grams (lower-cased runs of ASCII letters, digits and non-ASCII
characters). Equal sets are one class, which is carried once, with its number of documents, and never multiplied out.

Under one total order of all n-grams, the first LEAST n-grams that two sets with Jaccard similarity of at least t share (or
all that they must share, if fewer) lie within the first |x| - a + LEAST of each, a being the least overlap that their sizes
allow. Classes with the same such prefix, size and cluster are collapsed into one group; groups that share that many n-grams in such
places are candidate pairs, which are expanded to their members and verified on the whole sets. The order is rare-first:
by the level of a count sketch of all n-grams of the corpus (CELLS counters, the same number at any size of the corpus),
then by hash. Any order gives the same result.

Crowds of similar texts would make the prefix join count every pair of them once for each n-gram that they share.
So they are gathered first: classes that share a band of bin minima with the class that comes first in it, and enough of the
minima, are one cluster; the pairs within a cluster are verified in blocks by matrix products, each set being moved once a block, and
the prefix join takes only pairs of different clusters. What the bands miss, the prefix join finds. A verified block gives, for
each class, the number of documents that it is linked with and one link towards the least class that it is connected
with; pairs are not written.

Defined cases: a null, empty or word-less text has no n-gram and matches nothing; a text of fewer than n words is
one n-gram of all its words; repeated rows and equal texts are in one class, with Jaccard 1; an empty table
gives an empty result; columns other than the key and the text are not read. N-grams are compared by 52-bit
hashes, classes by a 64-bit hash of their set and rows by a 64-bit key, so that two of 10^6 differ by chance with 3 in 10^8, two of 10^9 with 3 in 100.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import ALNUM, chunks, cut, fresh, mix, row_key, trim, word_hashes, words

#: Prefix n-grams that a candidate pair must share.
LEAST = 4
#: Counters of the sketch, and how it is cut to be summed.
CELLS = 1 << 22
SLICE = 1 << 18
FAN_IN = 128
#: Classes of a cluster to a block.
BLOCK = 1024
#: Postings that a task holds before it hands them on, and postings to a bucket.
HELD, BUCKET = 1_000_000, 1_000_000
#: Pairs of postings that are looked at together; four times as many distinct pairs are held before they are counted.
PAIRS = 500_000
#: Pairs between clusters up to which the keys of their texts (16 bytes each) are broadcast; beyond, texts are moved.
FEW = 500_000
_BITS = np.uint64(52)


def gram_sets(col: pa.Array, n: int):
    """(first row, end row, row of each n-gram, n-gram) of runs of rows, distinct and sorted by row and value."""
    for lo, hi, data, at in chunks(col):
        start, end, first = words(data, at, ALNUM)
        count = np.diff(first)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), count)
        h = word_hashes(data, start, end)
        left = first[1:][row] - np.arange(len(h))  # words from here to the end of the row
        g = h.copy()
        factor = np.uint64(1)
        for j in range(1, n):
            factor = factor * np.uint64(0x9E3779B97F4A7C15 | 1)
            shifted = np.zeros_like(h)
            shifted[: max(len(h) - j, 0)] = h[j:]
            g += np.where(left > j, shifted, np.uint64(0)) * factor
        begins = np.zeros(len(h) + 1, bool)
        begins[first[:-1][count > 0]] = True
        use = (left >= n) | (begins[:-1] & (left < n))
        packed = np.sort((row[use].astype(np.uint64) << _BITS) | (mix(g[use], 2) >> np.uint64(12)))
        keep = np.ones(len(packed), bool)
        keep[1:] = packed[1:] != packed[:-1]
        packed = packed[keep]
        yield lo, hi, (packed >> _BITS).astype(np.int64), packed & np.uint64((1 << 52) - 1)


class Sketch:
    """Counts n-grams in CELLS counters, by their low bits, a few million at a time."""

    def __init__(self):
        self.total = np.zeros(CELLS, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, gram: np.ndarray) -> None:
        self.held.append((gram & np.uint64(CELLS - 1)).astype(np.int32))
        self.size += len(gram)
        if self.size > CELLS:
            self.fold()

    def fold(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=CELLS)
        self.held, self.size = [], 0


def _squeezed(count: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(count, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for blob in table["blob"]:
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    return pa.table({"slice": table["slice"][:1], "part": table["to"][:1], "blob": pa.array([_squeezed(total)], pa.binary())})


def levels(base: DataFrame, n: int) -> np.ndarray:
    """For each counter, four times the base-2 logarithm of the n-grams counted there, over the whole corpus."""

    def of(batches):
        sketch = Sketch()
        for batch in batches:
            for _, _, _, gram in gram_sets(batch.column(0), n):
                sketch.add(gram)
        sketch.fold()
        part = TaskContext.get().partitionId()
        for i in range(CELLS // SLICE):
            count = sketch.total[i * SLICE : (i + 1) * SLICE]
            if count.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int64()), pa.array([_squeezed(count)], pa.binary())], names=["slice", "part", "blob"])
        del sketch
        trim()

    schema = "slice int, part bigint, blob binary"
    found = cut(base.select("text").mapInArrow(of, schema))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:  # no task sums more than FAN_IN slices
        parts = -(-parts // FAN_IN)
        found = found.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("slice", "to").applyInArrow(_summed, schema)
    total = np.zeros(CELLS, np.int64)
    for r in found.collect():  # CELLS counters at most
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(zlib.decompress(r["blob"]), np.uint32)
    return np.round(4 * np.log2(1 + total)).astype(np.uint8)


def overlap(a, b, t: Fraction):
    """The least overlap of sets of sizes a and b with similarity t: ceil(t (a + b) / (1 + t))."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


def prefixes(row: np.ndarray, gram: np.ndarray, rows: int, t: Fraction, level: np.ndarray):
    """(row, n-gram, place) of the prefix n-grams in order, and each row's size."""
    rank = level[(gram & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    order = np.argsort((row.astype(np.uint64) << _BITS) | (rank << np.uint64(44)) | (gram >> np.uint64(8)), kind="stable")
    gram = gram[order]
    size = np.bincount(row, minlength=rows)[:rows].astype(np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    longest = size + (-t.numerator * size) // t.denominator + LEAST
    use = place < longest[row]
    return row[use], gram[use], place[use], size


def _sums(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def _minima(row: np.ndarray, gram: np.ndarray, size: np.ndarray):
    """For each row its bands (64 bits each) and the low bits of its bin minima: 32 bins in 8 bands from 64 n-grams on, 8 bins in 4 bands from 8 on."""
    rows = len(size)
    bins = np.where(size >= 64, 32, np.where(size >= 8, 8, 0))
    spot = np.where(size >= 64, 47, 49)[row].astype(np.uint64)
    key = row * 32 + (gram >> spot).astype(np.int64)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    first &= bins[row] > 0
    least = np.zeros((rows, 32), np.uint64)
    least[row[first], key[first] & 31] = mix(gram[first], 11) | np.uint64(1)
    band = np.zeros((rows, 8), np.uint64)
    for j in range(8):
        wide, narrow = least[:, 4 * j : 4 * j + 4], least[:, 2 * j : 2 * j + 2] if j < 4 else np.zeros((rows, 2), np.uint64)
        for part, here in ((wide, bins == 32), (narrow, bins == 8)):
            told = np.zeros(rows, np.uint64)
            for k in range(part.shape[1]):
                told = mix(told + part[:, k], 12 + k)
            use = here & part.any(1)
            band[use, j] = mix(told, 20 + j)[use] | np.uint64(1)
    width = bins[:, None] > np.arange(32)
    low = np.where(least > 0, (least >> np.uint64(49)).astype(np.int64), -1).astype(np.int16)
    return _lists(band.view(np.int64), band > 0, pa.int64()), _lists(low, width, pa.int16())


def _lists(value: np.ndarray, use: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)), pa.array(value[use], kind))


def signatures(base: DataFrame, n: int, t: Fraction, level) -> DataFrame:
    """(_row, doc_id, size, gid, cid, bands, minima) of each row that has an n-gram: its size, the hash of its prefix and size, and its class."""

    def of(batches):
        for batch in batches:
            for lo, hi, row, gram in gram_sets(batch.column(2), n):
                rows = hi - lo
                cid = _sums(mix(gram, 6), row, rows)
                prow, pgram, _, size = prefixes(row, gram, rows, t, level.value)
                cid = mix(mix(cid, 7) + size.astype(np.uint64), 8)
                gid = mix(_sums(mix(pgram, 3), prow, rows) + mix(size.astype(np.uint64), 4), 5)
                has = pa.array(np.flatnonzero(size > 0))
                columns = [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(size.astype(np.int32)), pa.array(gid.view(np.int64)), pa.array(cid.view(np.int64)), *_minima(row, gram, size)]
                yield pa.RecordBatch.from_arrays([c.take(has) for c in columns], names=["_row", "doc_id", "size", "gid", "cid", "bands", "minima"])
        trim()

    return base.mapInArrow(of, "_row bigint, doc_id bigint, size int, gid bigint, cid bigint, bands array<bigint>, minima array<smallint>")


def _clusters(classes: DataFrame) -> DataFrame:
    """(cid, root) of the classes that are gathered with another: a heuristic of the work, not of the result."""
    banded = classes.select("cid", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "lead")
    near = banded.join(leads, "band").where("cid <> lead").select("cid", "lead").distinct()
    own, its = classes.select("cid", F.col("minima").alias("a")), classes.select(F.col("cid").alias("lead"), F.col("minima").alias("b"))
    both = near.join(own, "cid").join(its, "lead")
    one = lambda c: F.when(c, 1).otherwise(0)
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: one((x == y) & (x >= 0))), F.lit(0), lambda s, x: s + x)
    told = F.aggregate(F.transform("a", lambda x: one(x >= 0)), F.lit(0), lambda s, x: s + x)
    rooted = components(both.where((F.size("a") == F.size("b")) & (same >= 0.375 * told)), "cid", "lead").select(F.col("node").alias("cid"), "root")
    return rooted.unionByName(rooted.select(F.col("root").alias("cid"), "root").distinct())


def _token(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(gram, 9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(gram: np.ndarray) -> bytes:
    """52 bits in seven bytes each."""
    return gram.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return wide.view(np.uint64).ravel()


_SPREAD = "bucket int, blob binary, cid bigint, cluster bigint, block int, blocks int, n bigint"


def _spread(n: int, t: Fraction, level, buckets: int):
    """Rows in: cid, cluster, gid, n, block, blocks, text. Out: with a bucket, the postings of prefix n-grams that hash there; without,
    the whole set of a class that shares its cluster."""

    names = ["bucket", "blob", "cid", "cluster", "block", "blocks", "n"]

    def postings(parts):
        bucket, gid, token, place, size, cluster = (np.concatenate(x) for x in zip(*parts, strict=True))
        # one record a group and bucket: groups met together that are equal collapse here
        by = np.lexsort((token, gid, bucket))
        bucket, gid, token, place, size, cluster = (x[by] for x in (bucket, gid, token, place, size, cluster))
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (bucket[1:] != bucket[:-1])
        fresh_one = new.copy()
        fresh_one[1:] |= token[1:] != token[:-1]
        bucket, gid, token, place, size, cluster, new = (x[fresh_one] for x in (bucket, gid, token, place, size, cluster, new))
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(gid))).astype(np.uint32)
        ids, blobs = [], []
        edges, hedges = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[head], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            h, e = slice(hedges[b], hedges[b + 1]), slice(edges[b], edges[b + 1])
            k = head[h]
            ids.append(int(b))
            blobs.append(b"".join((np.uint32(len(k)).tobytes(), gid[k].tobytes(), cluster[k].tobytes(), size[k].tobytes(), count[h].tobytes(), token[e].tobytes(), place[e].tobytes())))
        m = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)

    def of(batches):
        parts, held = [], 0
        for batch in batches:
            cluster, gid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            blocks = batch.column(5).to_numpy(zero_copy_only=False)
            for lo, hi, row, gram in gram_sets(batch.column(6), n):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                several = np.flatnonzero(blocks[lo:hi] > 0)
                if len(several):
                    k = pa.array(several + lo)
                    blobs = pa.array([_packed(gram[at[i] : at[i + 1]]) for i in several], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), blobs, *(batch.column(i).take(k) for i in (0, 1, 4, 5, 3))], names=names)
                prow, pgram, place, size = prefixes(row, gram, hi - lo, t, level.value)
                bucket, token = _token(pgram, buckets)
                r = prow + lo
                parts.append((bucket.astype(np.int32), gid[r], token, (place * 256 // size[prow]).astype(np.uint8), size[prow].astype(np.uint32), cluster[r]))
                held += len(r)
                if held > HELD:
                    yield postings(parts)
                    parts, held = [], 0
        if parts:
            yield postings(parts)
        trim()

    return of


def _unblob(blob: bytes):
    k = int(np.frombuffer(blob, np.uint32, 1)[0])
    at, out = 4, []
    for kind in (np.int64, np.int64, np.uint32, np.uint32):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    total = int(out[-1].sum())
    return *out, np.frombuffer(blob, np.uint32, total, at), np.frombuffer(blob, np.uint8, total, at + 4 * total)


def _meet(t: Fraction):
    """Group pairs of one bucket, of different clusters, that share n-grams where similar sets of their sizes would: how many they share here, and how many they must."""

    def of(table: pa.Table) -> pa.Table:
        parts = [_unblob(b.as_py()) for b in table["blob"]]
        every, cluster_of, size_of, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        groups, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        size, cluster = size_of[first].astype(np.int64), np.unique(cluster_of[first], return_inverse=True)[1]
        token, place = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
        who = np.repeat(inverse, count)
        by = np.lexsort((who, token))
        token, who, place = token[by], who[by], place[by]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
        token, who, place = token[new], who[new], place[new]
        # runs of a token, in them segments of a cluster by their least size
        by = np.lexsort((cluster[who], token))
        token, who, place = token[by], who[by], place[by]
        edge = np.ones(len(token), bool)
        edge[1:] = (token[1:] != token[:-1]) | (cluster[who][1:] != cluster[who][:-1])
        starts = np.flatnonzero(edge)
        lengths = np.diff(np.append(starts, len(token)))
        smallest = np.minimum.reduceat(size[who], starts) if len(starts) else np.zeros(0, np.int64)
        by = np.lexsort((np.repeat(starts, lengths), np.repeat(smallest, lengths), token))
        token, who, place, smallest = token[by], who[by], place[by], np.repeat(smallest, lengths)[by]
        n = len(token)
        run_edge, edge = np.ones(n, bool), np.ones(n, bool)
        run_edge[1:] = token[1:] != token[:-1]
        edge[1:] = run_edge[1:] | (cluster[who][1:] != cluster[who][:-1])
        after = lambda e: np.repeat(np.append(np.flatnonzero(e)[1:], n), np.diff(np.append(np.flatnonzero(e), n))) if n else np.zeros(0, np.int64)
        segment_end, run_end, run = after(edge), after(run_edge), np.cumsum(run_edge) - 1
        most = size[who] * t.denominator // t.numerator
        top = int(max(smallest.max(initial=0), most.max(initial=0))) + 1
        reach = np.searchsorted(run * top + smallest, run * top + most, "right")
        partners = np.maximum(np.minimum(reach, run_end) - segment_end, 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            if not found:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            value, inverse = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            return value, np.bincount(inverse, np.concatenate([c for _, c in found]), len(value)).astype(np.int64)

        held, i, edges = 0, 0, np.concatenate([[0], np.cumsum(partners)])
        while i < n:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + PAIRS, "right")) - 1)
            k = partners[i:j]
            if k.sum():
                a = np.repeat(np.arange(i, j), k)
                b = np.repeat(segment_end[i:j] - (edges[i:j] - edges[i]), k) + np.arange(len(a))
                x, y = who[a], who[b]
                need = overlap(size[x], size[y], t)
                fits = (need <= np.minimum(size[x], size[y])) & (place[a].astype(np.int64) * size[x] <= 256 * (size[x] - need + LEAST - 1)) & (place[b].astype(np.int64) * size[y] <= 256 * (size[y] - need + LEAST - 1))
                x, y = x[fits], y[fits]
                found.append(np.unique(np.minimum(x, y).astype(np.uint64) * np.uint64(len(groups)) + np.maximum(x, y).astype(np.uint64), return_counts=True))
                held += len(found[-1][0])
                if held > 4 * PAIRS:
                    found[:] = [fold()]
                    held = len(found[0][0])
            i = j
        pair, shared = fold()
        x, y = (pair // np.uint64(len(groups) or 1)).astype(np.int64), (pair % np.uint64(len(groups) or 1)).astype(np.int64)
        must = np.minimum(LEAST, overlap(size[x], size[y], t))
        del found, who, place, token, partners, reach
        trim()
        return pa.table({"ga": groups[x], "gb": groups[y], "n": shared.astype(np.int32), "must": must.astype(np.int32)})

    return of


_FOUND = "cid bigint, links bigint, root bigint"


def _verify(t: Fraction):
    """Rows in: cluster, low, high, side, cid, n, blob. A cell (cluster, low, high) is verified on whole sets: every pair where low = high, else every pair
    of the two sides. Out: for each class with a link here, the documents of those that it is linked with, and the least class that it is connected with.
    """

    def cell(cid, n, side, sets, within):
        left = np.arange(len(sets)) if within else np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        size = np.array([len(s) for s in sets])
        gram = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), size)
        by = np.argsort(gram, kind="stable")
        gram, who = gram[by], who[by]
        edge = np.ones(len(gram), bool)
        edge[1:] = gram[1:] != gram[:-1]
        count = np.diff(np.append(np.flatnonzero(edge), len(gram)))
        several = np.repeat(count > 1, count)  # an n-gram that one set alone has joins nothing
        column = (np.cumsum(np.repeat(count > 1, count) & edge) - 1)[several]
        who = who[several]
        shared = np.zeros((len(left), len(right)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        step = max(256, (4 << 20) // len(sets))
        for c in range(0, width, step):
            i, j = np.searchsorted(column, (c, c + step))
            m = np.zeros((len(sets), min(step, width - c)), np.float32)
            m[who[i:j], column[i:j] - c] = 1
            shared += m[left] @ m[right].T
        shared = shared.astype(np.int64)
        linked = shared * t.denominator >= t.numerator * (size[left][:, None] + size[right][None] - shared)
        if within:
            np.fill_diagonal(linked, False)
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        links[left] = linked @ n[right]
        if not within:
            links[right] = linked.T @ n[left]
        while True:  # the least place that each set is connected with
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(linked, root[right][None], len(sets)).min(1, initial=len(sets)))
            root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], len(sets)).min(0, initial=len(sets)))
            if (before == root).all():
                break
        use = links > 0
        return cid[use], links[use], cid[root[use]]

    def of(table: pa.Table) -> pa.Table:
        cluster, low, high, side, cid, n = (table[c].to_numpy() for c in ("cluster", "low", "high", "side", "cid", "n"))
        by = np.lexsort((cid, side, high, low, cluster))
        new = np.ones(len(by), bool)
        key = np.stack([x[by] for x in (cluster, low, high)])
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        once = new.copy()
        once[1:] |= (cid[by][1:] != cid[by][:-1]) | (side[by][1:] != side[by][:-1])  # a row that is repeated as a whole comes several times
        start = np.flatnonzero(new)
        blobs = table["blob"]
        out = []
        for a, b in zip(start, np.append(start[1:], len(by)), strict=True):
            rows = by[a:b][once[a:b]]
            if len(rows) > 1:
                out.append(cell(cid[rows], n[rows], side[rows], [_unpacked(blobs[int(i)].as_py()) for i in rows], low[rows[0]] == high[rows[0]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        trim()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("cid", "links", "root"), columns, strict=True)})

    return of


def _sets(chosen: DataFrame, n: int) -> DataFrame:
    """(cid, blob): the whole set of each row of (cid, text)."""

    def of(batches):
        for batch in batches:
            for lo, hi, row, gram in gram_sets(batch.column(1), n):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_packed(gram[at[i] : at[i + 1]]) for i in range(hi - lo)], pa.binary())], names=["cid", "blob"])

    return chosen.mapInArrow(of, "cid bigint, blob binary")


def similar(docs: DataFrame, n: int = 2, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (_row, doc_id, cid) of each row of docs that has an n-gram; and (cid, n, links, root) of each
    class of equal sets: its documents, those of the classes that it is linked with, and the least class that it is connected with.

    _row is a key over doc_id and text; both results are in the shared folder.
    """
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    base = docs.select(row_key("doc_id", "text").alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    level = spark.sparkContext.broadcast(levels(base, n))  # CELLS bytes at any size of the corpus
    members = cut(signatures(base, n, t, level))
    classes = cut(members.groupBy("cid").agg(F.min("_row").alias("rep"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("size", "gid", "bands", "minima"))))
    gathered = _clusters(classes)
    crowd = gathered.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = gathered.join(crowd, "root").select("cid", F.col("root").alias("cluster"), "blocks", F.pmod(F.hash("cid"), F.col("blocks")).alias("block"))
    cluster = F.coalesce("cluster", "cid")
    sorted_out = cut(
        classes.join(placed, "cid", "left").select("cid", "rep", "n", "size", cluster.alias("cluster"), F.xxhash64("gid", cluster).alias("gid"), F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    )
    grams, several = sorted_out.agg(F.sum("size"), F.sum(F.when(F.col("blocks") > 0, F.col("size") * F.col("blocks")))).first()
    buckets = max(32, int((grams or 0) * (1 - t) // BUCKET))
    text = base.select(F.col("_row").alias("rep"), "text")
    chosen = sorted_out.select("rep", "cid", "cluster", "gid", "n", "block", "blocks").join(text, "rep").select("cid", "cluster", "gid", "n", "block", "blocks", "text")
    spread = cut(chosen.mapInArrow(_spread(n, t, level, buckets), _SPREAD))
    # within clusters: block by block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = spread.where("bucket is null").select("cluster", "block", "cid", "n", "blob", other.alias("o"))
    cells = cells.select("cluster", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), F.when(F.col("block") > F.col("o"), 1).otherwise(0).alias("side"), "cid", "n", "blob")
    within = _verified(cells, t, int((several or 0) // 2_000_000))
    # between clusters: groups that share enough of their prefixes
    met = spread.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet(t), "ga bigint, gb bigint, n int, must int")
    pairs = cut(met.groupBy("ga", "gb").agg(F.sum("n").alias("n"), F.max("must").alias("must")).where("n >= must").select("ga", "gb"))
    side = lambda g, c, r, m: sorted_out.select(F.col("gid").alias(g), F.col("cid").alias(c), F.col("rep").alias(r), F.col("n").alias(m))
    expanded = cut(pairs.join(side("ga", "a", "ra", "na"), "ga").join(side("gb", "b", "rb", "nb"), "gb").select("a", "b", "ra", "rb", "na", "nb"))
    # a class and those it is to be verified with, in blocks
    many = expanded.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    high = expanded.join(many, "a").withColumn("high", F.pmod(F.hash("b"), F.col("blocks")) + 1)
    ends = high.select(F.col("a").alias("cluster"), "high", F.lit(0).alias("side"), F.col("a").alias("cid"), F.col("na").alias("n")).distinct().unionByName(high.select(F.col("a").alias("cluster"), "high", F.lit(1).alias("side"), F.col("b").alias("cid"), F.col("nb").alias("n")))
    wanted = expanded.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("ra").alias("rep")), F.struct(F.col("b").alias("cid"), F.col("rb").alias("rep")))).alias("x")).select("x.cid", "x.rep").distinct()
    number = expanded.count()
    if number <= FEW:  # at most 2 FEW keys: the texts stay where they are
        wanted = F.broadcast(wanted)
    sets = _sets(text.join(wanted, "rep").select("cid", "text"), n)
    between = _verified(ends.join(sets, "cid").select("cluster", F.lit(0).alias("low"), "high", "side", "cid", "n", "blob"), t, number // 4_000)
    found = cut(within.unionByName(between))
    roots = components(found, "cid", "root").select(F.col("node").alias("cid"), "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = sorted_out.select("cid", "n").join(links, "cid", "left").join(roots, "cid", "left")
    return members.select("_row", "doc_id", "cid"), cut(told.select("cid", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")))


def _verified(cells: DataFrame, t: Fraction, buckets: int) -> DataFrame:
    by = F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(max(32, buckets))).cast("int").alias("bucket")
    return cells.select(by, "*").groupBy("bucket").applyInArrow(_verify(t), _FOUND)


def join_documents(docs: DataFrame, n: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of each row of docs: the least doc_id of the documents that it is connected with by
    similarities of at least threshold, itself among them (null only where all are); how many other rows have the same set of
    n-grams; and how many rows of other sets it is linked with. A row without an n-gram has its own doc_id, 0 and 0.
    """
    members, classes = similar(docs, n, threshold)
    named = members.groupBy("cid").agg(F.min("doc_id").alias("least")).join(classes, "cid")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    told = cut(named.join(least, "root").select("cid", "class_id", (F.col("n") - 1).alias("n_copies"), F.col("links").alias("n_links")))
    linked = members.join(told, "cid").select("doc_id", "class_id", "n_copies", "n_links")
    base = docs.select(row_key("doc_id", "text").alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    none = base.join(members.select("_row"), "_row", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(none)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of each node of the undirected edges but the roots: the least node that it is connected with. Alternates
    large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def groups(docs: DataFrame, n: int = 2, threshold: float = 0.7) -> DataFrame:
    """(_row, root, stays) of each distinct row that has an n-gram: documents linked by similarity share a root; the row with
    the least doc_id of each (of equals: the least key; null last) stays.
    """
    members, classes = similar(docs, n, threshold)
    rooted = members.join(classes.select("cid", "root"), "cid").select("_row", "doc_id", "root")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row")
    first = rooted.groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first._row").alias("keeper"))
    return rooted.join(first, "root").select("_row", "root", (F.col("_row") == F.col("keeper")).alias("stays"))


def deduplicate(docs: DataFrame, n: int = 2, threshold: float = 0.7) -> DataFrame:
    """docs without all but one document of each group of similar ones; of rows that share doc_id and text one stays.
    Rows without an n-gram stay.
    """
    grouped = groups(docs, n, threshold)
    row, told = fresh(docs, "row"), fresh(docs, "told")
    gone = cut(grouped.groupBy(F.col("_row").alias(row)).agg(F.when(F.first("stays"), F.when(F.count(F.lit(1)) > 1, 1).otherwise(0)).otherwise(2).alias(told)).where(f"`{told}` > 0"))
    # a key is listed if its rows go (2), or if all but one of them do (1)
    keyed = docs.withColumn(row, row_key("doc_id", "text")).join(gone, row, "left")
    kept = keyed.where(F.col(told).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    again = keyed.where(F.col(told) == 1).dropDuplicates([row]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(again)
