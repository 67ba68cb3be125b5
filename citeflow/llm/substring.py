"""Substring deduplication with a log-structured fingerprint index.

A passage is a window of WINDOW words (runs of bytes without ASCII white space). Every window that has
occurred before, in the order of (doc_id, row key, position), is repeated, and every word that a
repeated window covers is removed. So any stretch of WINDOW or more words stays only where it comes first.

A window's fingerprint is the least of the hashes of the GRAM-word runs within it. Equal windows have equal
fingerprints, and a document has about one fingerprint in 13 words. The index keeps them as immutable runs: Parquet
tables in the shared folder, bucketed and sorted by fingerprint. Each new batch becomes a run, which is merge-joined
with the older runs, bucket by bucket, without moving them; more than FANOUT runs of one size are merged to one of the next, so that a
row is rewritten as often as the index has sizes. Only documents that hold a fingerprint met twice are then verified: their windows with
such a fingerprint are compared by the fingerprint and an independent 64-bit hash of all words of the window.

An index with a folder of its own is kept: deduplicate(batch, index=...) cuts from the batch what the batch itself or any earlier one
holds, and adds it. Such an index keeps the texts of its batches too (window hashes would be larger), of which a later call reads those that share a fingerprint
with the new batch. A manifest names its runs and texts; it is replaced as a whole, so a call that breaks off leaves the index as it was.

Defined cases: null, empty and short texts (under WINDOW words) have no window and stay as they are; rows that share
doc_id and text count as one document and are treated alike; null doc_ids come first in the order; an empty table gives
an empty result; a text that is removed as a whole leaves no row; other columns pass through. Rows are told apart by a 64-bit key.
With an index, all of its rows come before the batch's, in the order in which batches came.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.common import NOT_SPACE, chunks, cut, fresh, mix, row_key, shared_dir, trim, word_hashes, words

WINDOW = 50
GRAM = 25
FANOUT = 2
#: Runs of fewer rows count as of this size.
LEAST_RUN = 1_000_000
_STEP = 0xC2B2AE3D27D4EB4F
_STEP_INV = pow(_STEP, -1, 1 << 64)
_PART = 8 << 20


def _rolling(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k values from each place on; the last k - 1 places have none."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = np.full(n, _STEP, np.uint64), np.full(n, _STEP_INV, np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h, salt) * np.cumprod(up, dtype=np.uint64), out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * np.cumprod(down, dtype=np.uint64)[: n - k + 1], salt + 1)


def windows(data: np.ndarray, at: np.ndarray):
    """(row, place in the row, fingerprint, hash) of each window, and each row's words' starts and first word."""
    start, end, first = words(data, at, NOT_SPACE)
    h = word_hashes(data, start, end)
    count = np.diff(first)
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), start, first
    row = np.repeat(np.arange(len(count)), count)
    whole = _rolling(h, WINDOW, 21)
    gram = _rolling(h, GRAM, 31)
    least, span = gram, 1
    width = WINDOW - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    n = len(whole)
    ok = np.flatnonzero(row[:n] == row[WINDOW - 1 : WINDOW - 1 + n])
    r = row[ok]
    return r, ok - first[r], least[ok], whole[ok], start, first


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, row, n): each row's distinct fingerprints; n is 2 where the row itself repeats a window, else 1."""

    def of(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                r, _, fp, h, _, _ = windows(data, at)
                packed = (r.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
                order = np.argsort(packed)
                twice = np.zeros(len(r), bool)
                same = packed[order][1:] == packed[order][:-1]
                twice[order[1:][same]] = True
                by = np.lexsort((~twice, fp, r))
                r, fp, twice = r[by], fp[by], twice[by]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (fp[1:] != fp[:-1])
                key = batch.column(0).slice(lo, hi - lo).take(pa.array(r[new]))
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), key, pa.array(twice[new].astype(np.int32) + 1)], names=["fp", "row", "n"])
        trim()

    return docs.select("_row", "text").mapInArrow(of, "fp bigint, row bigint, n int")


class FingerprintIndex:
    """Sorted immutable runs of (fp, row, n) in the shared folder, or in `root`, where they and the batches' texts stay."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.kept = spark, root is not None
        self.root = root.rstrip("/") if root else f"{shared_dir(spark).rstrip('/')}/fingerprints-{uuid.uuid4().hex}"
        found = self._read() if self.kept else None
        self.buckets = found["buckets"] if found else buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        #: [name, rows] of each run, and the names of the texts.
        self.runs: list[list] = found["runs"] if found else []
        self.texts: list[str] = found["texts"] if found else []
        for name, _ in self.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, row BIGINT, n INT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self) -> dict | None:
        fs, path = self._fs("manifest")
        return json.loads(self.spark.read.text(str(path)).first()[0]) if fs.exists(path) else None

    def commit(self) -> None:
        """Makes the runs and texts that are held now the index that a later call opens; older ones go."""
        fs, path = self._fs("manifest")
        before = self._read()
        _, draft = self._fs(f"draft-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(json.dumps({"buckets": self.buckets, "runs": self.runs, "texts": self.texts}),)], "value string").coalesce(1).write.text(str(draft))
        fs.delete(path, True)
        if not fs.rename(draft, path):
            raise OSError(f"{draft} cannot be renamed to {path}")
        for name, _ in before["runs"] if before else []:
            if name not in [n for n, _ in self.runs]:
                self._drop(name)

    def _write(self, df: DataFrame) -> list:
        name = f"citeflow_run_{uuid.uuid4().hex}"
        laid = df.repartition(self.buckets, "fp").sortWithinPartitions("fp")
        laid.write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return [name, self.spark.table(name).count()]

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, path = self._fs(name)
        fs.delete(path, True)

    def add(self, batch: DataFrame) -> DataFrame:
        """Appends a batch as a run; (fp) of the batch that it, or it and an older run, holds twice."""
        run = self._write(batch)
        new = self.spark.table(run[0]).groupBy("fp").agg(F.sum("n").alias("n"))
        hits = new.where("n > 1").select("fp")
        once = new.where("n = 1").select("fp")
        for name, _ in self.runs:
            hits = hits.unionByName(once.join(self.spark.table(name).select("fp"), "fp", "left_semi"))
        hits = cut(hits.distinct())
        self.runs.append(run)
        return hits

    def compact(self) -> None:
        """Merges the runs of one size, where there are more than FANOUT, to one; sizes grow by FANOUT + 1."""
        while True:
            tiers: dict[int, list[list]] = {}
            for run in self.runs:
                tiers.setdefault(int(math.log(max(run[1], LEAST_RUN), FANOUT + 1)), []).append(run)
            full = next((t for _, t in sorted(tiers.items()) if len(t) > FANOUT), None)
            if full is None:
                return
            merged = self._write(self._union(full))
            self.runs = [r for r in self.runs if r not in full] + [merged]
            if not self.kept:  # what the manifest names goes with the next manifest
                for name, _ in full:
                    self._drop(name)

    def _union(self, runs: list[list]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.table(name) for name, _ in runs))

    def rows(self) -> DataFrame:
        return self._union(self.runs)

    def history(self) -> DataFrame | None:
        """(_row, text) of the batches before."""
        return self.spark.read.parquet(*(f"{self.root}/{t}" for t in self.texts)) if self.texts else None

    def remember(self, base: DataFrame) -> None:
        name = f"texts-{uuid.uuid4().hex}"
        base.select("_row", "text").write.parquet(f"{self.root}/{name}")
        self.texts.append(name)

    def close(self) -> None:
        """Drops an index that is not kept."""
        if not self.kept:
            for name, _ in self.runs:
                self._drop(name)
            self.runs = []


_NAMES = ["bucket", "blob", "row", "pos", "mask"]


def _records(batches, buckets: int):
    """Rows in: _row, doc_id, text, fps. Out: (bucket, blob) of the windows to be verified, and (row, pos, mask), without a bucket, of those that come again here."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def out():
        nonlocal held, size
        doc, key, pos, fp, h = (np.concatenate(x) for x in zip(*held, strict=True))
        held, size = [], 0
        # rows that are repeated as a whole meet themselves: such equals are one window
        by = np.lexsort((pos, key, doc, h, fp))
        again = np.zeros(len(by), bool)
        again[by[1:]] = np.logical_and.reduce([x[by][1:] == x[by][:-1] for x in (fp, h, doc, key, pos)])
        doc, key, pos, fp, h = (x[~again] for x in (doc, key, pos, fp, h))
        # a window that comes earlier in this part of the corpus is repeated; only first ones go on with their hash
        by = np.lexsort((pos, key, doc, h, fp))
        new = np.ones(len(by), bool)
        new[1:] = (fp[by][1:] != fp[by][:-1]) | (h[by][1:] != h[by][:-1])
        first = np.zeros(len(by), bool)
        first[by[new]] = True
        edge = np.ones(len(fp), bool)
        edge[1:] = (fp[1:] != fp[:-1]) | (pos[1:] != pos[:-1] + 1) | (key[1:] != key[:-1])
        head = np.flatnonzero(edge)
        inside = np.arange(len(fp)) - np.repeat(head, np.diff(np.append(head, len(fp))))
        head = np.flatnonzero(inside % 32 == 0)
        record = np.cumsum(inside % 32 == 0) - 1
        bit = (np.uint64(1) << (inside % 32).astype(np.uint64)).astype(np.uint64)
        mask = np.zeros(len(head), np.uint64)
        np.bitwise_or.at(mask, record[~first], bit[~first])
        some = np.bincount(record, first, len(head)) > 0
        # what is known to be repeated needs no bucket: only records with a first window do
        told = pa.RecordBatch.from_arrays([pa.nulls(n := int((mask > 0).sum()), pa.int32()), pa.nulls(n, pa.binary()), pa.array(key[head][mask > 0]), pa.array(pos[head][mask > 0].astype(np.int32)), pa.array(mask[mask > 0].astype(np.int64))], names=_NAMES)
        count = np.where(some, np.diff(np.append(head, len(fp))), 0)
        fp, key, doc, pos, mask = fp[head][some], key[head][some], doc[head][some], pos[head][some], mask[some]
        hs, count = h[some[record]], count[some].astype(np.uint8)
        bucket = ((mix(fp, 41) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ids, blobs = [], []
        for b in np.flatnonzero(np.diff(edges)):
            k = order[edges[b] : edges[b + 1]]
            n = count[k].astype(np.int64)
            at = np.repeat(starts[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            ids.append(int(b))
            blobs.append(b"".join((np.uint32(len(k)).tobytes(), fp[k].tobytes(), key[k].tobytes(), doc[k].tobytes(), pos[k].astype(np.uint32).tobytes(), mask[k].astype(np.uint32).tobytes(), count[k].tobytes(), hs[at].tobytes())))
        m = len(ids)
        return told, pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=_NAMES)

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        docs = batch.column(1).fill_null(_NULL).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        flat, edges = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        for lo, hi, data, at in chunks(batch.column(2)):
            r, pos, fp, h, _, _ = windows(data, at)
            mine = flat[edges[lo] : edges[hi]]
            owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(edges[lo : hi + 1]))
            known = np.unique((owner << np.uint64(52)) | (mine >> np.uint64(12)))
            probe = (r.astype(np.uint64) << np.uint64(52)) | (fp >> np.uint64(12))
            spot = np.minimum(np.searchsorted(known, probe), max(len(known) - 1, 0))
            use = known[spot] == probe if len(known) else np.zeros(len(probe), bool)
            if use.any():
                held.append((docs[lo:hi][r[use]], keys[lo:hi][r[use]], pos[use], fp[use], h[use]))
            size += len(data)
            if size > _PART and held:
                yield from out()
    if held:
        yield from out()
    trim()


def _decide(table: pa.Table) -> pa.Table:
    """(row, pos, mask): bit i of mask says that the row's window at pos + i is repeated."""
    parts = []
    for b in table["blob"]:
        blob, at, got = b.as_py(), 4, []
        k = int(np.frombuffer(blob, np.uint32, 1)[0])
        for kind in (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint8):
            got.append(np.frombuffer(blob, kind, k, at))
            at += got[-1].nbytes
        parts.append((*got, np.frombuffer(blob, np.uint64, -1, at)))
    fp, row, doc, pos, mask, count, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = count.astype(np.int64)
    record = np.repeat(np.arange(len(fp)), n)
    inside = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    mask = mask.copy()
    whose = ((mask[record] >> inside.astype(np.uint32)) & np.uint32(1)) == 0  # those that are known already do not compete
    record, inside, h = record[whose], inside[whose], h[whose]
    place = pos[record].astype(np.int64) + inside
    by = np.lexsort((place, row[record], doc[record], h, fp[record]))
    new = np.ones(len(by), bool)
    f = fp[record][by]
    new[1:] = (f[1:] != f[:-1]) | (h[by][1:] != h[by][:-1])
    later = by[~new]
    # rows that are repeated as a whole meet themselves: such equals are one window
    owner = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))[~new]
    itself = (row[record][by[owner]] == row[record][later]) & (place[by[owner]] == place[later])
    later = later[~itself]
    np.bitwise_or.at(mask, record[later], (np.uint32(1) << inside[later].astype(np.uint32)).astype(np.uint32))
    trim()
    use = mask > 0  # what was told before is told again: masks are joined
    return pa.table({"row": row[use], "pos": pos[use].astype(np.int32), "mask": mask[use].astype(np.int64)})


def _ranges(docs: DataFrame, batches: int) -> list[Column]:
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or batches < 2:
        return [F.lit(True)]
    edges = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    last = [F.coalesce(F.col("doc_id") < edges[0], F.lit(True)), *((F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in zip(edges, edges[1:], strict=False))]
    return [*last, F.col("doc_id") >= edges[-1]]


#: The places, in the order of rows, of those of an index and of null doc_ids.
_BEFORE, _NULL = -(1 << 63), -(1 << 63) + 1


def repeated_windows(docs: DataFrame, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """(row, marks): for each row key of docs that has repeated windows, the (pos, mask) that hold them, in order.

    docs goes into the index in batches by ranges of doc_id; the number of batches does not change the result. A given index is added to.
    """
    spark = docs.sparkSession
    base = docs.select(row_key("doc_id", "text").alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = index or FingerprintIndex(spark)
    try:
        hits, history = None, own.history()
        for part in _ranges(base, batches):
            found = own.add(fingerprints(base.where(part)))
            hits = found if hits is None else hits.unionByName(found)
            own.compact()
        lists = cut(own.rows().join(hits.distinct(), "fp", "left_semi").groupBy("row").agg(F.collect_set("fp").alias("fps")).withColumnRenamed("row", "_row"))
        if own.kept:
            own.remember(base)
            own.commit()
    finally:
        own.close()
    known = lists.agg(F.sum(F.size("fps").cast("bigint"))).first()[0] or 0
    buckets = int(max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), known // 200_000))
    rows = base.select("_row", F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "text")
    if history is not None:
        rows = rows.unionByName(history.select("_row", F.lit(_BEFORE).cast("bigint").alias("doc_id"), "text"))
    chosen = rows.join(lists, "_row").select("_row", "doc_id", "text", "fps")
    records = cut(chosen.mapInArrow(lambda it: _records(it, buckets), "bucket int, blob binary, row bigint, pos int, mask bigint"))
    met = records.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_decide, "row bigint, pos int, mask bigint")
    marks = met.unionByName(records.where("bucket is null").select("row", "pos", "mask")).groupBy("row", "pos").agg(F.bit_or("mask").alias("mask"))
    marks = marks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("marks"))
    if history is not None:  # what the index holds is not judged again
        marks = marks.join(base.select(F.col("_row").alias("row")).distinct(), "row", "left_semi")
    return cut(marks)


def _spans(marks) -> list[list[int]]:
    """Merged [first word, end word) of the windows in a row's marks."""
    out: list[list[int]] = []
    for m in marks:
        pos, mask, i = m["pos"], m["mask"], 0
        while mask >> i:
            if mask >> i & 1:
                a = pos + i
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], a + WINDOW)
                else:
                    out.append([a, a + WINDOW])
            i += 1
    return out


def repeated_spans(docs: DataFrame, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, start_word, end_word) of each maximal stretch of words, from 0 and end excluded, that repeats
    what comes earlier. Rows repeated as a whole give their stretches once each.
    """
    marks = repeated_windows(docs, batches, index)

    def of(batches):
        for batch in batches:
            keys, starts, ends = [], [], []
            for key, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in _spans(m):
                    keys.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["_row", "start_word", "end_word"])

    spans = marks.mapInArrow(of, "_row bigint, start_word int, end_word int")
    ids = docs.select(row_key("doc_id", "text").alias("_row"), "doc_id")
    return ids.join(spans, "_row").select("doc_id", "start_word", "end_word")


def _cut_text(text: pa.Array, marks: pa.Array) -> pa.Array:
    """Texts without the words that marks cover; a null mark leaves the text as it is."""
    out: list[str | None] = []
    told = marks.to_pylist()
    for lo, _, data, at in chunks(text):
        start, _, first = words(data, at, NOT_SPACE)
        for i in range(len(at) - 1):
            m = told[lo + i]
            if m is None:
                out.append(text[lo + i].as_py())
                continue
            mine, raw = start[first[i] : first[i + 1]], data[at[i] : at[i + 1]]
            keep = np.ones(len(raw), bool)
            for a, b in _spans(m):
                keep[mine[a] - at[i] : (mine[b] - at[i]) if b < len(mine) else len(raw)] = False
            left = raw[keep].tobytes().decode("utf-8", "replace")
            out.append(left if left.strip() else "")
    return pa.array(out, pa.string())


def deduplicate(docs: DataFrame, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """docs with repeated stretches cut from text, and n_chars, where there is one, counted anew; rows of which nothing is left go."""
    row, marked = fresh(docs, "row"), fresh(docs, "marks")
    marks = repeated_windows(docs, batches, index).select(F.col("row").alias(row), F.col("marks").alias(marked))
    joined = docs.withColumn(row, row_key("doc_id", "text")).join(marks, row, "left")
    has = F.col(marked).isNotNull()
    cutting = F.arrow_udf(_cut_text, "string")
    done = joined.withColumn("text", F.when(has, cutting(F.col("text"), F.col(marked))).otherwise(F.col("text"))).where(~has | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))
