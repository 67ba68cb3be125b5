"""Token counts without token ids: pieces are counted once per distinct pre-token.

Documents are read in blocks (runs of rows of one Arrow batch, of about BLOCK_BYTES), and the blocks of a task in chunks of about CHUNK_BYTES. A block
gives, for each document, the frequencies of its pre-tokens as places in the vocabulary of its chunk. Pre-tokens that are a piece of the
tokenizer themselves count 1 and stay; the others go to buckets by their hash; so
each distinct one of the corpus is met in one bucket only, and is split to pieces there, once. The counts go back
to the chunks, where they are joined to the frequencies and summed. No id is made.

Defined cases: a null text has the count null, an empty one 0; texts of any length are counted whole; special tokens
are ordinary text; rows that are repeated are counted each; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 128 << 20
#: Bytes of text to a bucket of pre-tokens, which holds about one byte in fifty of them.
BUCKET_BYTES = 1 << 30
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(raw: bytes, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})


def _blocks(batch: pa.RecordBatch, at: int):
    """(first row, end row) of runs of about BLOCK_BYTES."""
    column = batch.column(at)
    if not len(column):
        return
    size = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0)))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        yield lo, hi
        lo = hi


def _squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _frequencies(raw: bytes, pattern: str, buckets: int):
    """Two kinds of rows: those of bucket -1 hold a block's frequencies, the others a chunk's pre-tokens that belong to one bucket."""

    def vocabulary(chunk: int, place: dict[str, int], single: dict[bytes, int]):
        words = [(i, w) for i, w in enumerate(w.encode() for w in place) if w not in single]
        where, raw = np.array([i for i, _ in words], np.uint32), [w for _, w in words]
        home = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            mine = order[edges[b] : edges[b + 1]]
            yield chunk, int(b), [_squeeze(where[mine]), _squeeze(np.array([len(raw[k]) for k in mine], np.uint32)), zlib.compress(b"".join([raw[k] for k in mine]), 1)]

    def of(batches):
        import uuid

        import pyarrow.compute  # noqa: F401
        import regex

        split, single = regex.compile(pattern).findall, _ranks(raw)
        chunk, held, place = uuid.uuid4().int >> 65, 0, {}
        for batch in batches:
            for lo, hi in _blocks(batch, 1):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                ids, freq, count = [], [], []
                for t in texts:
                    if not t:
                        count.append(0)
                        continue
                    held += len(t)
                    found = Counter(split(t))
                    ids.extend([place.setdefault(w, len(place)) for w in found])
                    freq.extend(found.values())
                    count.append(len(found))
                i, f = np.array(ids, np.uint32), np.array(freq, np.uint32)
                null = np.array([t is None for t in texts], bool)
                doc = batch.column(0).slice(lo, hi - lo)
                big = np.flatnonzero(f > 255)
                parts = (
                    np.asarray(doc.fill_null(0)).astype(np.int64), np.asarray(doc.is_null()), null, np.array(count, np.uint32),
                    (i & 0xFFFF).astype(np.uint16), (i >> 16).astype(np.uint16), np.minimum(f, 255).astype(np.uint8), big.astype(np.uint64), f[big],
                )
                yield chunk, -1, [_squeeze(p) for p in parts]
                if held > CHUNK_BYTES:
                    yield from vocabulary(chunk, place, single)
                    chunk, held, place = uuid.uuid4().int >> 65, 0, {}
        yield from vocabulary(chunk, place, single)

    def rows(batches):
        for block, bucket, parts in of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], names=["block", "bucket", "parts"])

    return rows


def _count(raw: bytes, pattern: str):
    def of(table: pa.Table) -> pa.Table:
        enc = encoding(raw, pattern)
        pieces = enc._core_bpe.encode_single_piece
        known: dict[bytes, int] = {}
        blocks, out = [], []
        for block, parts in zip(table["block"].to_pylist(), table["parts"].to_pylist(), strict=True):
            place, size = (np.frombuffer(zlib.decompress(p), np.uint32) for p in parts[:2])
            text, end = zlib.decompress(parts[2]), np.cumsum(size).tolist()
            n, start = [], 0
            for e in end:
                w = text[start:e]
                start = e
                c = known.get(w)
                if c is None:
                    c = known[w] = len(pieces(w))
                n.append(c)
            blocks.append(block)
            out.append([_squeeze(place), _squeeze(np.array(n, np.uint32))])
        return pa.table({"block": pa.array(blocks, pa.int64()), "parts": pa.array(out, pa.list_(pa.binary()))})

    return of


def _sum(own: pa.Table, told: pa.Table) -> pa.Table:
    ids, nulls, counts, totals = [], [], [], []
    answers: dict[int, list] = {}
    for block, parts in zip(told["block"].to_pylist(), told["parts"].to_pylist(), strict=True):
        answers.setdefault(block, []).append([np.frombuffer(zlib.decompress(p), np.uint32) for p in parts])
    for block, parts in zip(own["block"].to_pylist(), own["parts"].to_pylist(), strict=True):
        kinds = (np.int64, bool, bool, np.uint32, np.uint16, np.uint16, np.uint8, np.uint64, np.uint32)
        doc, no_doc, no_text, count, low, high, freq, big, large = (np.frombuffer(zlib.decompress(p), k) for p, k in zip(parts, kinds, strict=True))
        at = low.astype(np.int64) | (high.astype(np.int64) << 16)
        told = answers.get(block, [])
        n = np.ones(1 + max(int(at.max(initial=0)), *(int(p.max()) for p, _ in told), 0), np.int64)  # a piece by itself, unless told otherwise
        for place, pieces in told:
            n[place] = pieces
        f = freq.astype(np.int64)
        f[big.astype(np.int64)] = large
        total = np.concatenate([[0], np.cumsum(n[at] * f)])
        edge = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
        ids.append(doc)
        nulls.append(no_doc)
        counts.append(total[edge[1:]] - total[edge[:-1]])
        totals.append(no_text)
    cat = lambda x, k: np.concatenate(x) if x else np.zeros(0, k)
    return pa.table({"doc_id": pa.array(cat(ids, np.int64), pa.int64(), mask=cat(nulls, bool)), "n_tokens": pa.array(cat(counts, np.int64), pa.int64(), mask=cat(totals, bool))})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs. tokenizer: a ranks file, read by the driver."""
    from citeflow.llm.common import cut

    with open(tokenizer, "rb") as f:
        raw = f.read()
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size // BUCKET_BYTES))
    # written once: the blocks' names are drawn at random, so both uses must see the same rows
    found = cut(base.mapInArrow(_frequencies(raw, pattern, buckets), "block bigint, bucket int, parts array<binary>"))
    answers = found.where("bucket >= 0").groupBy("bucket").applyInArrow(_count(raw, pattern), "block bigint, parts array<binary>")
    own = found.where("bucket < 0").select("block", "parts")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum, "doc_id bigint, n_tokens bigint")
