"""Language identification by string kernels.

A text is folded to an alphabet of 64 signs (letters, one sign for everything between words, and the bytes of
characters beyond ASCII). The kernel of two texts is the blended spectrum over n-gram lengths 1..MAX_N of presence:
sum over n of |G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|), where G_n holds the distinct n-grams of a whole text. LANDMARKS
labelled texts span a Nyström approximation, in which a one-versus-rest kernel ridge regression is fitted on a bounded
sample of labelled rows (SAMPLE of each language, a documented bound of the fit alone). Every document is scored, on
its whole text: batches of presence vectors times the matrix of the landmarks' n-grams and the regression's weights.

Defined cases: a null or empty text, and one with no letter, has language null and margin 0; ties go to the language
first in the alphabet; rows labelled null are not used in the fit; a table without labelled texts gives null for
all; repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.common import chunks, cut

MAX_N = 3
LANDMARKS = 256
SAMPLE = 400
RIDGE = 1e-2
#: Bounds of the fit: labels, and characters of a text.
LABELS = 1000
FIT_CHARS = 50_000
_BATCH = 128

SIGN = np.zeros(256, np.int32)
for _c in range(26):
    SIGN[65 + _c] = SIGN[97 + _c] = 1 + _c
SIGN[39] = 27
#: 0xC3 80-9F are the capitals of 0xC3 A0-BF: both halves of 0x80-0xBF share their signs.
SIGN[0x80:0xC0] = 28 + (np.arange(64) % 32)
SIGN[0xC0:] = 60 + (np.arange(64) % 4)


def grams(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: (row edges, n-grams), distinct and sorted in each row."""
    sign = SIGN[data].astype(np.int64)
    # a run of signs between words counts as one
    keep = np.ones(len(sign), bool)
    if len(sign):
        keep[1:] = (sign[1:] != 0) | (sign[:-1] != 0)
        keep[at[:-1][at[:-1] < len(sign)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    at, sign = total[at], sign[keep]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = []
    code = sign
    for n in range(1, MAX_N + 1):
        if n > 1:
            code = code[:-1] * 64 + sign[n - 1 :] if len(code) else code
        r = row[: len(code)]
        ok = r == row[n - 1 :][: len(code)] if len(code) else np.zeros(0, bool)
        packed = np.sort((r[ok].astype(np.uint32) << np.uint32(18)) | code[ok].astype(np.uint32)) if len(at) < 1 << 13 else np.sort((r[ok] << 18) | code[ok])
        new = np.ones(len(packed), bool)
        new[1:] = packed[1:] != packed[:-1]
        packed = packed[new].astype(np.int64)
        out.append((np.searchsorted(packed >> 18, np.arange(len(at))), packed & 0x3FFFF))
    return out


class Kernel:
    """Presence kernels against landmark texts: kernel(x) is (texts, landmarks)."""

    def __init__(self, landmarks: list[str]):
        self.vocabulary, self.matrix = [], []
        column = pa.array(landmarks, pa.string())
        held = [grams(data, at) for _, _, data, at in chunks(column)]
        for n in range(MAX_N):
            sets = [codes[edge[i] : edge[i + 1]] for edge, codes in (h[n] for h in held) for i in range(len(edge) - 1)]
            vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            m = np.zeros((len(vocabulary), len(landmarks)), np.float32)
            for j, s in enumerate(sets):
                m[np.searchsorted(vocabulary, s), j] = 1 / np.sqrt(max(len(s), 1))
            self.vocabulary.append(vocabulary)
            self.matrix.append(m)

    def times(self, weights: np.ndarray) -> list[np.ndarray]:
        return [m @ weights.astype(np.float32) for m in self.matrix]


def score_rows(column: pa.Array, vocabulary: list[np.ndarray], matrix: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix columns) sums over n of presence times matrix over sqrt(|G_n|), and whether a row has a letter."""
    width = matrix[0].shape[1]
    scores, has = [np.zeros((0, width))], [np.zeros(0, bool)]
    look = []
    for v in vocabulary:
        table = np.full(1 << 18, -1, np.int32)
        table[v] = np.arange(len(v))
        look.append(table)
    for _, _, data, at in chunks(column):
        rows = len(at) - 1
        total = np.zeros((rows, width))
        letters = np.zeros(rows, bool)
        for n, (edge, codes) in enumerate(grams(data, at)):
            size = np.diff(edge)
            if n == 0:
                letters = size > (np.searchsorted(codes, 0) < 0)
                first = np.zeros(rows, bool)
                some = size > 0
                first[some] = codes[edge[:-1][some]] == 0
                letters = size - first > 0
            spot = look[n][codes]
            known = spot >= 0
            row = np.repeat(np.arange(rows), size)
            for lo in range(0, rows, _BATCH):
                hi = min(rows, lo + _BATCH)
                part = slice(edge[lo], edge[hi])
                presence = np.zeros((hi - lo, len(vocabulary[n])), np.float32)
                use = known[part]
                presence[row[part][use] - lo, spot[part][use]] = 1
                total[lo:hi] += (presence @ matrix[n]) / np.sqrt(np.maximum(size[lo:hi], 1))[:, None]
        scores.append(total)
        has.append(letters)
    return np.concatenate(scores), np.concatenate(has)


class Model:
    """languages, and for each n the landmarks' n-grams and their weights for each language."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        pick = np.random.default_rng(5).permutation(len(texts))[:landmarks]
        kernel = Kernel([texts[i] for i in pick])
        k, _ = score_rows(pa.array(texts, pa.string()), kernel.vocabulary, kernel.matrix)
        among = k[pick]
        value, vector = np.linalg.eigh((among + among.T) / 2)
        good = value > 1e-6 * max(value.max(initial=0), 1e-12)
        nystrom = vector[:, good] / np.sqrt(value[good])
        x = np.hstack([k @ nystrom, np.ones((len(k), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        share = np.array([labels.count(c) for c in self.languages], float)
        weight = 1 / share[[self.languages.index(c) for c in labels]]
        a = (x * weight[:, None]).T @ x
        coef = np.linalg.solve(a + ridge * weight.sum() / len(texts) * np.eye(len(a)), (x * weight[:, None]).T @ y)
        self.bias = coef[-1]
        self.vocabulary, self.matrix = kernel.vocabulary, kernel.times(nystrom @ coef[:-1])

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language's number or -1, margin over the second)."""
        s, has = score_rows(column, self.vocabulary, self.matrix)
        s = np.round(s + self.bias, 6)
        best = s.argmax(1) if s.shape[1] else np.zeros(len(s), int)
        top = np.sort(s, 1)
        margin = top[:, -1] - top[:, -2] if s.shape[1] > 1 else np.zeros(len(s))
        return np.where(has, best, -1), np.where(has, margin, 0.0)


def fit(docs: DataFrame, label: str = "lang", per_label: int = SAMPLE) -> Model | None:
    """A model from at most per_label rows of each label, taken by the hash of the row, of texts of 1 to FIT_CHARS characters. There may be LABELS labels at most."""
    text = F.col("text").cast("string")
    known = docs.select(F.col(label).cast("string").alias("y"), text.alias("text"), F.xxhash64("doc_id", "text").alias("r")).where(F.col("y").isNotNull() & F.length("text").between(1, FIT_CHARS))
    keys = cut(known.select("y", "r").withColumn("i", F.row_number().over(Window.partitionBy("y").orderBy("r"))).where(F.col("i") <= per_label).select("y", "r").distinct())
    if keys.select("y").distinct().count() > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    # at most per_label * LABELS keys of some 16 bytes: the texts stay where they are
    rows = known.join(F.broadcast(keys), ["y", "r"], "left_semi").groupBy("r", "y").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["r"], r["y"]))
    return Model([r["text"] for r in rows], [r["y"] for r in rows]) if rows else None


def identify(docs: DataFrame, label: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, language, margin) of each row of docs."""
    model = model or fit(docs, label)
    base = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LANDMARKS and the alphabet

    def of(batches):
        m = shared.value
        names = np.array([*m.languages, None], object)
        for batch in batches:
            best, margin = m.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(np.round(margin, 4))], names=["doc_id", "language", "margin"])

    return base.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, margin double")
