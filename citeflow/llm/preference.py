"""Quality classifier by pairwise ranking (Bradley-Terry).

A document's score is linear in dense text features. It is learnt from preference pairs, each a document that is
labelled good and one that is labelled bad, by logistic loss on the difference of their features. Every document is
scored; those whose score is at least a quantile of the preferred documents' scores are kept.

The fit of the weights uses a bounded sample: at most SAMPLE labelled documents and PAIRS pairs. Scoring covers every
document, whole, and the quantile is exact over the scores of all documents that are labelled good and have a text.

Defined cases: a null or empty text has the score of features 0; where there is no preference (no labels, or
labels of one kind) all scores are 0 and all rows are kept; ties share their score and fate; repeated rows are scored
alike; an empty table gives an empty result; other columns are not read. Conflicting labels of a doc_id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import chunks, cut
from citeflow.llm.features import NAMES, dense, stop_hashes
from citeflow.llm.labelled import agreed, labelled_texts

SAMPLE = 8_000
PAIRS = 40_000
QUANTILE = 0.005
#: Scores are rounded to 1 / UNIT; ranges of scores that one pass of the exact quantile tells apart.
UNIT = 1_000_000
CELLS = 4096
_USED = [i for i, n in enumerate(NAMES) if n not in ("n_bytes", "n_words")]


def features(col: pa.Array, stop: np.ndarray) -> np.ndarray:
    parts = [dense(data, at, stop) for _, _, data, at in chunks(col)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
    return np.hstack([x[:, _USED], np.log1p(x[:, [1]])])


class Ranker:
    """score(features) of a Bradley-Terry model."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0):
        width = x.shape[1]
        self.low, self.high = (np.quantile(x, q, axis=0) if len(x) else np.zeros(width) for q in (0.02, 0.98))
        self.mean, self.scale, self.knot = np.zeros(width), np.ones(width), np.zeros((2, width))
        self.weight = np.zeros(3 * width)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x[good].mean(0), np.maximum(x[good].std(0), 1e-3)
        self.knot = np.stack([np.quantile(x[good], q, axis=0) for q in (0.02, 0.98)])
        z = self.expand(x)
        rng = np.random.default_rng(11)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weight = w

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, and how far each lies beyond what is common among good documents."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        below, above = np.maximum(self.knot[0] - x, 0) / self.scale, np.maximum(x - self.knot[1], 0) / self.scale
        return np.hstack([z, np.minimum(below, 8), np.minimum(above, 8)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.expand(x) @ self.weight, 6)


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    texts, y = labelled_texts(docs, labels, "quality", SAMPLE)
    return Ranker(features(pa.array(texts, pa.string()), stop_hashes()), y)


def _nth(units: DataFrame, rank: int) -> int:
    """The rank-th least unit, from 0. Each pass counts CELLS ranges and goes on in the one that holds it."""
    low, high = units.agg(F.min("unit"), F.max("unit")).first()
    while low < high:
        width = -(-(high - low + 1) // CELLS)
        cell = F.floor((F.col("unit") - low) / F.lit(width)).cast("bigint")
        for r in sorted(units.where(F.col("unit").between(low, high)).groupBy(cell.alias("cell")).count().collect()):
            if rank < r["count"]:
                low, high = low + r["cell"] * width, min(high, low + (r["cell"] + 1) * width - 1)
                break
            rank -= r["count"]
    return low


def threshold(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> float:
    """The quantile of all scores of documents that are labelled good, as numpy's; -inf where there are none.
    scored: (doc_id, score, told), told being false where the text is null.
    """
    good = scored.where("told").join(agreed(labels, "quality").where("y = 1"), "doc_id", "left_semi")
    units = cut(good.select(F.round(F.col("score") * UNIT).cast("bigint").alias("unit")))
    n = units.count()
    if not n:
        return float("-inf")
    spot = quantile * (n - 1)
    two = [_nth(units, k) / UNIT for k in (int(np.floor(spot)), int(np.ceil(spot)))]
    return float(np.quantile(two, spot - np.floor(spot)))


def rank(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, model: Ranker | None = None) -> DataFrame:
    """(doc_id, score, keep) of each row of docs."""
    model, stop = model or fit(docs, labels), stop_hashes()

    def of(col: pa.Array) -> pa.Array:
        return pa.array(model.score(features(col, stop)))

    text = F.col("text").cast("string")
    scored = cut(docs.select("doc_id", F.arrow_udf(of, "double")(text).alias("score"), text.isNotNull().alias("told")))
    return scored.select("doc_id", "score", (F.col("score") >= F.lit(threshold(scored, labels, quantile))).alias("keep"))
