"""A bounded sample of labelled rows for the fits, and the small models that are fitted on it by the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of each doc_id whose labels are all 0 or all 1."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("doc_id", "y")


#: Characters of the longest document that a fit takes: a bound of the driver's sample. Longer ones are scored as all are.
FIT_CHARS = 50_000


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], np.ndarray]:
    """(texts, 0/1 labels) of at most `most` labelled documents, taken by the hash of their doc_id, but for those of more than FIT_CHARS; of rows
    that share a doc_id one."""
    taken = agreed(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= FIT_CHARS).join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (scores, probabilities) of the monotone least-squares fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    knots, first = np.unique(score[order], return_index=True)
    total = np.add.reduceat(y[order].astype(float), first)
    count = np.diff(np.append(first, len(score))).astype(float)
    pools: list[list[float]] = []
    for t, n in zip(total, count, strict=True):
        pools.append([t, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t2, n2, k2 = pools.pop()
            pools[-1][0] += t2
            pools[-1][1] += n2
            pools[-1][2] += k2
    value = np.repeat([t / n for t, n, _ in pools], [int(k) for *_, k in pools])
    return knots, value


class BoostedTrees:
    """Gradient-boosted regression trees on logistic loss, split on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 4, ridge: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        # rates that are mostly 0 get an edge between 0 and the least positive value
        self.edges = [np.unique(np.append(e, c[c > 0].min() / 2)) if (c > 0).any() else e for e, c in zip(self.edges, x.T, strict=True)]
        code = self.code(x)
        share = min(max((y.mean() if len(y) else 0.0), 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.depth, self.trees = depth, []
        f = np.full(len(y), self.base)
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(code, y - p, p * (1 - p), least, ridge)
            f += rate * self._leaf(tree, code)
            self.trees.append((tree[0], tree[1], tree[2] * rate))

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1) if x.shape[1] else np.zeros(x.shape, int)

    def _grow(self, code, g, h, least, ridge):
        inner = (1 << self.depth) - 1
        feature, bound = np.zeros(inner, np.int64), np.full(inner, 1 << 30)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2 * least:
                    continue
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = 1e-6
                for j, e in enumerate(self.edges):
                    c = code[rows, j]
                    sg, sh, n = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    if not len(sg):
                        continue
                    gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                    gain[(n < least) | (n > len(rows) - least)] = 0
                    if gain.max() > best:
                        best, feature[k], bound[k] = gain.max(), j, int(gain.argmax())
            node = np.where(node >= (1 << level) - 1, 2 * node + 1 + (code[np.arange(len(code)), feature[np.minimum(node, inner - 1)]] > bound[np.minimum(node, inner - 1)]), node)
        leaf = node - inner
        sg, sh = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
        return feature, bound, sg / (sh + ridge)

    def _leaf(self, tree, code):
        feature, bound, value = tree
        node = np.zeros(len(code), np.int64)
        row = np.arange(len(code))
        for _ in range(self.depth):
            node = 2 * node + 1 + (code[row, feature[node]] > bound[node])
        return value[node - ((1 << self.depth) - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        code = self.code(x)
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self._leaf(tree, code)
        return f
