"""Quality rules by weak supervision.

Each rule votes keep (+1) or reject (-1) on a document, or abstains (0). Expectation-maximisation over
the votes of the whole corpus estimates for each rule how it votes on good and on bad documents (a
two-class model with a full confusion row per rule), and the posterior probability of "good" decides,
in place of an all-must-pass filter. Votes are packed to one integer, so that the corpus enters the
estimation only as counts of vote patterns: at most 3**len(RULES) of them at any corpus size.

Defined cases: a null or empty text, and one of fewer than MIN_WORDS words, gets abstentions only, so its
posterior is the share of good documents; repeated rows are decided alike; an empty table gives an empty
result; other columns pass through untouched, and an input column named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import chunks, cut, fresh, trim
from citeflow.llm.features import NAMES, dense, stop_hashes

MIN_WORDS = 8
#: (name, feature, reject when, keep when, words that the rule needs): each bound as (op, value).
RULES = (
    ("capitals", "upper_rate", (">", 0.2), ("<", 0.05), 16),
    ("shouting", "shout_rate", (">", 0.05), ("<", 0.01), 8),
    ("symbols", "symbol_rate", (">", 0.03), ("<", 0.01), 8),
    ("symbol_tails", "tail_symbol_rate", (">", 0.2), ("<", 0.05), 8),
    ("table_bars", "pipe_rate", (">", 0.1), ("<", 0.02), 8),
    ("stutter", "adjacent_rate", (">", 0.3), ("<", 0.05), 8),
    ("variety", "distinct_rate", ("<", 0.4), (">", 0.65), 20),
    ("repeated_lines", "line_repeat", (">", 0.5), ("<", 0.2), 20),
    ("function_words", "stop_rate", ("<", 0.08), (">", 0.2), 30),
    ("sentences", "period_rate", ("<", 0.015), (">", 0.04), 40),
    ("letters", "alpha_word_rate", ("<", 0.7), (">", 0.9), 20),
    ("word_length", "mean_word", (">", 9.5), ("<", 6.5), 40),
)


def vote(x: np.ndarray) -> np.ndarray:
    """(rows, rules) votes of dense feature rows."""
    out = np.zeros((len(x), len(RULES)), np.int8)
    n_words = x[:, NAMES.index("n_words")]
    for i, (_, feature, bad, good, least) in enumerate(RULES):
        v, may = x[:, NAMES.index(feature)], n_words >= max(least, MIN_WORDS)
        for (op, bound), what in ((good, 1), (bad, -1)):
            out[may & ((v > bound) if op == ">" else (v < bound)), i] = what
    return out


def pack(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(len(RULES), dtype=np.int64))


def unpack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(RULES), dtype=np.int64)) % 3 - 1


def vote_code(text: Column) -> Column:
    """Packed votes of the rules on a text."""
    stop = stop_hashes()

    def of(col: pa.Array) -> pa.Array:
        parts = [pack(vote(dense(data, at, stop))) for _, _, data, at in chunks(col)]
        trim()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return F.arrow_udf(of, "bigint")(text.cast("string"))


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 50, prior_good: float = 0.9) -> tuple[float, np.ndarray]:
    """(share of good documents, (2, rules, 3) probabilities of the votes -1, 0, 1 given bad and good).

    votes: (patterns, rules); count: documents with each pattern. It starts from "bad" wherever a rule
    rejects, and adds one pseudo-document to each cell.
    """
    count = count.astype(float)
    good = np.where((votes < 0).any(1), 0.1, 0.98)
    hot = np.stack([votes == v for v in (-1, 0, 1)], -1)
    share, table = prior_good, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([count * (1 - good), count * good])
        share = (weight[1].sum() + prior_good) / (count.sum() + 1)
        table = np.einsum("cp,prv->crv", weight, hot) + 1
        table /= table.sum(-1, keepdims=True)
        now = posterior(votes, share, table)
        if np.abs(now - good).max(initial=0) < 1e-10:
            break
        good = now
    return float(share), table


def posterior(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of good; an abstention says nothing."""
    said = np.log(table)[:, np.arange(votes.shape[1])[None], votes.astype(int) + 1]
    said = np.where((votes == 0)[None], 0.0, said).sum(-1)
    odds = np.log(share) - np.log1p(-share) + said[1] - said[0]
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(coded: DataFrame, code: str = "votes") -> tuple[float, np.ndarray]:
    """estimate() over all rows of a column of packed votes."""
    found = sorted((r[0], r[1]) for r in coded.groupBy(code).count().collect())
    codes = np.array([c for c, _ in found], np.int64)
    return estimate(unpack(codes), np.array([n for _, n in found], np.int64))


def probability(code: Column, model: tuple[float, np.ndarray]) -> Column:
    """posterior() of a column of packed votes, as a sum of literals that stays in the JVM."""
    share, table = model
    weight = np.log(table[1]) - np.log(table[0])
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for i in range(len(RULES)):
        digit = F.floor(code / F.lit(3**i)) % 3
        odds = odds + F.when(digit == 0, float(weight[i, 0])).when(digit == 2, float(weight[i, 2])).otherwise(0.0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, quality_prob, keep) of each row of docs."""
    coded = cut(docs.select("doc_id", vote_code(F.col("text")).alias("votes")))
    p = probability(F.col("votes"), fit(coded))
    shown = F.concat(*(F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), ((F.col("votes") / 3**i).cast("bigint") % 3 + 1).cast("int")) for i in range(len(RULES))))
    return coded.select("doc_id", shown.alias("votes"), F.round(p, 6).alias("quality_prob"), (p >= threshold).alias("keep"))


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose posterior is at least threshold. Votes are counted over all rows first."""
    name = fresh(docs, "votes")
    model = fit(docs.select(vote_code(F.col("text")).alias("votes")))
    coded = docs.withColumn(name, vote_code(F.col("text")))
    return coded.where(probability(F.col(name), model) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
