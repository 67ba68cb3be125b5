"""Dense text features that the quality rules, the ranking model and the toxicity model share.

All are made in one pass over the UTF-8 bytes by numpy. Rates of an empty or null text are 0.
"""

from __future__ import annotations

import numpy as np

from citeflow.llm.common import ALNUM, FOLD, NOT_SPACE, runs, word_hashes, words

NAMES = (
    "n_bytes", "n_words", "mean_word", "upper_rate", "digit_rate", "symbol_rate", "shout_rate", "pipe_rate", "stop_rate",
    "adjacent_rate", "distinct_rate", "tail_symbol_rate", "line_repeat", "alpha_word_rate", "comma_rate", "period_rate",
)

_UPPER, _DIGIT, _SYMBOL, _SHOUT = (np.zeros(256, np.uint8) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/|"]] = 1
_SHOUT[[ord(c) for c in "!?"]] = 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values within each row; at holds the rows' edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:], dtype=np.int64)
    return total[at[1:]] - total[at[:-1]]


def per_row_distinct(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys in each row; fewer than 4096 rows."""
    packed = np.sort((row.astype(np.uint64) << np.uint64(52)) | (key >> np.uint64(12)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    return np.bincount((packed[new] >> np.uint64(52)).astype(np.int64), minlength=n)[:n]


def dense(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) features of rows laid end to end in data; stop: sorted hashes of function words."""
    n = len(at) - 1
    size = np.diff(at)
    start, end, first = words(data, at, NOT_SPACE)
    count = np.diff(first)
    some, some_bytes = np.maximum(count, 1), np.maximum(size, 1)
    row = np.repeat(np.arange(n), count)
    folded = FOLD[data]
    w0, w1, wf = words(folded, at, ALNUM)
    bare = word_hashes(folded, w0, w1)
    bare_count = np.maximum(np.diff(wf), 1)
    bare_row = np.repeat(np.arange(n), np.diff(wf))
    spot = np.minimum(np.searchsorted(stop, bare), max(len(stop) - 1, 0))
    is_stop = (stop[spot] == bare) if len(stop) else np.zeros(len(bare), bool)
    again = np.zeros(len(bare), bool)
    again[1:] = (bare[1:] == bare[:-1]) & (bare_row[1:] == bare_row[:-1])
    distinct = per_row_distinct(bare_row, bare, n)
    tail = (_SYMBOL[data[end - 1]] > 0) if len(end) else np.zeros(0, bool)
    alpha = _LETTER[data[start]] if len(start) else np.zeros(0, bool)
    l0, l1 = runs(data != 10, at)
    line_row = np.searchsorted(at, l0, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    different = per_row_distinct(line_row, word_hashes(data, l0, l1), n)
    out = np.empty((n, len(NAMES)))
    columns = (
        size, count, totals(end - start, first) / some, totals(_UPPER[data], at) / some_bytes, totals(_DIGIT[data], at) / some_bytes,
        totals(_SYMBOL[data], at) / some_bytes, totals(_SHOUT[data], at) / some_bytes, totals((end - start == 1) & (data[start] == 124), first) / some if len(start) else 0,
        totals(is_stop, wf) / bare_count, totals(again, wf) / bare_count, distinct / np.minimum(bare_count, 200 + bare_count**0.5),
        totals(tail, first) / some, 1 - different / np.maximum(lines, 1), totals(alpha, first) / some, totals(data == 44, at) / some, totals(data == 46, at) / some,
    )
    for i, c in enumerate(columns):
        out[:, i] = c
    out[size == 0, 2:] = 0
    return out


#: Function words of the corpus's four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are with as be this have from or by an not at which",
    "fr": "le la les de des du et en un une est que qui dans pour sur au par pas plus avec ce il elle ne",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "el la de que y en un los se del las por con no una su para es al lo como más o pero sus",
}


def stop_hashes() -> np.ndarray:
    from citeflow.llm.common import hash_of

    return np.unique(np.array([hash_of(w) for s in STOP_WORDS.values() for w in s.split()], np.uint64))
