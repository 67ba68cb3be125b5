"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text, made from its bytes: density and number of words of a lexicon of insults (plain, and once more
after look-alike signs such as @ and 0 are read as letters), density and number of words of a second lexicon, of words and word beginnings that labelled
rows of their own part of the sample show to be toxic in whatever language they are in, the nearness of both to a second-person pronoun, capitals, exclamation
and question marks, and rates of obfuscated words. The sample of labelled rows is bounded (SAMPLE): one part gives
the second lexicon, one fits the trees, one calibrates them; every document is scored.

Defined cases: a null or empty text has all features 0; without labels of both kinds all probabilities are the share
of toxic labels (0 if none); ties share their fate; repeated rows are scored alike; an empty table
gives an empty result; other columns are not read. Conflicting labels of a doc_id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import ALNUM, FOLD, chunks, hash_of, runs, word_hashes, words
from citeflow.llm.features import totals
from citeflow.llm.labelled import BoostedTrees, isotonic, labelled_texts

SAMPLE = 12_000
THRESHOLD = 0.5
NEAR = 8
LEXICON = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin fool fools jerk jackass loser losers
pathetic worthless useless trash garbage scum scumbag filth filthy vermin swine clown clowns buffoon disgusting
repulsive revolting ugly hideous freak creep pervert bastard bastards bitch bitches whore slut asshole arsehole
prick cunt fuck fucking fucker motherfucker shit shitty bullshit crap damn retard retarded lunatic psycho nutjob hate hated
despise murder subhuman degenerate parasite coward liar traitor thug
imbécile crétin connard salope ordure débile abruti dummkopf arschloch schwachkopf schlampe abschaum widerlich
estúpido imbécil idiota cabrón puta basura asqueroso
""".split()  # fmt: skip
SECOND_PERSON = "you your yours yourself u ur tu toi te vous votre ton ta tes du dich dir dein deine ihr euch usted ustedes tú ti".split()
NAMES = ("density", "hits", "learnt_density", "learnt_hits", "hidden_density", "hidden_hits", "near_you", "you_rate", "upper_rate", "capital_words", "mark_rate", "symbol_rate", "obfuscated_rate", "stretched_rate", "log_words")
_LOOK = FOLD.copy()
for _a, _b in zip("@40$531!70", "aaosseiito", strict=True):
    _LOOK[ord(_a)] = ord(_b)
_LOOK[ord("3")], _LOOK[ord("5")], _LOOK[ord("1")], _LOOK[ord("!")] = ord("e"), ord("s"), ord("i"), ord("i")
_IN_WORD = ALNUM.copy()
_IN_WORD[[ord(c) for c in "@$!"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGNS = _IN_WORD & ~_LETTER


def _known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[spot] == h


def tables(lexicon=LEXICON) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.unique(np.array([hash_of(w) for w in ws], np.uint64)) for ws in (lexicon, SECOND_PERSON))


#: Lengths in bytes of the word beginnings of the second lexicon; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 8)
ODDS = 25.0
LEAST_DOCS = 5


def _beginnings(folded: np.ndarray, at: np.ndarray):
    """For each of BEGINNINGS: (index of the word, hash) of the words that are long enough; and the words' first in each row."""
    start, end, first = words(folded, at, ALNUM)
    for size in BEGINNINGS:
        i = np.flatnonzero(end - start >= max(size, 3))
        yield i, word_hashes(folded, start[i], start[i] + size if size else end[i]), first


def learn(texts: list[str], y: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes, for each of BEGINNINGS, of what is ODDS times as common among toxic documents."""
    texts, index = np.unique(np.array(texts, object), return_index=True) if len(texts) else (np.zeros(0, object), np.zeros(0, int))
    y = y[index]
    bad = int((y == 1).sum())
    met: list[list[np.ndarray]] = [[] for _ in BEGINNINGS]
    for lo, hi, data, at in chunks(pa.array(texts.tolist(), pa.string())):
        label = y[lo:hi].astype(np.uint64)
        for found, (i, h, first) in zip(met, _beginnings(FOLD[data], at), strict=True):
            row = np.searchsorted(first, i, "right") - 1
            both = np.unique((row.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
            found.append(((both & np.uint64((1 << 52) - 1)) << np.uint64(1)) | label[(both >> np.uint64(52)).astype(np.int64)])
    out = []
    for found in met:
        key, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        name, inverse = np.unique(key >> np.uint64(1), return_inverse=True)
        t = np.bincount(inverse, count * (key & np.uint64(1)), len(name))
        n = np.bincount(inverse, count, len(name)) - t
        odds = ((t + 0.1) / max(bad, 1)) / ((n + 0.5) / max(len(y) - bad, 1))
        out.append(name[(t >= LEAST_DOCS) & (odds >= ODDS)])
    return out


def _dense(data: np.ndarray, at: np.ndarray, lexicon: np.ndarray, second: np.ndarray, learnt: list[np.ndarray]) -> np.ndarray:
    n = len(at) - 1
    folded = FOLD[data]
    start, end, first = words(folded, at, ALNUM)
    count = np.diff(first)
    some, size = np.maximum(count, 1), np.maximum(np.diff(at), 1)
    h = word_hashes(folded, start, end)
    hit, you = _known(h, lexicon), _known(h, second)
    taught = np.zeros(len(h), bool)
    for table, (i, begins, _) in zip(learnt, _beginnings(folded, at), strict=True):
        if len(table):
            taught[i] |= _known(begins >> np.uint64(12), table)
    row = np.repeat(np.arange(n), count)
    # distance in words to the nearest second person of the same row, on either side
    place = np.arange(len(h))
    near = np.zeros(len(h), bool)
    if you.any():
        spots = place[you]
        mine = place[hit | taught]
        i = np.searchsorted(spots, mine)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(spots) - 1)):
            near[mine] |= (np.abs(spots[j] - mine) <= NEAR) & (row[spots[j]] == row[mine])
    # words as they read with look-alikes resolved; edges that are only marks are cut by the lexicon's own hash
    s2, e2 = runs(_IN_WORD[data], at)
    r2 = np.searchsorted(at, s2, "right") - 1
    sign = np.concatenate([[0], np.cumsum(_SIGNS[data])])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    mixed = (sign[e2] > sign[s2]) & (letter[e2] > letter[s2])
    s2, e2, r2 = s2[mixed], e2[mixed], r2[mixed]
    trim = e2.copy()
    for _ in range(4):  # trailing exclamation marks
        trim = np.where((trim > s2 + 1) & (data[np.maximum(trim - 1, 0)] == 33), trim - 1, trim) if len(trim) else trim
    hidden = np.zeros(len(s2), bool)
    if len(s2):
        look = _LOOK[data]
        inner = sign[trim] > sign[s2]
        hidden = inner & (_known(word_hashes(look, s2, trim), lexicon) | _known(word_hashes(look, s2, e2), lexicon))
        odd = inner
    else:
        odd = hidden
    upper = (data >= 65) & (data <= 90)
    total_upper = np.concatenate([[0], np.cumsum(upper)])
    shouted = (total_upper[end] - total_upper[start] == end - start) & (end - start > 2) if len(start) else np.zeros(0, bool)
    marks = (data == 33) | (data == 63)
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~", np.uint8))
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (folded[2:] == folded[1:-1]) & (folded[2:] == folded[:-2]) & _LETTER[data[2:]]
    bad, worse = totals(hit, first), np.bincount(r2[hidden], minlength=n)
    columns = (
        bad / some, bad, totals(taught, first) / some, totals(taught, first), worse / some, worse, totals(near, first) / some, totals(you, first) / some, totals(upper, at) / size, totals(shouted, first) / some,
        totals(marks, at) / size, totals(symbol, at) / size, np.bincount(r2[odd], minlength=n) / some, totals(same, at) / size, np.log1p(count),
    )
    return np.stack([np.asarray(c, float) for c in columns], 1)


def features(col: pa.Array, lexicon: np.ndarray, second: np.ndarray, learnt: list[np.ndarray]) -> np.ndarray:
    parts = [_dense(data, at, lexicon, second, learnt) for _, _, data, at in chunks(col)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


class Model:
    def __init__(self, texts: list[str], y: np.ndarray, lexicon=LEXICON):
        order = np.random.default_rng(3).permutation(len(y))
        taught, held, fitted = np.split(order, [len(order) * 2 // 5, len(order) * 3 // 5])
        self.tables = (*tables(lexicon), learn([texts[i] for i in taught], y[taught]))
        self.trees = BoostedTrees(self.features(pa.array([texts[i] for i in fitted], pa.string())), y[fitted])
        if len(held) and 0 < y[held].sum() < len(held) and 0 < y[fitted].sum() < len(fitted):
            x = self.features(pa.array([texts[i] for i in held], pa.string()))
            self.knots, self.value = isotonic(np.round(self.trees.score(x), 9), y[held])
        else:
            self.knots, self.value = np.zeros(1), np.full(1, float(y.mean()) if len(y) else 0.0)

    def features(self, col: pa.Array) -> np.ndarray:
        return features(col, *self.tables)

    def probability(self, col: pa.Array) -> np.ndarray:
        return np.interp(np.round(self.trees.score(self.features(col)), 9), self.knots, self.value)


def fit(docs: DataFrame, labels: DataFrame, lexicon=LEXICON) -> Model:
    return Model(*labelled_texts(docs, labels, "toxic", SAMPLE), lexicon)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, lexicon=LEXICON, model: Model | None = None) -> DataFrame:
    """(doc_id, probability, toxic) of each row of docs."""
    model = model or fit(docs, labels, lexicon)

    def of(col: pa.Array) -> pa.Array:
        return pa.array(np.round(model.probability(col), 6))

    scored = docs.select("doc_id", F.arrow_udf(of, "double")(F.col("text").cast("string")).alias("probability"))
    return scored.withColumn("toxic", F.col("probability") >= threshold)
