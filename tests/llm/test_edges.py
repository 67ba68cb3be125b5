"""Nulls in any column, empty and very long texts, ties, repeated rows and columns with clashing names, for the operators that give a row for each row."""

import random

import numpy as np
import pytest

from citeflow.llm import labelled, language, neighbours, packing, preference, quality_rules, token_counts, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la")]
OTHER = ["der", "und", "nicht", "straße", "über"]
EXTRA = ["score", "keep", "probability", "toxic", "votes", "quality_prob", "language", "margin", "n_tokens", "row", "shard", "bin", "y", "r", "cluster", "told", "block"]


def rows():
    rng = random.Random(21)
    prose = lambda n, v=WORDS: " ".join(rng.choices(v, k=n)) + "."
    out = [(i, prose(rng.randint(20, 60), WORDS if i % 2 else OTHER), "x" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    long = prose(150_000)
    return [*out, (60, None, "x", "s0"), (61, "", "de", None), (62, long, None, "s1"), (None, prose(30), "x", "s2"), (63, "?!", "x", "s0"), (64, prose(30), None, None), out[3], out[3], (65, out[5][1], "x", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *([f"{i}"] * len(EXTRA))) for i, r in enumerate(rows())], ["doc_id", "text", "lang", "source", *EXTRA])


@pytest.fixture(scope="module")
def labels(spark):
    told = [(i, i % 2, int(i % 4 == 0)) for i in range(58)] + [(None, 1, 1), (3, 1, 0), (4, None, None), (5, 0, 1), (62, 1, 0), (60, 1, 1)]
    return spark.createDataFrame([(*t, "z", "z") for t in told], "doc_id bigint, quality int, toxic int, text string, y string")


def test_every_row_has_one_result(docs, labels):
    n = len(rows())
    made = {
        "op4": (language.identify(docs), ["doc_id", "language", "margin"]), "op5": (token_counts.count_tokens(docs), ["doc_id", "n_tokens"]), "op7": (preference.rank(docs, labels), ["doc_id", "score", "keep"]),
        "op8": (toxicity.score(docs, labels), ["doc_id", "probability", "toxic"]), "op9": (quality_rules.score(docs), ["doc_id", "votes", "quality_prob", "keep"]),
    }
    for name, (df, columns) in made.items():
        assert df.columns == columns, name
        found = sorted((tuple(r) for r in df.collect()), key=repr)
        assert len(found) == n, name
        of = {}
        for r in found:
            of.setdefault(r[0], set()).add(r[1:])
        assert len(of[3]) == 1 and of[65] == of[5], name  # repeated rows, and equal texts
        told = next(iter(of[60])), next(iter(of[61]))
        assert {"op4": told == ((None, 0.0),) * 2, "op5": told == ((None,), (0,))}.get(name, told[0] == told[1]), name
        if name == "op4":
            assert of[62] != {(None, 0.0)} and of[63] == {(None, 0.0)} and of[1] == {("x", next(iter(of[1]))[1])} and next(iter(of[0]))[0] == "de"
        if name == "op9":
            assert of[60] == of[61] == of[63] and next(iter(of[60]))[0] == "0" * len(quality_rules.RULES)


def test_packing_of_awkward_rows(docs):
    placed = packing.pack(docs, capacity=500).collect()
    size = {}
    for r in placed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    words = {}
    for d, t, *_ in rows():
        if t and t.split():
            words[d] = words.get(d, 0) + len(t.split())
    assert size == words and len({(r.shard, r.bin) for r in placed if r.doc_id == 62}) == 300
    of = [(r.shard, r.bin) for r in placed if r.doc_id in (3,)]
    assert len(of) == len(set(of)) == 3  # copies are apart


def test_packing_by_pieces_and_given_clusters(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[i : i + 10]), f"s{i}", 7, i // 4) for i in range(8)], "doc_id bigint, text string, source string, pieces bigint, family bigint")
    placed = packing.pack(docs, capacity=14, cluster=docs["family"], size=docs["pieces"]).collect()
    assert {r.n_tokens for r in placed} == {7}
    for b in {r.bin for r in placed}:
        held = [r.doc_id // 4 for r in placed if r.bin == b]
        assert len(held) == len(set(held)) == 2


def test_ranking_without_labels_and_of_ties(docs, labels):
    none = preference.rank(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and all(r.keep for r in none)
    one = preference.rank(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {0.0} and all(r.keep for r in one)


def test_bradley_terry_is_a_maximum_of_the_penalised_likelihood():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0.4, 1, (80, 3)), rng.normal(-0.4, 1, (80, 3))])
    y = np.repeat([1, 0], 80)
    m = preference.Ranker(x, y, pairs=2000)
    again = np.random.default_rng(11)
    z = m.expand(x)
    d = z[again.choice(np.flatnonzero(y == 1), 2000)] - z[again.choice(np.flatnonzero(y == 0), 2000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + 0.5 * (w**2).sum()
    for _ in range(40):
        assert loss(m.weight) <= loss(m.weight + rng.normal(0, 0.02, len(m.weight))) + 1e-9


def test_toxicity_with_few_labels_and_awkward_ones(spark, docs, labels):
    assert {r.probability for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    rng = random.Random(5)
    clean = [" ".join(rng.choices(WORDS, k=40)) for _ in range(200)]
    rude = [c.replace(" ", " you stupid idiot, you are pathetic scum ", 1) for c in clean[:20]]
    held = [c.replace(" ", " you m0ron, worthless tr@sh ", 1) for c in clean[100:140]]
    table = spark.createDataFrame(list(enumerate(clean + rude + held)), "doc_id bigint, text string")
    told = spark.createDataFrame([(i, int(i >= 200)) for i in [*range(180), *range(200, 220)]], "doc_id bigint, toxic int")
    toxic = {r.doc_id: r.toxic for r in toxicity.score(table, told).collect()}
    assert np.mean([toxic[i] for i in range(220, 260)]) > 0.9 and np.mean([toxic[i] for i in range(200)]) < 0.03


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(6)
    score = np.round(rng.random(60), 1)
    y = (rng.random(60) < score).astype(int)
    knots, value = labelled.isotonic(score, y)
    assert (np.diff(value) >= -1e-12).all() and np.allclose(knots, np.unique(score))
    # min-max formula of isotonic regression
    total, count = np.array([y[score == k].sum() for k in knots], float), np.array([(score == k).sum() for k in knots], float)
    mean = lambda a, b: total[a : b + 1].sum() / count[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, len(knots))) for a in range(i + 1)) for i in range(len(knots))]
    assert np.allclose(value, want)


def test_trees_fit_what_a_line_cannot():
    rng = np.random.default_rng(7)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    m = labelled.BoostedTrees(x[:1500], y[:1500], rounds=60)
    assert np.mean((m.score(x[1500:]) > 0) == (y[1500:] == 1)) > 0.95
    constant = labelled.BoostedTrees(np.zeros((5, 4)), np.array([0, 1, 1, 1, 0]))
    assert np.allclose(constant.score(np.zeros((2, 4))), constant.score(np.zeros((2, 4)))[0])


def test_neighbours_of_asked_rows(spark):
    v = np.random.default_rng(1).standard_normal((500, 8)).astype(np.float32)
    data = [(i if i != 3 else None, x.tolist(), "z") for i, x in enumerate(v)] + [(40, v[40].tolist(), "z"), (1000, [float("nan")] * 8, "z"), (1020, None, "z")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, row string")
    got = neighbours.knn(df, shard_rows=100, asked=df["vec_id"] % 20 == 0).collect()
    assert sorted(r.vec_id for r in got) == sorted([*range(0, 500, 20), 40, 1000, 1020])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    hits = []
    for r in got:
        if r.vec_id >= 1000:
            assert r.neighbours == []
        elif r.vec_id == 40:
            assert r.neighbours[0] == 40  # the row that repeats it
        else:
            hits.append(len(set(r.neighbours) & {i if i != 3 else None for i in np.argsort(-s[r.vec_id])[:10].tolist()}) / 10)
    assert np.mean(hits) > 0.95
