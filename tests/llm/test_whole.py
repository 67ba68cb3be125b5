"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pytest

from citeflow.llm import neighbours, ngram_join, preference, queries, substring

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.mark.parametrize("parts", [1, 2])
def test_rows_repeated_as_a_whole_do_not_repeat_themselves(spark, parts):
    rng = random.Random(5)
    text, passage = prose(rng, 120), prose(rng, 60)
    rows = [(1, text), (1, text), (2, passage + " tail"), (3, "head " + passage), (3, "head " + passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "doc_id")
    assert {tuple(r) for r in substring.repeated_spans(docs).collect()} == {(3, 1, 61)}
    assert sorted((r.doc_id, r.text.strip()) for r in substring.deduplicate(docs).collect()) == [(1, text), (1, text), (2, passage + " tail"), (3, "head"), (3, "head")]


def test_ranking_threshold_covers_labels_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(preference, "SAMPLE", 40)
    rng = random.Random(6)
    good = [prose(rng, rng.randint(5, 90)).capitalize() + "." for _ in range(400)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=60)) for _ in range(100)]
    rows = [*enumerate(good + bad), (0, good[0]), (500, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    told = spark.createDataFrame([(i, int(i < 400 or i == 500)) for i in range(501) if i % 5] + [(500, 1)], "doc_id bigint, quality int")
    got = preference.rank(docs, told, quantile=0.1).collect()
    edge = np.quantile([r.score for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5], 0.1)
    # doc_id 500 is labelled good but has no text, and doc_id 0 has no label
    assert len(got) == len(rows) and [r.keep for r in got] == [bool(r.score >= edge) for r in got]
    assert any(r.keep for r in got) and not all(r.keep for r in got)


def test_join_keeps_rows_without_an_ngram(spark):
    text = prose(random.Random(8), 60)
    rows = [(1, None, "a"), (1, None, "b"), (2, "", "a"), (2, "", "b"), (None, "?!", "a"), (None, "?!", "b"), (3, text, "a"), (3, text, "b"), (4, text, "a")]
    kept = ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(map(repr, map(tuple, [r for r in kept if r.doc_id != 3]))) == sorted(map(repr, rows[:6])) and [r.doc_id for r in kept].count(3) == 1


def test_neighbours_of_equal_similarity_are_ordered_by_id(spark):
    e = np.eye(20, dtype=np.float32)
    same = [(i, e[0].tolist()) for i in range(130, 100, -1)] + [(None, e[0].tolist())]
    tied = [(i, (0.6 * e[1] + s * 0.8 * e[j]).tolist()) for i, (j, s) in zip(range(230, 200, -1), ((j, s) for j in range(2, 17) for s in (1, -1)), strict=True)]
    docs = spark.createDataFrame([*same, *tied, (300, e[1].tolist())], "vec_id bigint, embedding array<float>").coalesce(1)
    got = {r.vec_id: r for r in neighbours.knn(docs).collect()}
    assert got[101].neighbours == list(range(102, 112)) and got[130].neighbours == list(range(101, 111)) == got[None].neighbours
    assert got[300].neighbours == list(range(201, 211)) and set(got[300].similarities) == {0.6}
