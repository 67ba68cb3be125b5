"""The n-gram join against brute force and against its SQL, with blocks, sums and clusters cut small."""

import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from citeflow.llm import ngram_join, queries

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def altered(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def corpus():
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 130))) for i in range(60)]
    base, other, short = prose(rng, 120), prose(rng, 40), prose(rng, 9)
    rows += [(100 + i, altered(rng, base, rng.choice([0, 0.01, 0.05, 0.12]))) for i in range(60)]
    rows += [(200 + i, altered(rng, other, 0.06)) for i in range(20)] + [(300 + i, altered(rng, short, 0.05)) for i in range(20)]
    rows += [(400 + i, rows[i][1].upper() + " !") for i in range(5)] + [(None, rows[6][1]), (None, rows[6][1]), (7, rows[7][1]), (None, "alone in this"), (500, None), (500, ""), (None, None), (501, "?!"), (502, prose(rng, 6000))]
    return rows


def brute(rows, t=Fraction(7, 10), n=2):
    grams = []
    for _, text in rows:
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        grams.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None)
    near = [[j for j, y in enumerate(grams) if x and y and j != i and len(x & y) >= t * len(x | y)] for i, x in enumerate(grams)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        copies = sum(grams[j] == grams[i] for j in near[i])
        out.append((doc, min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), copies, len(near[i]) - copies))
    return out


same = lambda rows: sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize(("n", "t", "block", "fan"), [(2, 0.7, 7, 2), (3, 1.0, 1024, 128)])
def test_join_equals_brute_force(spark, monkeypatch, n, t, block, fan):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FAN_IN", fan)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, cid string, _row int").repartition(5)
    want = brute(rows, Fraction(str(t)), n)
    assert same(ngram_join.join_documents(docs, n, t).collect()) == same(want)
    assert t == 1 or sum(r[3] for r in want) > 1000


def test_join_without_clusters_equals_brute_force(spark, monkeypatch):
    """The prefix join alone finds every link: clusters save work only."""
    monkeypatch.setattr(ngram_join, "_clusters", lambda classes: classes.select("cid", classes["cid"].alias("root")).limit(0))
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = corpus()
    assert same(ngram_join.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == same(brute(rows))


def test_join_equals_sql(spark):
    rows = corpus()
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    assert same(db.execute(queries.oracle_sql()["op3_ngram_jaccard_join"]).fetchall()) == same(ngram_join.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_deduplicate_keeps_the_least_of_each_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, i, "keep") for i, r in enumerate(rows)], "doc_id bigint, text string, _citeflow_row int, _citeflow_told string")
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert all(r["_citeflow_told"] == "keep" and rows[r["_citeflow_row"]] == (r.doc_id, r.text) for r in kept)
    left = Counter(r.doc_id for r in kept)
    for doc, least, _, _ in brute(rows):
        assert left[doc] == 0 if doc is not None and least != doc else True
    empty = [(500, None), (500, ""), (None, None), (501, "?!")]
    assert all(Counter((r.doc_id, r.text) for r in kept)[e] == 1 for e in empty)
    assert left[7] == 1 and left[6] == 1 and left[400] == 0 and sum(left.values()) == len({r[1] for r in brute(rows) if r[1] is not None}) + 3


def test_prefixes_hold_what_similar_sets_share():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 5, ngram_join.CELLS).astype(np.uint8)
    t = Fraction(7, 10)
    for _ in range(200):
        every = np.unique(rng.integers(0, 1 << 52, rng.integers(2, 90), dtype=np.uint64))
        x, y = (np.sort(every[rng.random(len(every)) < 0.93]) for _ in "ab")
        shared = len(np.intersect1d(x, y))
        if not len(x) or not len(y) or shared * 10 < 7 * (len(x) + len(y) - shared):
            continue
        need = ngram_join.overlap(len(x), len(y), t)
        found = []
        for z in (x, y):
            _, gram, place, _ = ngram_join.prefixes(np.zeros(len(z), np.int64), z, 1, t, level)
            found.append(gram[place * 256 // len(z) * len(z) <= 256 * (len(z) - need + ngram_join.LEAST - 1)])
        assert shared >= need and len(np.intersect1d(*found)) >= min(ngram_join.LEAST, need)
