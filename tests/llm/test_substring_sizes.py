"""Windows of few words, and columns named like those that the operators add."""

import random

import numpy as np
import pytest

from citeflow.llm import mixing, quality_rules, substring
from citeflow.llm.common import NOT_SPACE, words

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la")]


@pytest.mark.parametrize("rows", [1, 2, 5])
def test_windows_of_every_size(rows):
    rng = random.Random(rows)
    for total in range(121):
        texts = [" ".join(rng.choices(WORDS, k=total // rows)).encode() for _ in range(rows)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        r, pos, fp, h, _, _ = substring.windows(data, at)
        want = [(i, p) for i in range(rows) for p in range(max(0, total // rows - substring.WINDOW + 1))]
        assert list(zip(r.tolist(), pos.tolist(), strict=True)) == want and len(fp) == len(h) == len(want)
        assert len(words(data, at, NOT_SPACE)[0]) == total // rows * rows


def test_small_tables_do_not_break(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[i : i + 10])) for i in range(12)], "doc_id bigint, text string").repartition(4)
    assert substring.repeated_spans(docs).collect() == [] and substring.deduplicate(docs).count() == 12


def test_clashing_columns_keep_their_values(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choices(WORDS, k=60))
    names = ["_citeflow_row", "_citeflow_marks", "_citeflow_votes", "_citeflow_epoch", "_citeflow_left", "_citeflow_s", "_citeflow_times", "s", "t", "k", "votes", "row", "gid"]
    rows = [(i, f"{passage} {' '.join(rng.choices(WORDS, k=9))}", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for made in (substring.deduplicate(docs), quality_rules.filter_documents(docs, 0.0), mixing.sample(docs)):
        assert made.columns == docs.columns
        found = made.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
    assert len(substring.deduplicate(docs).collect()) == 6 and quality_rules.filter_documents(docs, 0.0).count() == 6
