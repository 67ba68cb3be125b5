"""The substring index over several calls, and packing by token counts."""

import random

from citeflow.llm import substring

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la")]


def test_a_reopened_index_gives_what_one_call_gives(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = [prose(70) for _ in range(4)]
    rows = [(i, f"{prose(20)} {rng.choice(shared)} {prose(rng.randint(0, 40))}", i) for i in range(60)] + [(60, None, 0), (61, "", 0), (62, prose(49), 0), (63, prose(30) + " " + prose(400), 0)]
    rows += [(70 + i, rows[i][1], 1) for i in range(5)] + [(None, rows[3][1], 2)]
    schema = "doc_id bigint, text string, n_chars bigint"
    whole = spark.createDataFrame([r for r in rows if r[0] is not None], schema)
    want = sorted(map(tuple, substring.repeated_spans(whole).collect()))
    got, root = [], str(tmp_path / "index")
    for lo, hi in ((0, 20), (20, 30), (30, 62), (62, 100)):
        part = spark.createDataFrame([r for r in rows if r[0] is not None and lo <= r[0] < hi], schema).repartition(3)
        index = substring.FingerprintIndex(spark, root)  # opened anew each time
        got += map(tuple, substring.repeated_spans(part, 1, index).collect())
        for name, _ in index.runs:
            spark.sql(f"DROP TABLE {name}")  # as if another session came
    assert sorted(got) == want and want
    index = substring.FingerprintIndex(spark, root)
    assert len(index.runs) <= 3 and len(index.texts) == 4
    again = substring.deduplicate(spark.createDataFrame([(None, rows[3][1], 2), (900, prose(60), 3)], schema), index=index).collect()
    assert [r.doc_id for r in again] == [900]
    empty = substring.FingerprintIndex(spark, str(tmp_path / "other"))
    assert substring.repeated_spans(whole.limit(0), index=empty).collect() == [] and substring.FingerprintIndex(spark, str(tmp_path / "other")).texts
