"""The pipeline, stage by stage, against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from citeflow.llm import mixing, packing, quality_rules
from citeflow.llm.features import STOP_WORDS
from tests.llm.test_ngram_join import brute

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ba", "do", "fi", "gu", "he", "jo", "ku", "la") for c in ("", "n", "ri", "so", "te", "mu")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    out = []
    while len(out) < n:
        k = rng.randint(5, 12)
        out += [rng.choice(["the", "of", "and", "to", "in", *WORDS[:3]]) if rng.random() < 0.35 else rng.choice(WORDS) for _ in range(k)]
        out[-1] += "."
    return " ".join(out[:n])


def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(70)]
    passage = prose(rng, 70)
    texts += [t.upper() + " now" for t in texts[:3]] + [" ".join(rng.choice(WORDS) if rng.random() < 0.02 else w for w in texts[5].split()) for _ in range(6)]
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += ["$$$ ### BUY!!! | | |" * 20, "@@ %% && !! ?? 1234 5678 " * 15, "spam " * 90, "A B C D E F G H " * 9, "", None, "one two"]
    rows = [(i, t, "en", f"s{min(i % 4, 2)}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[1], (None, prose(rng, 60), None, None, None)]


def votes_of(text):
    raw = (text or "").encode()
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    bare = [w for w in bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isascii() and chr(c).isalnum() or c >= 128 else 32 for c in raw).split(b" ") if w]
    n, nb, size = max(len(words), 1), max(len(bare), 1), max(len(raw), 1)
    symbols, lines = b"#$%&*@^~<>{}[]\\=+_/|", [x for x in raw.split(b"\n") if x]
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    stop = {w.encode() for s in STOP_WORDS.values() for w in s.split()}
    value = {
        "upper_rate": sum(65 <= c <= 90 for c in raw) / size, "shout_rate": sum(c in b"!?" for c in raw) / size, "symbol_rate": sum(c in symbols for c in raw) / size, "tail_symbol_rate": sum(w[-1] in symbols for w in words) / n,
        "pipe_rate": sum(w == b"|" for w in words) / n, "adjacent_rate": sum(a == b for a, b in zip(bare, bare[1:])) / nb, "distinct_rate": len(set(bare)) / min(nb, 200 + nb**0.5), "line_repeat": 1 - len(set(lines)) / max(len(lines), 1),
        "stop_rate": sum(w in stop for w in bare) / nb, "period_rate": raw.count(b".") / n, "alpha_word_rate": sum(letter(w[0]) for w in words) / n, "mean_word": sum(map(len, words)) / n,
    }
    out = []
    for _, feature, bad, good, least in quality_rules.RULES:
        fits = lambda b, v=value[feature]: v > b[1] if b[0] == ">" else v < b[1]
        may = len(words) >= max(least, quality_rules.MIN_WORDS) and raw
        out.append((-1 if fits(bad) else 1 if fits(good) else 0) if may else 0)
    return tuple(out)


def posteriors(votes):
    """Expectation-maximisation written out, document by document."""
    good = [0.1 if min(v) < 0 else 0.98 for v in votes]
    for _ in range(50):
        share = (sum(good) + 0.9) / (len(votes) + 1)
        table = []
        for i in range(len(quality_rules.RULES)):
            for kind in (0, 1):
                w = [1.0, 1.0, 1.0]
                for v, g in zip(votes, good, strict=True):
                    w[v[i] + 1] += g if kind else 1 - g
                table.append([x / sum(w) for x in w])
        now = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(table[2 * i + 1][x + 1] / table[2 * i][x + 1]) for i, x in enumerate(v) if x)
            now.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
        if max(abs(a - b) for a, b in zip(now, good, strict=True)) < 1e-10:
            break
        good = now
    return now


def cut_passages(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (r[1] or "").split()
        gone = set()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            gone |= set(range(p, p + 50)) if key in seen else set()
            seen.add(key)
        if gone and len(gone) == len(w):
            continue
        out.append((r[0], tuple(x for i, x in enumerate(w) if i not in gone), r[3]))
    return out


def mixed(rows):
    """(doc_id, words, source) and how often each is taken."""
    key = {}
    for r in rows:
        told = f"{mixing.SEED}|{'-' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(told.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        clean = sum(c not in mixing._BAD for c in r[1] or "") / max(len(r[1] or ""), 1)
        key[r] = -math.log(u) / max(0.05, clean * clean)
    held = defaultdict(list)
    for r in rows:
        held[r[3]].append(r)
    total = {s: sum(len((r[1] or "").split()) for r in x) for s, x in held.items()}
    weight = {s: t**mixing.TEMPERATURE for s, t in total.items()}
    out = Counter()
    for s, x in held.items():
        budget = math.floor(sum(total.values()) * weight[s] / sum(weight.values())) if total[s] else 0
        epochs, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for r in sorted(x, key=key.get):
            n = len((r[1] or "").split())
            left -= n
            times = epochs + (n > 0 and left >= 0)
            if times:
                out[r[0], r[1], r[3]] += times
    return out


def test_quality_equals_plain_python(spark):
    rows = corpus()
    votes = [votes_of(r[1]) for r in rows]
    want = sorted((repr(r[0]), "".join("-0+"[x + 1] for x in v), round(p, 5)) for r, v, p in zip(rows, votes, posteriors(votes), strict=True))
    got = sorted((repr(r.doc_id), r.votes, round(r.quality_prob, 5)) for r in quality_rules.score(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-5)
    assert any(p < 0.5 for _, _, p in want)


def test_stages_equal_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append([tuple(r) for r in docs.collect()])
        assert name == "best_fit_packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [r for r, p in zip(rows, posteriors([votes_of(r[1]) for r in rows]), strict=True) if p >= 0.5]
    assert Counter(held[0]) == Counter(good) and len(good) < len(rows)
    least = {r[0]: r[1] for r in brute([r[:2] for r in good], Fraction(7, 10)) if r[0] is not None}
    single = [r for r in dict.fromkeys(good) if r[0] is None or least[r[0]] == r[0]]
    assert Counter(held[1]) == Counter(single) and len(single) < len(good)
    assert Counter((r[0], tuple((r[1] or "").split()), r[3]) for r in held[2]) == Counter(cut_passages(single))
    assert sum(len((r[1] or "").split()) for r in held[2]) < sum(len((r[1] or "").split()) for r in single)
    assert Counter((r[0], r[1], r[3]) for r in held[3]) == mixed(held[2])
    # one shard, longest first
    size = sorted(((-len((r[1] or "").split()), r[0] is not None, r[0] or 0, r[3]) for r in held[3] if (r[1] or "").split()), key=lambda x: x[:3])
    places, _ = packing.best_fit([-x[0] for x in size], [{"s0": 0, "s1": 1, "s2": 2, None: 3}[x[3]] for x in size], [x[2] if list(y[2] for y in size).count(x[2]) > 1 else -1 for x in size], packing.CAPACITY)
    want, got = defaultdict(list), defaultdict(list)
    for b, x in zip(places, size, strict=True):
        want[b].append((x[2], -x[0]))
    for r in docs.collect():
        got[r.shard, r.bin].append((r.doc_id or 0, r.n_tokens))
    assert Counter(map(lambda x: tuple(sorted(x)), got.values())) == Counter(map(lambda x: tuple(sorted(x)), want.values()))
    assert sorted(map(repr, (tuple(r) for r in docs.collect()))) == sorted(map(repr, (tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
