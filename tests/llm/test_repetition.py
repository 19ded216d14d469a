import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import repetition as rp


def brute(text):
    w = rp.words_of(text)
    hit = set()
    for i in range(len(w) - 2):
        if any(w[j : j + 3] == w[i : i + 3] for j in range(i)):
            hit |= {i, i + 1, i + 2}
    return len(w), len(hit) / len(w) if w else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "dé", "e1", "!"]), max_size=40))
def test_share_equals_brute_force(words):
    text = " ".join(words)
    w = rp.words_of(text)
    n, share = brute(text)
    assert len(w) == n and rp.repeated_share(w) == pytest.approx(share)
    assert all(a >= b - 1e-12 for a, b in zip(rp.cheap_statistics(w), rp.least_features(share)))


def test_overlap_counts():
    assert rp.repeated_share(rp.words_of("go go go go")) == 0.75
    assert rp.repeated_share(rp.words_of(None)) == rp.repeated_share(rp.words_of(" ... ")) == 0.0
    assert rp.cheap_statistics([]) == rp.cheap_statistics(["a"]) == (0.0, 0.0)


def test_forest_scores_anomalies_higher_and_bounds_a_region():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 0.2, 2000), rng.uniform(0, 0.1, 2000)])
    f = rp.IsolationForest(x)
    odd = np.column_stack([rng.uniform(0.4, 1, 500), rng.uniform(0.8 / 3, 1, 500)])
    assert f.score(odd).mean() > f.score(x).mean() + 0.1
    assert f.score(odd).min() >= f.least_score(rp.least_features(0.4)) - 1e-12


def test_the_forest_keeps_most_texts_from_the_exact_rule(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, 40)) for _ in range(2000)] + [" ".join([*rng.choice(vocab, 5)] * 6) for _ in range(20)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "text_field string, row_key long, text string")
    c = rp.candidates(df, sample_rows=500)
    assert 20 <= c.count() < 300 and c.where("repeated_share >= 0.4").count() == 20


def test_found_loses_nothing_and_handles_odd_rows(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, 20)) for _ in range(300)]
    texts += [" ".join([*rng.choice(vocab, 5)] * int(rng.integers(2, 9))) for _ in range(60)]
    texts += [None, "", "  ", "go go go go go go go", "É é é é é é é é", "a b c " * 60_000]
    rows = [("f", i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5] + [("f", None, "x x x x x x x x x", "c")], "text_field string, row_key long, text string, n_words string")
    want = {i for i, t in enumerate(texts) if (b := fast(t))[0] >= 8 and b[1] >= 0.4}
    assert {r.row_key for r in rp.found(df).collect()} == want and len(want) > 50
    assert rp.repetition(df).count() == len(texts)
    assert rp.found(df.limit(0)).count() == 0


def fast(text):
    w = rp.words_of(text)
    seen, hit = set(), set()
    for i in range(len(w) - 2):
        t = tuple(w[i : i + 3])
        if t in seen:
            hit |= {i, i + 1, i + 2}
        seen.add(t)
    return len(w), len(hit) / len(w) if w else 0.0
