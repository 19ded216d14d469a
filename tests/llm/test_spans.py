import random

import numpy as np
import pytest

from frameloom.llm import spans as sp


def brute_pairs(texts, n):
    grams = {}
    for d, t in texts.items():
        for i in range(len(t or "") - n + 1):
            grams.setdefault(t[i : i + n], set()).add(d)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def brute_shared(texts, n):
    out = {}
    for d, t in texts.items():
        others = {u[i : i + n] for e, u in texts.items() if e != d for i in range(len(u or "") - n + 1)}
        hit = set()
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in others:
                hit |= set(range(i, i + n))
        out[d] = len(hit)
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    alphabet = "abcde é日🙂 "
    new = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [new(rng.choice([149, 150, 151, 200, 400])) for _ in range(12)]
    texts = {}
    for d in range(n):
        parts = [new(rng.randrange(0, 300)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(pool) if rng.random() < 0.7 else "")
        if rng.random() < 0.2:
            parts.append(rng.choice(pool)[20:])
        texts[d] = "".join(parts)
    texts |= {n: None, n + 1: "", n + 2: "short", n + 3: texts[0], n + 4: texts[0], n + 5: "z" * 500, n + 6: "z" * 149, n + 7: "z" * 150 + "q", n + 8: "ab" * 300, n + 9: "xx" + "ab" * 100}
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_and_shares_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()], "doc_id long, text string, pos string")
    rows = sp.shared_pairs(df).collect()
    assert {(r.doc_a, r.doc_b) for r in rows} == brute_pairs(texts, 150) and len(rows) == len({tuple(r) for r in rows})
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in sp.shared_share(df).collect()}
    want = brute_shared(texts, 150)
    assert got == {d: (len(t or ""), want[d]) for d, t in texts.items()}


def test_an_edit_between_equal_tokens_splits_a_span(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefgh ") for _ in range(700))
    u = t[:140] + "#" + t[141:300] + "#" + t[301:]
    df = spark.createDataFrame([(1, t), (2, u)], "doc_id long, text string")
    got = {r.doc_id: r.shared_chars for r in sp.shared_share(df).collect()}
    assert got == {1: 159 + 399, 2: 159 + 399}


def test_tokens_of_a_common_run_are_the_same_wherever_it_lies():
    rng = random.Random(4)
    run = "".join(rng.choice("abcdef") for _ in range(150))
    for k in range(200):
        a = "".join(rng.choice("abcdef") for _ in range(k)) + run
        b = run + "".join(rng.choice("abcdef") for _ in range(200 - k))
        (_, _, ha), (_, _, hb) = next(sp.tokens_of([a])), next(sp.tokens_of([b]))
        assert set(ha.tolist()) & set(hb.tolist())


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    t = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    whole = [(p.tolist(), h.tolist()) for _, p, h in sp.tokens_of([t])]
    monkeypatch.setattr(sp, "PIECE", 4000)
    parts = {(a, b) for _, p, h in sp.tokens_of([t]) for a, b in zip(p.tolist(), h.tolist())}
    assert parts == set(zip(*whole[0]))


def test_hot_boilerplate_in_blocks(spark):
    rng = random.Random(7)
    foot = "".join(rng.choice("abcdefghij ") for _ in range(220))
    docs = [(i, "".join(rng.choice("klmnop") for _ in range(30)) + foot) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    st = sp.paths(sp.repeated_tokens(sp.sampled_kmers(df)))
    a = {tuple(r) for r in sp.candidates(st, block=7).select("a", "b").distinct().collect()}
    assert len(a) == 90 * 89 // 2
    assert sp.shared_pairs(df).count() == 90 * 89 // 2


def test_what_is_too_much_to_broadcast_is_joined(spark, monkeypatch):
    texts = corpus(5)
    monkeypatch.setattr(sp, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(sp, "MAX_BITS_LOG", 9)  # a map so full that it lets nearly all through
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in sp.shared_pairs(df).collect()} == brute_pairs(texts, 150)
    assert {r.doc_id: r.shared_chars for r in sp.shared_share(df).collect()} == brute_shared(texts, 150)


def test_the_map_of_bits_has_those_of_the_tokens_and_few_others(spark):
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**55, 3000)  # small, as minimisers are
    bits = sp.edge_bits(spark.createDataFrame([(int(x),) for x in e], "edge long"))
    log = len(bits).bit_length() + 2
    def held(v):
        at = sp._place(v.view(np.uint64), log)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

    assert held(e).all() and held(rng.integers(0, 2**55, 3000)).mean() < 0.1
    assert not sp.edge_bits(spark.createDataFrame([], "edge long")).any()


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_by_windows_alone_equal_brute_force(spark, seed, monkeypatch):
    texts = corpus(seed)
    monkeypatch.setattr(sp, "CROWD", 0)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_shared(texts, 150)
    assert {r.doc_id: r.shared_chars for r in sp.shared_share(df).collect()} == want


def test_long_periodic_texts(spark):
    rng = random.Random(12)
    new = lambda n: "".join(rng.choice("klmnop ") for _ in range(n))
    unit = "the same line again. "
    texts = {1: "ab" * 5000, 2: new(99) + "ab" * 5000, 3: " " * 2000 + new(300), 4: new(50) + " " * 2000, 5: unit * 300, 6: new(20) + unit * 300 + new(20), 7: unit * 8, 8: new(10) + "ab" * 74, 9: new(10) + "ab" * 75 + "c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in sp.shared_pairs(df).collect()} == brute_pairs(texts, 150)
    want = brute_shared(texts, 150)
    assert {r.doc_id: r.shared_chars for r in sp.shared_share(df).collect()} == want
    assert want[1] == 10_000 and want[8] == 0 and want[9] == 150
    # Before the aggregate: a few hundred rows for two periodic texts, not one for each pair of their tokens.
    st = sp.paths(sp.repeated_tokens(sp.sampled_kmers(df.where("doc_id in (1, 2)"), unlike=True)))
    assert st.groupBy("doc_id").count().agg({"count": "max"}).first()[0] < 200


def test_share_of_a_paragraph_in_a_third_of_many_documents(spark):
    rng = random.Random(13)
    foot = "".join(rng.choice("abcdefghij ") for _ in range(400))
    docs = [(i, "".join(rng.choice("klmnop") for _ in range(60)) + (foot if i % 3 == 0 else "")) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sp.shared_share(df)
    assert got.where("doc_id % 3 = 0 and shared_chars < 400").count() == 0 and got.where("doc_id % 3 <> 0 and shared_chars > 0").count() == 0


def test_paths_are_compact(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefghij") for _ in range(5000))
    df = spark.createDataFrame([(1, t), (2, "x" * 40 + t), (3, t[1000:3000])], "doc_id long, text string")
    rep = sp.repeated_tokens(sp.sampled_kmers(df))
    assert sp.paths(rep).count() <= 9 < rep.count()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sp.shared_pairs(df).count() == 0 and sp.shared_share(df).count() == 0


def test_common_runs():
    assert sp.common_runs("abcXdefg", "abcYdefg", 3) == [(0, 3), (4, 4)]
    assert sp.common_runs("ab", "ab", 3) == [] and np.size(sp.common_runs("", "", 1)) == 0
