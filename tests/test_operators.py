import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import curate, dense, evaluate, fuse, ingest, joins, rank, sparse

META = "frame_id string, stream_name string, day string, hour int, time_offset_sec int, timestamp_str string"


def ranked(spark, rows):
    return spark.createDataFrame([("Q1", f, float(s)) for f, s in rows], "query_id string, frame_id string, score double")


def meta(spark, rows):
    return spark.createDataFrame([(f, s, "day1", 8, t, f"{t:08d}") for f, s, t in rows], META)


def kept(df):
    return {r.frame_id for r in df.collect()}


def test_dedup_cases(spark):
    m = meta(spark, [("a", "x", 100), ("b", "x", 103), ("c", "x", 105), ("d", "y", 100), ("e", "z", 100), ("f", "x", 110)])
    assert kept(rank.temporal_dedup(ranked(spark, [("a", 3), ("b", 2), ("c", 1)]), m)) == {"a"}
    assert kept(rank.temporal_dedup(ranked(spark, [("a", 1), ("d", 1), ("e", 1)]), m)) == {"a", "d", "e"}
    # Exactly ten seconds apart survives; unknown frames always do.
    assert kept(rank.temporal_dedup(ranked(spark, [("a", 2), ("f", 1), ("lost", 0), ("lost2", 0)]), m)) == {"a", "f", "lost", "lost2"}
    assert rank.temporal_dedup(ranked(spark, [("a", 1)]).limit(0), m).count() == 0


def test_dedup_scope(spark):
    m = spark.createDataFrame([("a", "x", "day1", 8, 10, "t"), ("b", "x", "day3", 15, 10, "u")], META)
    r = ranked(spark, [("a", 2), ("b", 1)])
    assert kept(rank.temporal_dedup(r, m)) == {"a"} and kept(rank.temporal_dedup(r, m, scope="stream_day_hour")) == {"a", "b"}


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i}", rng.choice("xyz"), rng.randrange(0, 900), rng.randrange(0, 40) / 10, f"Q{rng.randrange(3)}") for i in range(600)]
    m = meta(spark, [(f, s, t) for f, s, t, _, _ in rows])
    df = spark.createDataFrame([(q, f, x) for f, _, _, x, q in rows], "query_id string, frame_id string, score double")
    want = set()
    for q in {r[4] for r in rows}:
        keep = []
        for f, s, t, x, _ in sorted((r for r in rows if r[4] == q), key=lambda r: (-r[3], r[0])):
            if not any(s == s2 and abs(t - t2) < 10 for _, s2, t2 in keep):
                keep.append((f, s, t))
        want |= {(q, f) for f, _, _ in keep}
    got = rank.temporal_dedup(df, m)
    assert {(r.query_id, r.frame_id) for r in got.collect()} == want
    assert rank.temporal_dedup(got, m).count() == len(want)


def test_multi_angle(spark):
    m = spark.createDataFrame([("a", "x", "day1", 8, 0, "08:00:00"), ("b", "y", "day2", 8, 0, "08:00:00"), ("c", "x", "day1", 9, 0, "09:00:00"), ("d", "x", "day2", 9, 0, "09:00:00"), ("e", "x", "day1", 9, 5, "09:00:05")], META)
    got = {r.frame_id: r.multi_angle for r in rank.cross_stream_flag(ranked(spark, [(f, 1) for f in "abcde"] + [("lost", 1)]), m).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False, "lost": False}
    day = {r.frame_id: r.multi_angle for r in rank.cross_stream_flag(ranked(spark, [("a", 1), ("b", 1)]), m, "day_time").collect()}
    assert day == {"a": False, "b": False}


def test_merge_and_gate(spark):
    a, b = ranked(spark, [("f1", 0.5), ("both", 0.5)]), ranked(spark, [("f2", 0.8), ("both", 1.0)])
    got = {r.frame_id: (r.bm25, r.visual) for r in fuse.merge_signals({"bm25": a, "visual": b}).collect()}
    assert got == {"f1": (0.5, 0.0), "f2": (0.0, 0.8), "both": (0.5, 1.0)}
    fuse.prefusion_gate({"bm25": a, "visual": b})
    for bad, why in ((1.5, "out of range"), (math.nan, "not finite"), (0.0, "not positive")):
        with pytest.raises(fuse.GateError, match=why):
            fuse.prefusion_gate({"bm25": ranked(spark, [("x", bad)]), "visual": b})
    assert fuse.prefusion_gate({"bm25": ranked(spark, [("x", 1.5)])}, "report").first().ok is False
    assert fuse.prefusion_gate({"bm25": a.limit(0)}).count() == 0


def test_fusion(spark):
    m = spark.createDataFrame([("Q1", "f", 0.4, 1.0, 0.2, 0.6), ("Q9", "g", 1.0, 1.0, 1.0, 1.0)], "query_id string, frame_id string, bm25 double, visual double, transcript double, caption double")
    w = spark.createDataFrame([("Q1", 0.7, 0.3)], "query_id string, w_vis double, w_text double")
    got = {r.frame_id: r.score for r in fuse.fuse(m, w).collect()}
    assert got == pytest.approx({"f": 0.7 + 0.3 * (0.2 + 0.5 * 0.4), "g": 1.0})
    assert fuse.weights_check(w).count() == 0


def test_location_penalty(spark):
    s = spark.createDataFrame([("Q1", "a", 10.0), ("Q1", "b", 10.0), ("Q2", "a", 10.0), ("Q3", "b", 10.0), ("Q4", "a", 10.0), ("Q1", "lost", 10.0), ("Q5", "b", 10.0)], "query_id string, frame_id string, score double")
    st = spark.createDataFrame([("a", "Kitchen"), ("b", "living1")], "frame_id string, stream_name string")
    h = spark.createDataFrame([("Q1", ["kitchen"]), ("Q2", ["any"]), ("Q3", ["fixed/living1"]), ("Q5", ["living1"])], "query_id string, location_hint array<string>")
    got = {(r.query_id, r.frame_id): r.score for r in fuse.location_penalty(s, st, h, {"Q5": ["living1"]}).collect()}
    assert got == {("Q1", "a"): 10, ("Q1", "b"): 5, ("Q2", "a"): 10, ("Q3", "b"): 10, ("Q4", "a"): 10, ("Q1", "lost"): 10, ("Q5", "b"): 5}


def test_fusion_penalty_order_and_null_captions(spark):
    s = spark.createDataFrame([("Q2", f, 1.0) for f in ("fix", "self", "nul")] + [("Q5", "fix", 1.0)], "query_id string, frame_id string, score double")
    st = spark.createDataFrame([("fix", "fixed"), ("self", "member"), ("nul", None)], "frame_id string, stream_type string")
    c = spark.createDataFrame([("fix", "LOOKING at a camera"), ("self", "Looking at a camera"), ("nul", None)], "frame_id string, caption string")
    got = {(r.query_id, r.frame_id): r.score for r in fuse.fusion_penalty(s, st, c, ["Q2"], {"Q2": ["looking at a camera"]}).collect()}
    assert got == {("Q2", "fix"): 0.5, ("Q2", "self"): 0.97, ("Q2", "nul"): 1.0, ("Q5", "fix"): 1.0}


def decimate_model(rows, warm, cold):
    keep, prev = [], None
    for i, tier, h in rows:
        if tier == "hot":
            keep.append(i)
            continue
        if h is None:
            keep.append(i)
            prev = None
            continue
        if prev is None or bin((h ^ prev) & (2**64 - 1)).count("1") >= (warm if tier == "warm" else cold):
            keep.append(i)
        prev = h
    return keep


def test_decimation_equals_the_sequential_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "warm", "cold"]), rng.choice([None, *[rng.getrandbits(16) for _ in range(4)]])) for i in range(1, 700)]
    df = spark.createDataFrame([("s", "day1", 8, i, t, h) for i, t, h in rows], "stream_name string, day string, hour int, frame_index int, tier string, phash long")
    assert sorted(r.frame_index for r in curate.decimate(df).collect()) == decimate_model(rows, 8, 12)
    assert curate.decimate(df.limit(0)).count() == 0


def test_captions(spark):
    c = spark.createDataFrame([("a", "one two three four five", " OK "), ("b", "one two", "OK"), ("c", "one two three four five", "x"), ("d", None, "OK"), ("e", "one two three four five", None), ("f", " ", "OK")], "frame_id string, caption string, ocr_text string")
    f = curate.filter_captions(c)
    assert {r.frame_id: r.caption for r in f.collect()} == {"a": "one two three four five OK", "b": None, "c": "one two three four five", "d": None, "e": "one two three four five", "f": None}
    assert curate.short_captions(f).count() == 0
    assert tuple(curate.filter_counters(c).first()) == (6, 3, 3, 1)


def test_gate(spark):
    c = spark.createDataFrame([("a", "Cup. SALE", "sale", [1.0, 0.0]), ("b", "Cup. SALE", "sale", [0.0, 1.0]), ("lost", "Cup SALE", "sale", [0.0, 1.0]), ("c", None, "sale", [1.0, 0.0]), ("d", "Cup", " ", [1.0, 0.0])], "frame_id string, caption string, ocr_text string, ocr_vec array<float>")
    v = spark.createDataFrame([(f, [0.0, 2.0]) for f in "abcd"], "frame_id string, vec array<float>")
    got = {r.frame_id: (r.caption, r.ocr_text, r.ocr_sim, r.ocr_gate) for r in curate.ocr_gate(c, v).collect()}
    assert got == {"a": ("Cup", "", 0.0, "stripped"), "b": ("Cup. SALE", "sale", 1.0, "kept"), "lost": ("Cup SALE", "sale", None, None), "c": (None, "", 0.0, "stripped"), "d": ("Cup", " ", None, None)}
    g = curate.gate_counters(curate.ocr_gate(c, v)).first()
    assert (g.total, g.stripped, g.kept, g.not_gated, g.strip_rate) == (5, 2, 1, 2, 66.67)


def test_statistics(spark):
    x = [0.1, 0.4, 0.25, None, math.nan]
    r = curate.similarity_stats(spark.createDataFrame([(v,) for v in x], "s double"), "s").first()
    a = np.array([0.1, 0.4, 0.25])
    assert (r.n, r.lo, r.hi) == (3, 0.1, 0.4) and r.std == pytest.approx(a.std(), abs=1e-6) and r.p90 == pytest.approx(np.percentile(a, 90), abs=1e-6)


def test_sliding_text_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(0, 120), i, rng.choice(["x", " y ", "", None, "z"]) and f"{rng.choice('xyz')}{i}") for i in range(150)] + [("a", 5, 900, None), ("a", 6, 901, "  ")]
    df = spark.createDataFrame(rows, "k string, s int, n int, t string")
    want = {r[2]: " ".join(t.strip() for _, s, n, t in sorted((x for x in rows if x[0] == r[0] and abs(x[1] - r[1]) <= 10), key=lambda x: (x[1], x[2])) if t and t.strip()) for r in rows}
    assert {r.n: r.transcript_text for r in ingest.sliding_text(df, ["k"], "s", "t", "n").collect()} == want


def test_frame_index_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(2.5,), (7.5,), (12.5,), (0.0,)], "s double")
    assert [r.i for r in df.select(ingest.frame_index_from_sec(F.col("s")).alias("i")).collect()] == [1, 3, 3, 1]


def test_chunks(spark):
    c = spark.createDataFrame([("day1", "s", "08", 0, 0.0, 2.0, " one "), ("day1", "s", "08", 1, 12.5, 14.0, "two"), ("day1", "s", "08", 2, 13.0, 13.0, "no"), ("day1", "s", "08", 3, None, 13.0, "no"), ("day1", "s", "08", 4, 30.0, 31.0, " ")], "day string, stream_name string, hour string, chunk_no int, start_sec double, end_sec double, text string")
    got = [(r.frame_id, r.time_offset_sec, r.transcript_text, r.raw_text) for r in ingest.align_transcripts(c).orderBy("frame_index").collect()]
    assert got == [("s__day1__08_0001", 0, "one", "one"), ("s__day1__08_0003", 10, "two", "two")]


def test_bm25_against_the_formula(spark):
    docs = {"d1": "cup cup table", "d2": "Cup", "d3": "", "d4": None, "d5": "chair table"}
    df = spark.createDataFrame(list(docs.items()), "frame_id string, text string")
    q = spark.createDataFrame([("q", "cup CUP chair nothing")], "query_id string, query_text string")
    toks = {k: (v or "").lower().split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 5
    want = {}
    for d, t in toks.items():
        s = sum((math.log(5 / (sum(w in x for x in toks.values()) + 1)) + 1) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in ("cup", "chair") if w in t)
        if s:
            want[d] = s
    assert {r.frame_id: r.score for r in sparse.bm25(df, "text", q).collect()} == pytest.approx(want, abs=1e-8)
    assert sparse.bm25(df.limit(0), "text", q).count() == 0


def test_overfetch_may_return_fewer_than_k(spark):
    rows = [("q", "a", i, 1.0 - i / 100) for i in range(10)] + [("q", "b", 20, 0.1)]
    s = spark.createDataFrame(rows, "query_id string, frame_id string, row_index int, score double")
    assert kept(dense.overfetch_dedup(s, 2)) == {"a"} and kept(dense.overfetch_dedup(s, 2, exact=True)) == {"a", "b"}


def test_vector_topk_both_ways_and_rocchio(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    v = spark.createDataFrame([(f"f{i:03d}", r.tolist()) for i, r in enumerate(x)], "frame_id string, vec array<float>")
    q = spark.createDataFrame([(f"Q{i}", r.tolist()) for i, r in enumerate(rng.standard_normal((7, 16)))], "query_id string, qvec array<float>")
    a = sorted(tuple(r) for r in dense.topk_vectors(q, v, 5).select("query_id", "rank", "frame_id").collect())
    assert a == sorted(tuple(r) for r in dense.topk_matmul(q, v, 5, block=3).select("query_id", "rank", "frame_id").collect()) and len(a) == 35
    anchors = v.limit(1).crossJoin(q.select("query_id")).select("query_id", "vec")
    m = {r.query_id: np.array(r.qvec) for r in dense.rocchio(q, anchors).collect()}
    q0, a0 = np.array(q.first().qvec), np.array(v.first().vec)
    want = q0 / np.linalg.norm(q0) + a0 / np.linalg.norm(a0)
    assert m["Q0"] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    with pytest.raises(Exception, match="unknown anchor"):
        dense.rocchio(q, anchors.where("query_id <> 'Q0'")).collect()
    with pytest.raises(ValueError, match="queries"):
        dense.check_query_set(spark.range(dense.MAX_QUERY_BLOCK + 1))


def test_encoder_and_reranker_plug_in(spark):
    class Length:
        def encode(self, items):
            return np.array([[len(x), 1.0] for x in items])

        def score(self, pairs):
            return np.array([float(len(a) - len(b)) for a, b in pairs])

    df = spark.createDataFrame([("abc", "a"), (None, "b")], "t string, u string")
    assert [r.vec for r in dense.encode(df, "t", Length).collect()] == [[3.0, 1.0], [0.0, 0.0]]
    assert [r.logit for r in fuse.score_pairs(df, "t", "u", Length).collect()] == [2.0, -1.0]


def test_rerank_order(spark):
    c = spark.createDataFrame([("q", "a", 0.5, 0.0), ("q", "b", 0.5, 0.0), ("q", "c", 0.1, 9.0)], "query_id string, frame_id string, score double, logit double")
    assert [r.frame_id for r in fuse.rerank_hybrid(c).orderBy("rank").collect()] == ["a", "b", "c"]


def test_cascade(spark):
    s = spark.createDataFrame([("p", f"{i:02d}", 0.3) for i in range(20)] + [("f", "a", 0.21), ("f", "b", 0.1)] + [("b", x, 0.1) for x in "wxyz"], "query_id string, frame_id string, score double")
    got = {}
    for r in rank.threshold_cascade(s).collect():
        got.setdefault((r.query_id, r["mode"]), []).append(r.frame_id)
    assert {k: len(v) for k, v in got.items()} == {("p", "primary"): 15, ("f", "fallback"): 1, ("b", "best"): 3}


def test_evaluation(spark):
    r = spark.createDataFrame([("Q10", "A", i, f"f{i}", 1.0 / i, "s") for i in range(1, 11)] + [("Q9", "B", 1, "f1", 1.0, "s"), ("Q10", "D", 1, "f1", 0.9, "t")], "query_id string, approach string, rank int, frame_id string, score double, stream_name string")
    g = spark.createDataFrame([("Q10", "f1"), ("Q10", "f2"), ("Q10", "f2"), ("Q9", "z")], "query_id string, frame_id string")
    p = evaluate.precision_at_k(r, g)
    assert {(x.query_id, x.approach): x.p_at_k for x in p.collect()} == {("Q10", "A"): 0.2, ("Q9", "B"): 0.0, ("Q10", "D"): 0.1}
    assert {x.query_id: (x.best, x.note) for x in evaluate.best_approaches(p).collect()} == {"Q10": ("A", "A dominates"), "Q9": ("B", "all fail")}
    assert [x.query_id for x in evaluate.relevant_counts(g).collect()] == ["Q9", "Q10"]
    pooled = {x.frame_id: (x.best_score, x.appeared_in, x.stream_name) for x in evaluate.pool(r).where("query_id = 'Q10'").collect()}
    assert pooled["f1"] == (1.0, "A,D", "s")
    assert {(x.query_id, x.pair): x.n for x in evaluate.overlaps(r).collect()} == {("Q10", "A&D"): 1}


def test_interval_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(f"p{i}", "k", float(rng.randrange(0, 3600))) for i in range(80)]
    iv = [("k", s := float(rng.randrange(0, 3600)), s + rng.randrange(0, 200), i) for i in range(80)]
    p, i = spark.createDataFrame(pts, "frame_id string, k string, t double"), spark.createDataFrame(iv, "k string, start_sec double, end_sec double, n int")
    want = {(f, n) for f, _, t in pts for _, s, e, n in iv if s <= t + 30 and e >= max(0, t - 30)}
    got = [(r.frame_id, r.n) for r in joins.interval_overlap(p, i, ["k"]).collect()]
    assert set(got) == want and len(got) == len(want)


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", "")], "k string, w string")
    assert {tuple(r) for r in joins.left_with_default(a, b, "k", {"w": "none"}, empty_is_missing=True).select("k", "w").collect()} == {("x", "none"), ("y", "none")}
    assert {tuple(r) for r in joins.left_with_default(a, b, "k", {"w": "none"}).select("k", "w").collect()} == {("x", ""), ("y", "none")}
    with pytest.raises(Exception, match="no partner"):
        joins.inner_strict(a, b, "k").collect()
    assert joins.unmatched(a, b, ["k"]).first().k == "y" and joins.schema_equal(a, a.select("v", "k")) and not joins.schema_equal(a, b)
    assert tuple(joins.intersect_counts(a, b, "k").first()) == (1, 0, 1)


def test_best_query_ties_and_rounding(spark):
    s = spark.createDataFrame([("a", 3, 0.19996), ("a", 1, 0.19996), ("b", 2, 0.1)], "frame_id string, query_id int, score double")
    assert {tuple(r) for r in curate.best_query_per_frame(s).collect()} == {("a", 1, 0.2, "hot"), ("b", 2, 0.1, "cold")}


def test_dedup_gathers_one_frame_of_equal_offsets(spark, monkeypatch):
    ranked = spark.createDataFrame([("Q1", f"f{d}_{t}", 1.0 / (1 + d) + t / 1000) for d in range(20) for t in range(6)] + [("Q1", "lost", 0.5), ("Q1", "lost", 0.5)], "query_id string, frame_id string, score double")
    meta = spark.createDataFrame([(f"f{d}_{t}", "s", f"day{d}", 8, 5 * t) for d in range(20) for t in range(6)], "frame_id string, stream_name string, day string, hour int, time_offset_sec int")
    sizes = spark.sparkContext.accumulator(0)
    count = F.udf(lambda n: sizes.add(n) or n, "int").asNondeterministic()
    aggregate = F.aggregate
    monkeypatch.setattr(rank.F, "aggregate", lambda c, *a: aggregate(F.slice(c, F.lit(1), count(F.size(c))), *a))
    got = sorted(r.frame_id for r in rank.temporal_dedup(ranked, meta).collect())
    # The best of each offset, by score 5, 3 and 1, and the two rows without metadata.
    assert got == ["f0_1", "f0_3", "f0_5", "lost", "lost"]
    assert sizes.value == 8
