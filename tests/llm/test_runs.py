import random
from datetime import datetime

import pytest

from frameloom.llm import runs


def brute(events, gap):
    out = []
    for t, s in sorted(events):
        if out and out[-1][3] == s and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1, s])
    return {tuple(x) for x in out}


def got(df):
    return {(r.start_t, r.end_t, r.n, r.state) for r in df.collect()}


@pytest.mark.parametrize("block", [7, 60, 10_000])
def test_identity_runs_equal_brute_force_whatever_the_blocks(spark, block):
    rng = random.Random(3)
    times = sorted(rng.sample(range(2000), 600))
    events = [("e", float(t), rng.choice("aab")) for t in times]
    df = spark.createDataFrame(events, "entity string, t double, state string")
    assert got(runs.collapse_runs(df, 5.0, block_sec=block)) == brute([(t, s) for _, t, s in events], 5.0)


def test_near_identical_runs_merge_most_similar_first(spark):
    # a a b a a: the single b is taken up once the similarity may fall below 1.
    df = spark.createDataFrame([("e", float(i), s) for i, s in enumerate("aabaa")], "entity string, t double, state string")
    assert len(got(runs.collapse_runs(df, 2.0))) == 3
    assert runs.agglomerate([0, 1, 2, 3, 4], list("aabaa"), 2, 0.0) == [(0, 4, {"a": 4, "b": 1})]
    assert got(runs.collapse_runs(df, 2.0, min_similarity=0.0)) == {(0.0, 4.0, 5, "a")}


def slow(events, gap, least):
    """Merge the most similar neighbours, leftmost first, looking at all pairs each time."""
    rs = [[t, t, {s: 1}] for t, s in events]
    while True:
        best = None
        for i in range(len(rs) - 1):
            a, b = rs[i][2], rs[i + 1][2]
            s = sum(min(c / sum(a.values()), b.get(x, 0) / sum(b.values())) for x, c in a.items())
            if rs[i + 1][0] - rs[i][1] <= gap and s >= least and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return {(a, b, sum(h.values()), min(h, key=lambda x: (-h[x], x))) for a, b, h in rs}
        i = best[1]
        for x, c in rs[i + 1][2].items():
            rs[i][2][x] = rs[i][2].get(x, 0) + c
        rs[i][1] = rs[i + 1][1]
        del rs[i + 1]


@pytest.mark.parametrize("block,least", [(7, 0.3), (60, 0.5), (10_000, 0.0), (13, 0.7)])
def test_runs_below_similarity_one_equal_the_slow_search_whatever_the_blocks(spark, block, least):
    rng = random.Random(11)
    times = sorted(rng.sample(range(700), 260))
    events = [("e", float(t), rng.choice("aaabbc")) for t in times]
    df = spark.createDataFrame(events, "entity string, t double, state string")
    assert got(runs.collapse_runs(df, 5.0, least, block_sec=block)) == slow([(t, s) for _, t, s in events], 5.0, least)


def test_gap_is_inclusive_and_bars_merges():
    assert [r[:2] for r in runs.agglomerate([0, 15, 31], ["x"] * 3, 15, 1.0)] == [(0, 1), (2, 2)]


def test_nulls_and_empty(spark):
    schema = "entity string, t double, state string, extra int"
    df = spark.createDataFrame([(None, 1.0, "a", 1), ("e", None, "a", 1), ("e", 1.0, None, 1)], schema)
    assert runs.collapse_runs(df, 5.0).count() == 0
    assert runs.collapse_runs(spark.createDataFrame([], schema), 5.0).count() == 0


def test_tiers_are_read_in_any_spelling_and_the_latest_readable_counts(spark):
    spelt = [("hot", "hot"), (" Warm", "warm"), (" COLD", "cold"), ("tier:hot", "hot"), ("<warm>", "warm"), ("cold_tier", "cold"), ("ｗａｒｍ", "warm"), ("unscored", None), ("", None), (None, None), ("hot or cold", None), ("hotter", None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(spelt, "tier string, want string")
    assert all(r.got == r.want for r in df.select("want", runs.read_tier(F.col("tier")).alias("got")).collect())
    t = lambda h: datetime(2031, 3, 3, h)
    rows = [
        ("s__day1__08_0719", None, "hot", t(1)), ("S__Day01__08_0719", None, "cold", t(0)), ("s__08_0720", "x\\day1\\members\\s\\08_0720.webp", "HOT", t(1)),
        (None, "/v/footage/Day01/fixed//s/09_0001.JPG", "hot.", t(1)), (" s__day1__09_0001 ", None, "?", t(9)), ("s__day1__09_0006", None, "hot", t(1)), ("junk", None, "hot", t(1)),
    ]
    q = spark.createDataFrame(rows, "frame_id string, full_path_resized string, tier string, scored_at timestamp")
    r = {(x.first_frame_id, x.last_frame_id, x.n_frames, x.duration_sec, x.tier) for x in runs.tier_runs(q).collect()}
    assert r == {("s__day1__08_0719", "s__day1__09_0001", 3, 10, "hot"), ("s__day1__09_0006", "s__day1__09_0006", 1, 0, "hot")}
