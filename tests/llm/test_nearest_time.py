import random

import numpy as np

from frameloom.llm import nearest_time as nt


def test_learned_index_is_exact():
    rng = np.random.default_rng(2)
    for keys in (np.unique(rng.integers(0, 5000, 700)).astype(float), np.array([3.0]), np.cumsum(rng.exponential(1, 2000) ** 3), np.arange(100.0)):
        q = rng.uniform(keys[0] - 50, keys[-1] + 50, 3000)
        for eps in (0, 2, 8):
            at = nt.LearnedIndex(keys, eps).nearest(q)
            assert np.allclose(np.abs(keys[at] - q), np.abs(keys[None, :] - q[:, None]).min(1) if len(keys) < 800 else [np.abs(keys - v).min() for v in q])


def test_join_equals_brute_force_across_shards(spark):
    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.uniform(-20, 400), i) for i in range(300)]
    right = [(rng.choice("ab"), float(rng.randrange(0, 400)), f"r{i}") for i in range(60)]
    l, r = spark.createDataFrame(left, "entity string, t double, left_id long"), spark.createDataFrame(right, "entity string, t double, right_id string")
    want = {}
    for e, t, i in left:
        near = [(abs(u - t), u, x) for f, u, x in right if f == e and abs(u - t) <= 3]
        if near:
            want[i] = min(near)[2]
    for shard, per in ((10, 7), (3600, 200_000)):
        got = {x.left_id: x.right_id for x in nt.nearest_join(l, r, 3.0, shard_sec=shard, left_per_task=per).collect()}
        assert got == want


def test_nulls_duplicates_and_empty(spark):
    l = spark.createDataFrame([(None, 1.0, 1), ("a", None, 2), ("a", float("nan"), 3), ("a", 5.0, 4), ("a", 5.0, 4)], "entity string, t double, left_id long")
    r = spark.createDataFrame([("a", 15.0, "z"), ("a", 15.0, "y"), (None, 5.0, "n"), ("a", None, "m")], "entity string, t double, right_id string")
    assert [tuple(x) for x in nt.nearest_join(l, r, 10.0).collect()] == [(4, "y", 10.0)]
    assert nt.nearest_join(l.limit(0), r, 10.0).count() == 0 and nt.nearest_join(l, r.limit(0), 10.0).count() == 0


def test_marks_meet_chunks_of_any_hour_and_spelling(spark):
    m = spark.createDataFrame([(1, " TOVIK ", "Day02", 8, 3604.2), (2, None, "day2", 9, 0.0), (3, "tovik", "day2", 9, -3.0), (4, "tovik", "day2", 9, 40.0)], "mark_id long, stream_name string, day string, hour int, mark_sec double")
    t = spark.createDataFrame(
        [("tovik__day2__09_0002", "day02", "Tovik\t", " 9", None, 5), (None, "day2", "tovik", "08", 720, None), ("tovik__day2__09_0005", "day2", "tovik", "9", None, None)],
        "frame_id string, day string, stream_name string, hour string, frame_index int, time_offset_sec int",
    )
    got = {r.mark_id: r.frame_id for r in nt.mark_matches(m, t).collect()}
    assert got == {1: "tovik__day2__09_0002", 3: "tovik__day2__08_0720"}
