import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import neighbours as nb


def brute(ids, x, k, least=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, a in enumerate(ids):
        c = x @ x[i]
        order = sorted((j for j in range(len(ids)) if j != i and (least is None or c[j] >= least)), key=lambda j: (-c[j], ids[j]))[:k]
        out[a] = [ids[j] for j in order]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([b + 0.25 * rng.standard_normal((8, 64)) for b in base] + [rng.standard_normal((300, 64))])
    x *= rng.uniform(1, 30, (len(x), 1))
    return x.astype(np.float32)


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist(), "clash") for i, v in zip(ids, x)], "id int, vec array<float>, cell string")


def test_pairs_above_a_cosine(spark, clustered, monkeypatch):
    monkeypatch.setattr(nb, "SPLIT_ROWS", 100)
    want = brute(list(range(len(clustered))), clustered.astype(float), 10, 0.85)
    want = {(min(a, b), max(a, b)) for a, bs in want.items() for b in bs}
    got = {(r.row_a, r.row_b) for r in nb.similar_pairs(frame(spark, clustered)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and want


def test_search_reaches_the_recall(spark, clustered):
    df = frame(spark, clustered)
    got = {}
    for r in nb.search(df.where("id % 5 = 0"), df, rows_per_task=200, queries_per_task=50).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    want = brute(list(range(len(clustered))), clustered.astype(float), 10)
    hits = sum(len({n for _, n in got[i]} & set(want[i])) for i in got)
    assert len(got) == len(range(0, len(clustered), 5)) and all(len(v) == 10 for v in got.values())
    assert hits >= 0.9 * 10 * len(got)


def test_lists_without_a_floor(spark, clustered, monkeypatch):
    monkeypatch.setattr(nb, "SPLIT_ROWS", 700)
    got = {}
    for r in nb.neighbour_lists(frame(spark, clustered), home_rows=300).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(list(range(len(clustered))), clustered.astype(float), 10)
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.9 * 10 * len(want)


def test_crowded_cells_meet_in_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(nb, "TASK_BYTES", 100 * 256)
    a = {(r.row_a, r.row_b) for r in nb.similar_pairs(frame(spark, clustered)).collect()}
    monkeypatch.undo()
    assert a == {(r.row_a, r.row_b) for r in nb.similar_pairs(frame(spark, clustered)).collect()}


def test_crowded_cells_have_a_second_level(clustered, monkeypatch):
    x = np.tile(clustered, (4, 1)).astype(float) + np.random.default_rng(2).normal(0, 0.02, (4 * len(clustered), 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, one_side = np.arange(len(x)), np.zeros(len(x), bool)
    want = nb.cell_lists(x, ids, one_side, 10, 0.85, 64, 6, 0.1)
    monkeypatch.setattr(nb, "SPLIT_ROWS", 500)
    monkeypatch.setattr(nb, "SUB_HOME_ROWS", 100)
    got = nb.cell_lists(x, ids, one_side, 10, 0.85, 64, 6, 0.1)
    want, got = set(zip(*want[:2])), set(zip(*got[:2]))
    assert len(got & want) >= 0.97 * len(want)
    half = ids % 2 == 0
    assert all((a - b) % 2 for a, b in zip(*nb.cell_lists(x, ids, half, 10, 0.85, 64, 6, 0.1)[:2]))


@pytest.mark.parametrize("floor", [None, 0.5])
def test_more_near_ties_than_any_reserve_lose_nothing(floor):
    """Forty rows that single precision can't tell apart: both ways of comparing keep the k best by double precision."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.standard_normal(64), (40, 1)) + 1e-8 * rng.standard_normal((40, 64)), rng.standard_normal((400, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    cos = x @ x.T
    for width in (len(x), 60):
        got = nb.best_of(x[:40], ids[:40], x[:width], ids[:width], 10, floor, 64)
        for i in range(40):
            mine = [int(n) for a, n in zip(got[0], got[1]) if a == i]
            assert len(mine) == 10 and min(cos[i, mine]) >= np.sort(np.delete(cos[i, :40], i))[-10] - 1e-15


def test_rows_of_another_width_are_reported(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0])], "id int, vec array<float>")
    with pytest.warns(UserWarning, match="1 usable vectors have not 2 values"):
        nb.similar_pairs(df)
    with pytest.raises(ValueError, match="1 usable vectors"):
        nb.neighbour_lists(df, other_width="raise")


def test_packing_loses_nothing():
    rng = np.random.default_rng(0)
    m = rng.standard_normal((7, 3)).astype(np.float32)
    m[::2] = m[::2].astype(np.float16)
    blocks = list(nb._pack(np.arange(7), m))
    import pyarrow as pa

    ids, x = nb._unpack(pa.chunked_array([[b[0] for b in blocks] * 2]), pa.chunked_array([[b[1] for b in blocks] * 2]), 3)
    assert len(blocks) == 2 and ids.tolist() == list(range(7)) and np.array_equal(x, nb._unit(m))


def test_upper_bound_holds_for_nearly_all_pairs(clustered):
    x = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    turn, c = nb.rotation(64, 64), x.mean(0)
    up = nb.upper_cosines(nb.Questions(x, c, turn), slice(0, len(x)), nb.Codes(x, c, turn))
    assert (up >= x @ x.T - 1e-4).mean() > 0.995


def test_rows_that_take_no_part_and_rows_twice(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, []), (None, [1.0, 0.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, vec array<float>")
    assert {(r.row_a, r.row_b) for r in nb.similar_pairs(df).collect()} == {(1, 2)}
    assert nb.similar_pairs(df.limit(0)).count() == 0
    assert {(r.id, r.neighbour) for r in nb.search(df, df).collect()} == {(1, 2), (2, 1)}


def test_many_exact_copies_are_never_paired_with_each_other(spark):
    df = spark.range(3000).select(F.col("id"), F.array(F.lit(3.0), F.lit(4.0), F.lit(1.0)).cast("array<float>").alias("vec"))
    got = {}
    for r in nb.neighbour_lists(df, k=3, min_cosine=0.85).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert len(got) == 3000
    assert all([n for _, n in sorted(v)] == [j for j in range(4) if j != i][:3] for i, v in got.items())


def crowd_and_near_ones(spark):
    """A third of 6,000 rows copies of one vector, 40 different near neighbours of it in close twos, and the rest at random."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    near = np.repeat(base + 0.25 * rng.standard_normal((20, 64)), 2, axis=0) + 0.05 * rng.standard_normal((40, 64))
    x = np.concatenate([near, np.tile(base, (2000, 1)), rng.standard_normal((3960, 64))])
    return x.astype(np.float32), frame(spark, x.astype(np.float32))


def test_near_neighbours_of_a_third_of_copies_are_found_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "SPLIT_ROWS", 200)
    x, df = crowd_and_near_ones(spark)
    got = {}
    for r in nb.neighbour_lists(df, min_cosine=0.85, home_rows=4).where("id < 40").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    # The other of the two is nearer than the copies, which follow by id.
    want = {i: {i ^ 1, *range(40, 49)} for i in range(40)}
    assert sum(len(got.get(i, set()) & want[i]) for i in want) >= 0.98 * 10 * len(want)


def test_equal_directions_give_one_centroid():
    x = np.repeat(np.eye(3, dtype=np.float32)[[1, 0, 2]], [500, 1, 1], axis=0)
    assert nb._different(x).tolist() == np.eye(3)[[1, 0, 2]].tolist()
