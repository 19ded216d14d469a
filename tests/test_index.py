from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import text as ft
from frameloom.functions.stem import stem
from frameloom.operators import dense, rank
from frameloom.plans import approaches as ap
from frameloom.plans.archive import Archive
from frameloom.plans.index import PARTS, Index
from frameloom.sources import files, storage

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_a_build_that_was_cut_short_goes_on_where_it_ended(spark, tmp_path):
    root = str(tmp_path / "index")
    i = Index(spark, str(DATA), root).build()
    rows = {r.part: r for r in i.verify().collect()}
    assert set(rows) == set(PARTS) and all(r.ok for r in rows.values())
    when = {p: (tmp_path / "index" / p / "_SUCCESS").stat().st_mtime_ns for p in PARTS}
    (tmp_path / "index" / "postings" / "_SUCCESS").unlink()  # as if the job had not been committed
    (tmp_path / "index" / "counts" / "terms" / "_SUCCESS").unlink()
    again = Index(spark, str(DATA), root).build()
    now = {p: (tmp_path / "index" / p / "_SUCCESS").stat().st_mtime_ns for p in PARTS}
    assert {p for p in PARTS if now[p] != when[p]} == {"postings"}
    assert all(r.ok for r in again.verify().collect())
    i.drop()
    assert not storage.exists(spark, root)


def test_changed_tables_get_an_index_of_their_own(spark, tmp_path):
    (tmp_path / "frames.parquet").write_bytes(b"one")
    a = Index(spark, str(tmp_path)).root
    assert Index(spark, str(tmp_path)).root == a and Index(spark, str(tmp_path), analyzer="stemmed").root != a
    (tmp_path / "frames.parquet").write_bytes(b"other")
    assert Index(spark, str(tmp_path)).root != a


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stemmed_search_finds_other_forms(spark, tmp_path):
    plain, stemmed = (Archive(spark, str(DATA), str(tmp_path / n), n) for n in ("plain", "stemmed"))
    q = spark.createDataFrame([("a", "imaging people"), ("b", "image person")], "query_id string, query_text string")
    n = [ap.bm25(x, q, ("caption",)).where("query_id = 'a'").count() for x in (plain, stemmed)]
    assert n[1] > n[0]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_a_failing_approach_leaves_the_others(spark, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("no signal")

    monkeypatch.setattr(ap, "dense_text", broken)
    with pytest.warns(UserWarning, match="approach C failed"):
        got = ap.run_all(Archive(spark, str(DATA)))
    assert {r.approach for r in got.select("approach").distinct().collect()} == {"A", "B"}
    with pytest.raises(RuntimeError, match="no signal"):
        ap.run_all(Archive(spark, str(DATA)), on_failure="raise")


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("at", "at"), ("m3", "m3")])
def test_stems_are_those_of_the_published_rules(word, want):
    assert stem(word) == want


def test_stems_over_columns(spark):
    df = spark.createDataFrame([("The cats were hopping", 1), (None, 2), ("", 3)], "t string, i int")
    assert [r.s for r in df.orderBy("i").select(ft.stemmed(F.col("t")).alias("s")).collect()] == [["cat", "hop"], [], []]


def test_hash_encoder_ignores_case_and_order():
    m = dense.HashEncoder(16).encode(["A cup, a MUG", "mug cup a a", "", "\u0130x"])
    assert np.array_equal(m[0], m[1]) and np.abs(m[0]).sum() <= 4 and not m[2].any() and m[3].any()


def brute(q, x, keys, k, positive=False, best=None):
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    out = set()
    for i in range(len(q)):
        rows = sorted(((-s[i, j], *keys[j]) for j in range(len(x)) if not positive or s[i, j] > 0))
        if best is not None:
            seen = set()
            rows = [r for r in rows if not (r[1 + best] in seen or seen.add(r[1 + best]))]
        out |= {(f"Q{i}", *r[1:], -r[0]) for r in rows[:k]}
    return out


@pytest.mark.parametrize("positive,best", [(False, None), (True, None), (True, "frame_id"), (False, "frame_id")])
def test_products_give_the_k_best_of_each_task_whatever_the_ties(spark, monkeypatch, positive, best):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (400, 4)).astype(float)  # many equal directions
    x[~x.any(axis=1)] = 1
    q = rng.standard_normal((3, 4))
    keys = [(f"f{int(rng.integers(0, 120)):03d}", i) for i in range(len(x))]
    v = spark.createDataFrame([(f, i, r.tolist()) for (f, i), r in zip(keys, x)], "frame_id string, row_index int, vec array<float>").repartition(3)
    qs = spark.createDataFrame([(f"Q{i}", r.tolist()) for i, r in enumerate(q)], "query_id string, vec array<double>")
    monkeypatch.setattr(dense, "MAX_SCORES", 60)  # slices of 20 rows
    got = dense.topk_product(qs, v, 15, ("frame_id", "row_index"), positive=positive, best_of=best)
    rows = sorted(((r.query_id, -round(r.score, 9), r.frame_id, r.row_index) for r in got.collect()))
    if best:
        seen = set()
        rows = [r for r in rows if not ((r[0], r[2]) in seen or seen.add((r[0], r[2])))]
    top = {n: [r for r in rows if r[0] == n][:15] for n in ("Q0", "Q1", "Q2")}
    assert {(r[0], r[2], r[3], -r[1]) for rs in top.values() for r in rs} == brute(q, x, keys, 15, positive, 0 if best else None)


def test_best_query_takes_the_lowest_of_equal_ones(spark):
    q = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "query_id int, vec array<double>")
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 5.0]), ("c", [0.0, 0.0])], "frame_id string, vec array<float>")
    assert {tuple(r) for r in dense.best_query(q, v).collect()} == {("a", 1, 1.0), ("b", 3, 1.0), ("c", 1, 0.0)}
    assert dense.best_query(q.limit(0), v).count() == 0 and dense.topk_product(q.limit(0), v, 3).count() == 0


def test_too_many_queries_are_refused(spark):
    q = spark.range(10).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vec"))
    with pytest.raises(ValueError, match="more than 5 queries"):
        dense.topk_product(q, q.select(F.col("query_id").alias("frame_id"), "vec"), 3, most=5)


def test_lines_are_numbered_over_the_parts_of_a_file(spark, tmp_path):
    for n, name in ((5000, "a.jsonl"), (3, "b.jsonl")):
        (tmp_path / name).write_text("".join(("x" if i % 1000 == 7 else '{"n": %d}' % i) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        t = files.numbered_lines(spark, str(tmp_path))
        assert t.rdd.getNumPartitions() > 3
        a = t.where("file like '%a.jsonl'")
        assert a.where("line <> 'x' and cast(get_json_object(line, '$.n') as long) <> line_no - 1").count() == 0 and a.count() == 5000
        got = {(r.file[-7:], r.line_no, r.reason) for r in files.jsonl_violations(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.jsonl", 1000 * i + 8, "bad JSON") for i in range(5)}


def test_dedup_of_a_hundred_thousand_frames_of_one_stream(spark):
    """Every slot of the hour is filled on many days: a lane folds over at most 720 frames, the best of each slot."""
    n = 100_000
    meta = spark.range(n).select(F.format_string("f%06d", "id").alias("frame_id"), F.lit("s").alias("stream_name"), F.concat(F.lit("day"), (F.col("id") / 7200).cast("int")).alias("day"), (F.col("id") / 720 % 10).cast("int").alias("hour"), (F.col("id") % 720 * 5).cast("int").alias("time_offset_sec"))
    ranked = meta.select(F.lit("Q1").alias("query_id"), "frame_id", (F.pmod(F.xxhash64("frame_id"), F.lit(1_000_003)) / 1_000_003).alias("score"))
    got = [(r.frame_id, r.score) for r in rank.temporal_dedup(ranked, meta).collect()]
    best: dict[int, tuple[float, str]] = {}
    for r in ranked.collect():
        slot = int(r.frame_id[1:]) % 720
        best[slot] = min(best.get(slot, (9.0, "")), (-r.score, r.frame_id))
    kept: list[int] = []
    for _, frame in sorted(best.values()):
        slot = int(frame[1:]) % 720
        if all(abs(slot - k) >= 2 for k in kept):
            kept.append(slot)
    assert {f for f, _ in got} == {best[k][1] for k in kept}


def test_no_folder_is_made_up_on_a_cluster(spark, monkeypatch):
    from frameloom import session

    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(), "x")


