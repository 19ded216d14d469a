import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.functions import frames as ff
from frameloom.functions import scores as fs
from frameloom.functions import text as ft
from frameloom.functions import vectors as fv


def one(spark, expr, schema="x string", value=None):
    return spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(expr.alias("r")).first().r


def test_frame_ids(spark):
    rows = [
        ("a__day1__08_0001", None, "a__day1__08_0001"), (" A__Day01__08_0001 ", None, "a__day1__08_0001"), ("a__08_0001", "x/day2/members/a/08_0001.webp", "a__day2__08_0001"),
        (None, "/v\\Day03\\\\fixed\\B\\23_0720.JPG", "b__day3__23_0720"), ("a__08_0001", None, None), ("", "", None), (None, None, None), ("a_b__day10__08_0001", None, "a_b__day10__08_0001"),
    ]
    df = spark.createDataFrame(rows, "i string, p string, want string").withColumn("f", ff.parse_frame(F.col("i"), F.col("p")))
    for r in df.select("want", ff.frame_id_of(F.col("f.stream"), F.col("f.day"), F.col("f.hour"), F.col("f.frame_index")).alias("got")).collect():
        assert r.got == r.want
    ok = spark.createDataFrame([("a__day1__08_0001", True), ("A__day1__08_0001", False), ("a__08_0001", False), ("a__day1__8_0001", False), (None, False)], "i string, want boolean")
    assert all(r.got == r.want for r in ok.select("want", ff.is_valid_frame_id(F.col("i")).alias("got")).collect())


def test_times(spark):
    assert one(spark, ff.hms(F.col("x")), "x int", 8 * 3600 + 3595 + 10) == "09:00:05"
    assert one(spark, ff.hms(F.col("x")), "x int", 25 * 3600) == "25:00:00"
    assert one(spark, ff.parse_hms(F.col("x")), value="01:02:03.5") == 3723.5
    assert one(spark, ff.parse_hms(F.col("x")), value="nonsense") is None
    assert one(spark, ff.clean_day(F.col("x")), value=" DAY 07") == "day7" and one(spark, ff.clean_hour(F.col("x")), value=" 9") == 9


def test_clean_text(spark):
    assert one(spark, ft.clean_text(F.col("x")), value="Don't  TOUCH the cup, it's (still) hot!") == "dont touch cup still hot"
    assert one(spark, ft.clean_text(F.col("x")), value=None) == one(spark, ft.clean_text(F.col("x")), value="  ") == ""


def test_expand_query(spark):
    r = spark.createDataFrame([("Making  Coffee ", ["coffee maker", "CUP"], ["cup placement"]), (None, None, None)], "q string, s array<string>, o array<string>")
    assert [x.r for x in r.select(ft.expand_query(F.col("q"), F.col("s"), F.col("o")).alias("r")).collect()] == ["Making Coffee maker CUP placement", ""]


def strip_model(c, o):
    if c is None or not o:
        return c
    at = c.lower().rfind(o.lower())
    return c if at < 0 else (c[:at].rstrip(" .,;:-|") or c)


CASES = [("A room. Coca-Cola", "coca-cola"), ("AB ab AB", "ab"), ("same", "same"), ("none", "x"), ("text", ""), (None, "x"), ("text", None), ("a - | STOP", "stop"), ("aaa", "aa"), ("", "")]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("abAB .", max_size=10), st.text("abAB", max_size=3)), min_size=20, max_size=40))
def test_strip_suffix(spark, pairs):
    rows = [(c, o) for c, o in [*pairs, *CASES]]
    got = [r.r for r in spark.createDataFrame(rows, "c string, o string").select(ft.strip_suffix(F.col("c"), F.col("o")).alias("r")).collect()]
    assert got == [strip_model(c, o) for c, o in rows]


def test_words_and_tiers(spark):
    assert [one(spark, ft.word_count(F.col("x")), value=v) for v in (None, "", "  ", "a", " a  b ")] == [0, 0, 0, 1, 2]
    tiers = [["ace of spades"], ["ace", "card"], ["game"]]
    assert [one(spark, ft.keyword_tier(F.col("x"), tiers), value=v) for v in ("The ACE of Spades", "a card game", "board game", "nothing", None)] == [3, 2, 1, 0, 0]


def test_scores(spark):
    v = [None, math.nan, math.inf, -0.5, 0.4, 1.5]
    assert [one(spark, fs.clamp(F.col("x")), "x double", x) for x in v] == [0, 0, 0, 0, 0.4, 1]
    # The score is rounded before the tier is taken: 0.19996 is hot.
    assert one(spark, fs.tier_of(F.round(F.col("x"), 4)), "x double", 0.19996) == "hot" and one(spark, fs.tier_of(F.col("x")), "x double", 0.19996) == "warm"
    assert [one(spark, fs.badge(F.col("x")), "x double", x) for x in (0.7, 0.4, 0.39, None)] == ["green", "yellow", "red", "red"]
    assert [one(spark, fs.band(F.col("x")), "x double", x) for x in (0.0, 0.05, 1.0, 1.01, -0.1, None)] == [0, 1, 6, None, None, None]
    assert one(spark, fs.sigmoid(F.col("x")), "x double", 0.0) == 0.5


def test_max_normalise_of_a_list_without_positive_scores_is_zero(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("b", 2.0), ("b", 1.0)], "q string, s double")
    assert sorted(tuple(r) for r in df.select("q", fs.max_normalise(F.col("s"), "q").alias("n")).collect()) == [("a", 0.0), ("a", 0.0), ("b", 0.5), ("b", 1.0)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(fv.l2_normalise(F.col("a")).alias("u"), fv.cosine(F.col("a"), F.col("b")).alias("c"), fv.is_unit(F.col("b")).alias("one"), fv.is_unit(F.col("a")).alias("z")).collect()
    assert r[0].u == pytest.approx([0.6, 0.8]) and r[0].c == pytest.approx(0.96) and not r[0].one
    assert r[1].u == [0.0, 0.0] and r[1].c == 0.0 and r[1].z and r[1].one
    h = spark.createDataFrame([([1.0] * 64, [1.0] * 60 + [-1.0] * 4)], "a array<float>, b array<float>").select(fv.hamming(fv.sign_hash(F.col("a")), fv.sign_hash(F.col("b"))).alias("d")).first().d
    assert h == 4
    u = spark.createDataFrame([(None,), ([],), ([0.0],), ([math.nan, 1.0],), ([math.inf],), ([1.0],)], "v array<float>")
    assert [r.r for r in u.select(fv.is_usable(F.col("v")).alias("r")).collect()] == [False] * 5 + [True]
