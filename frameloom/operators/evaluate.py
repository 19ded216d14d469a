"""Evaluation: precision, pooling, overlaps, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural(c: str = "query_id") -> Column:
    """Sort key that puts Q10 after Q9."""
    return F.regexp_extract(F.col(c), r"(\d+)$", 1).cast("int")


def precision_at_k(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, approach, hits, p_at_k``: hits among the first k over a fixed k, one place."""
    q = qrels.select("query_id", "frame_id").distinct().withColumn("hit", F.lit(1))
    r = ranked.where(F.col("rank") <= k).join(q, ["query_id", "frame_id"], "left")
    g = r.groupBy("query_id", "approach").agg(F.count("hit").alias("hits"))
    return g.withColumn("p_at_k", F.round(F.col("hits") / k, 1))


def mean_precision(p: DataFrame) -> DataFrame:
    """``approach, mean_p``: mean of the rounded values, three places."""
    return p.groupBy("approach").agg(F.round(F.avg("p_at_k"), 3).alias("mean_p"))


def best_approaches(p: DataFrame) -> DataFrame:
    """``query_id, best, note``: all winners joined by ``/`` and a remark on them."""
    g = p.groupBy("query_id").agg(F.max("p_at_k").alias("top"), F.collect_list(F.struct("approach", "p_at_k")).alias("all"))
    won = F.array_sort(F.transform(F.filter("all", lambda x: x["p_at_k"] == F.col("top")), lambda x: x["approach"]))
    n = F.size(won)
    note = F.when(F.col("top") == 0, "all fail").when((n == 1), F.concat(F.get(won, F.lit(0)), F.lit(" dominates"))).when(F.array_contains(won, "D"), "D ties best").otherwise("mixed")
    return g.select("query_id", F.array_join(won, "/").alias("best"), note.alias("note"))


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.countDistinct("frame_id").alias("n_relevant")).orderBy(natural())


def pool(ranked: DataFrame, depth: int = 20) -> DataFrame:
    """``query_id, frame_id, stream_name, best_score, appeared_in``: union of the lists' heads."""
    r = ranked.where(F.col("rank") <= depth)
    return r.groupBy("query_id", "frame_id").agg(F.max_by("stream_name", F.struct("score", "approach")).alias("stream_name"), F.max("score").alias("best_score"), F.array_join(F.sort_array(F.collect_set("approach")), ",").alias("appeared_in"))


def overlaps(ranked: DataFrame, depth: int = 20) -> DataFrame:
    """``query_id, pair, n``: frames that two approaches share, and that all of them share."""
    r = ranked.where(F.col("rank") <= depth).select("query_id", "frame_id", "approach").distinct()
    sets = r.groupBy("query_id", "frame_id").agg(F.sort_array(F.collect_set("approach")).alias("s"))
    total = r.groupBy("query_id").agg(F.countDistinct("approach").alias("k"))
    pairs = sets.select("query_id", F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat_ws("&", a, b))))).alias("pair"))
    everyone = sets.join(total, "query_id").where((F.size("s") == F.col("k")) & (F.col("k") > 2)).select("query_id", F.lit("all").alias("pair"))
    return pairs.unionByName(everyone).groupBy("query_id", "pair").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, c: str, k: int = 3) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def proximity_check(ranked: DataFrame, captions: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, near``: whether a caption of the first k hits has one of the query's words (``words(query_id, synonyms)``)."""
    j = ranked.where(F.col("rank") <= k).join(captions.select("frame_id", "caption"), "frame_id", "left").join(words, "query_id")
    hit = F.exists("synonyms", lambda s: F.contains(F.lower(F.coalesce("caption", F.lit(""))), F.lower(s)))
    return j.groupBy("query_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("near"))
