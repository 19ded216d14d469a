"""Late fusion: location penalties, score merge, gate, weighted formula, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import clamp, max_normalise, sigmoid
from ..functions.text import contains_any
from .dense import rank_topk

SIGNALS = ("bm25", "visual", "transcript", "caption")
FUSION_SHARE, RERANK_SHARE = 0.7, 0.3


class GateError(ValueError):
    """A signal broke the rules of the pre-fusion gate."""


def location_penalty(scores: DataFrame, streams: DataFrame | None, hints: DataFrame, strict: dict[str, list[str]] | None = None, factor: float = 0.5) -> DataFrame:
    """Halve scores of frames from unexpected places.

    ``scores(query_id, frame_id, score)``, ``streams(frame_id, stream_name)`` (or
    none if the scores have a stream_name), ``hints(query_id, location_hint)``. A query without hints, or with ``any``
    alone, is left alone; so is a frame of unknown stream. For a query in
    ``strict`` only its listed streams are penalised; for others a frame's
    stream must contain a hint or be contained in one, in any case.
    """
    j = scores if streams is None else scores.join(streams.select("frame_id", "stream_name"), "frame_id", "left")
    j = j.join(hints.select("query_id", "location_hint"), "query_id", "left")
    s = F.lower("stream_name")
    match = F.exists("location_hint", lambda h: F.contains(s, F.lower(h)) | F.contains(F.lower(h), s))
    free = F.col("location_hint").isNull() | (F.col("location_hint") == F.array(F.lit("any"))) | F.col("stream_name").isNull()
    hit = ~match
    for q, wrong in (strict or {}).items():
        hit = F.when(F.col("query_id") == q, F.col("stream_name").isin(wrong)).otherwise(hit)
    return j.select("query_id", "frame_id", F.when(free | ~F.coalesce(hit, F.lit(False)), F.col("score")).otherwise(F.col("score") * factor).alias("score"))


def normalise_lists(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, divided by the query's maximum."""
    top = rank_topk(scores, k)
    return top.select("query_id", "frame_id", F.round(max_normalise(F.col("score"), "query_id"), 9).alias("score"))


def merge_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of score lists into one column each, missing ones 0: one union and one aggregate."""
    long = reduce(DataFrame.unionByName, [d.select("query_id", "frame_id", F.lit(n).alias("signal"), "score") for n, d in signals.items()])
    return long.groupBy("query_id", "frame_id").agg(*[F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in signals])


def gate_report(signals: dict[str, DataFrame], slack: float = 1e-6) -> DataFrame:
    """``query_id, signal, n, top, n_null, n_not_finite, n_out_of_range, ok`` of each non-empty list; ``top`` is the highest finite score."""
    long = reduce(DataFrame.unionByName, [d.select("query_id", F.lit(n).alias("signal"), "score") for n, d in signals.items()])
    s = F.col("score")
    odd = F.isnan(s) | (F.abs(s) == float("inf"))
    g = long.groupBy("query_id", "signal").agg(
        F.count("*").alias("n"), F.max(F.when(~odd, s)).alias("top"), F.count_if(s.isNull()).alias("n_null"), F.count_if(odd).alias("n_not_finite"), F.count_if(~odd & ((s < -slack) | (s > 1 + slack))).alias("n_out_of_range"),
    )
    return g.withColumn("ok", (F.col("n_null") == 0) & (F.col("n_not_finite") == 0) & (F.col("n_out_of_range") == 0) & F.coalesce(F.col("top") > 0, F.lit(False)))


def prefusion_gate(signals: dict[str, DataFrame], on_violation: str = "raise") -> DataFrame:
    """The gate's report; with ``raise`` the first broken rule is an error."""
    r = gate_report(signals)
    if on_violation == "raise":
        bad = r.where("not ok").orderBy("query_id", "signal").limit(1).collect()
        if bad:
            b = bad[0]
            why = "contains null" if b.n_null else "not finite" if b.n_not_finite else "out of range [0, 1]" if b.n_out_of_range else "maximum not positive"
            raise GateError(f"{b.query_id}, {b.signal}: {why} (maximum {b.top})")
    return r


def fusion_formula() -> Column:
    """w_vis * V + w_text * (0.5 * BM25 + 0.5 * (0.5 * caption + 0.5 * transcript)), within [0, 1]."""
    dense = 0.5 * F.col("caption") + 0.5 * F.col("transcript")
    return clamp(F.col("w_vis") * F.col("visual") + F.col("w_text") * (0.5 * F.col("bm25") + 0.5 * dense))


def fuse(merged: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id, frame_id, score`` (9 places) of merged signals; a query without weights has 0.5 and 0.5."""
    j = merged.join(weights.select("query_id", "w_vis", "w_text"), "query_id", "left").fillna({"w_vis": 0.5, "w_text": 0.5})
    return j.select("query_id", "frame_id", F.round(fusion_formula(), 9).alias("score"))


def weights_check(weights: DataFrame) -> DataFrame:
    """The queries whose weights don't add up to 1."""
    return weights.where(F.abs(F.col("w_vis") + F.col("w_text") - 1) > 1e-9)


def fusion_penalty(scores: DataFrame, streams: DataFrame, captions: DataFrame, fixed_queries: list[str], patterns: dict[str, list[str]], fixed_factor: float = 0.5, pattern_factor: float = 0.97) -> DataFrame:
    """Penalise fixed cameras for some queries; else, for queries with patterns, frames whose caption has one.

    ``streams(frame_id, stream_type)``, ``captions(frame_id, caption)``. A null caption has no pattern.
    """
    j = scores.join(streams.select("frame_id", "stream_type"), "frame_id", "left").join(captions.select("frame_id", "caption"), "frame_id", "left")
    f = F.when(F.col("query_id").isin(fixed_queries) & (F.col("stream_type") == "fixed"), fixed_factor)
    for q, words in patterns.items():
        f = f.when((F.col("query_id") == q) & F.col("query_id").isin(fixed_queries) & contains_any(F.col("caption"), words), pattern_factor)
    return j.select("query_id", "frame_id", (F.col("score") * f.otherwise(1.0)).alias("score"))


class Reranker(Protocol):
    """Anything that scores (query, text) pairs with logits."""

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


def score_pairs(df: DataFrame, query: str, text: str, make: Callable[[], Reranker], out: str = "logit") -> DataFrame:
    """Add a logit column with a pluggable cross-encoder, made once for each worker process."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{out: np.asarray(model.score(list(zip(b[query].fillna(""), b[text].fillna("")))), dtype=float)})

    return df.mapInPandas(run, schema)


def rerank_hybrid(candidates: DataFrame, fusion_share: float = FUSION_SHARE, rerank_share: float = RERANK_SHARE) -> DataFrame:
    """Blend of fusion score and re-ranker probability: ``candidates(query_id, frame_id, score, logit)``.

    Sorted by blend, logit, fusion score and frame id; ``score`` becomes the blend (9 places).
    """
    from pyspark.sql import Window

    hybrid = F.round(fusion_share * F.col("score") + rerank_share * sigmoid(F.col("logit")), 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), F.desc("logit"), F.desc("fusion"), "frame_id")
    r = candidates.select("query_id", "frame_id", F.col("score").alias("fusion"), "logit", hybrid.alias("hybrid"))
    return r.withColumn("rank", F.row_number().over(w)).select("query_id", "frame_id", F.col("hybrid").alias("score"), "rank")


def keyword_boost(scores: DataFrame, captions: DataFrame, tiers: list[list[str]], share: float = 0.4) -> DataFrame:
    """Blend scores with a caption keyword tier, then divide by each query's maximum; a missing caption has tier 0."""
    from ..functions.text import keyword_tier

    j = scores.join(captions.select("frame_id", "caption"), "frame_id", "left")
    b = (1 - share) * F.col("score") + share * keyword_tier(F.col("caption"), tiers) / len(tiers)
    j = j.select("query_id", "frame_id", F.round(b, 9).alias("score"))
    return j.select("query_id", "frame_id", F.round(max_normalise(F.col("score"), "query_id"), 9).alias("score"))


def squash_top(ranked: DataFrame) -> DataFrame:
    """Sigmoid of the scores, divided by each query's maximum (9 places)."""
    return ranked.withColumn("score", F.round(max_normalise(sigmoid(F.col("score")), "query_id"), 9))
