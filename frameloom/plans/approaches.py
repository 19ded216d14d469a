"""The retrieval approaches as single plans over all queries at once, and the batch run.

Every function takes an Archive and returns ``query_id, frame_id, score`` (and
``rank``); query_id is a column, so ten queries or ten thousand are one plan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import stream_of
from ..functions.text import TOKENIZERS, tokens
from ..operators import dense, fuse, rank, sparse
from ..session import checkpointed
from .archive import Archive

TOP_K = 50
TRANSCRIPT_SHARE, CAPTION_SHARE = 0.7, 0.3
#: Parameters of this query set: queries that penalise fixed cameras, and caption patterns that weigh less.
FIXED_PENALTY_QUERIES = ["Q1", "Q2", "Q8"]
PATTERNS = {"Q2": ["first-person view"]}
STRICT = {"Q1": ["lodge", "loft", "laundry"]}


def bm25(a: Archive, queries: DataFrame | None = None, fields: tuple[str, ...] = ("transcript", "caption")) -> DataFrame:
    """``query_id, frame_id, <field>...`` from the index's postings, one scan for all fields and queries."""
    q = a.queries() if queries is None else queries
    dense.check_query_set(q)
    i = a.index
    w = sparse.term_weights(q, i.read("terms").where(F.col("field").isin(*fields)), i.read("fields"), TOKENIZERS[a.analyzer])
    return sparse.bm25_fields(i.read("postings"), w, list(fields))


def bm25_caption(a: Archive) -> DataFrame:
    return bm25(a, fields=("caption",)).withColumnRenamed("caption", "score")


def bm25_documents(a: Archive) -> DataFrame:
    """``query_id, doc_id, score`` over the documents table, words of any script."""
    i = a.index
    w = sparse.term_weights(a.queries(), i.read("document_terms"), i.read("document_fields"), TOKENIZERS["words" if a.analyzer == "plain" else a.analyzer])
    return sparse.bm25_fields(i.read("document_postings"), w, ["document"], key="doc_id").withColumnRenamed("document", "score")


def _both_fields() -> Column:
    return F.round(TRANSCRIPT_SHARE * F.coalesce("transcript", F.lit(0.0)) + CAPTION_SHARE * F.coalesce("caption", F.lit(0.0)), 9)


def bm25_combined(a: Archive, queries: DataFrame | None = None) -> DataFrame:
    """Independent searches of both fields, 0.7 transcript + 0.3 caption."""
    return bm25(a, queries).select("query_id", "frame_id", _both_fields().alias("score"))


def approach_a(a: Archive, k: int = TOP_K) -> DataFrame:
    """Sparse: speech queries search both fields, others captions; penalty by place; best k, normalised."""
    q = a.queries()
    s = bm25(a).join(F.broadcast(q.select("query_id", "qtype")), "query_id")
    s = s.select("query_id", "frame_id", F.when(F.col("qtype") == "speech", _both_fields()).otherwise(F.col("caption")).alias("score")).where("score is not null")
    # Every document is a frame of the manifest, whose id begins with its stream.
    s = fuse.location_penalty(s.withColumn("stream_name", stream_of(F.col("frame_id"))), None, q, STRICT)
    return dense.rank_topk(fuse.normalise_lists(s, k), k)


def approach_b(a: Archive, k: int = TOP_K) -> DataFrame:
    """Visual: exact cosine top-k, normalised."""
    return dense.rank_topk(fuse.normalise_lists(dense.topk_product(a.query_vectors(), a.vectors(), k, qvec="qvec"), k), k)


def query_text_vectors(a: Archive) -> tuple[list[str], np.ndarray]:
    """Names and vectors of the query set's texts by the index's text encoder, on the driver, as the set is small and checked."""
    rows = a.queries().select("query_id", "query_text").collect()
    return [r[0] for r in rows], a.index.encoder().encode([r[1] or "" for r in rows]) if rows else np.zeros((0, 1))


def dense_text(a: Archive, k: int = TOP_K, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Dense text over transcripts and captions: over-fetched, best per frame, normalised."""
    q = query_text_vectors(a)
    out = []
    for field in ("transcript", "caption"):
        v = a.index.read("text_vectors").where(F.col("field") == field)
        s = dense.topk_product(q, v, k if exact else dense.OVERFETCH * k, ("frame_id", "row_index"), positive=True, best_of="frame_id" if exact else None)
        top = dense.overfetch_dedup(s, k, exact=exact)
        out.append(dense.rank_topk(fuse.normalise_lists(top.select("query_id", "frame_id", "score"), k), k))
    return out[0], out[1]


def signals(a: Archive, k: int = TOP_K) -> dict[str, DataFrame]:
    """The four normalised lists, k rows for each query at most.

    They are computed in one pass and written, since every later step reads them several times.
    """
    t, c = dense_text(a, k)
    lists = {"bm25": approach_a(a, k), "visual": approach_b(a, k), "transcript": t, "caption": c}
    long = checkpointed(reduce(DataFrame.unionByName, [d.select("query_id", "frame_id", "score", "rank", F.lit(n).alias("signal")) for n, d in lists.items()]))
    return {n: long.where(F.col("signal") == n).drop("signal") for n in lists}


def only(meta: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of ``meta(frame_id, ...)`` for the frames of lists that hold at most a few hundred rows for each of a checked query set."""
    return meta.join(F.broadcast(lists.select("frame_id").distinct()), "frame_id", "left_semi")


def approach_c(a: Archive, k: int = TOP_K, check: bool = False, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Late fusion of the four signals; penalties; best k. With ``check`` the gate runs first and may raise."""
    parts = parts or signals(a, k)
    if check:
        fuse.prefusion_gate(parts)
    f = checkpointed(fuse.fuse(fuse.merge_signals(parts), a.queries()))
    f = fuse.fusion_penalty(f, only(a.frames(), f), only(a.captions(), f), FIXED_PENALTY_QUERIES, PATTERNS)
    return dense.rank_topk(f, k)


def overlap_logits(a: Archive, candidates: DataFrame) -> DataFrame:
    """Candidates with a stand-in logit: 4 x (share of the query's words in the caption, or stream name without one) - 2."""
    q = a.queries().select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("qt"))
    j = candidates.join(q, "query_id").join(only(a.captions(), candidates).select("frame_id", "caption"), "frame_id", "left").join(only(a.frames(), candidates).select("frame_id", "stream_name"), "frame_id", "left")
    text = F.coalesce(F.nullif(F.col("caption"), F.lit("")), "stream_name", F.lit("unknown"))
    share = F.size(F.array_intersect("qt", tokens(text))) / F.greatest(F.lit(1), F.size("qt"))
    return j.select("query_id", "frame_id", "score", (4 * share - 2).alias("logit"))


def approach_d(a: Archive, mode: str = "hybrid", k: int = 10, fallback_b: tuple[str, ...] = ("Q3",), c: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
    """Re-ranked fusion. ``hybrid`` uses the re-ranker; ``as_shipped`` falls back to B for some queries and to C for all others.

    De-duplicated, best k, then sigmoid and division by the maximum.
    """
    c = checkpointed(approach_c(a)) if c is None else c
    if mode == "hybrid":
        r = checkpointed(fuse.rerank_hybrid(overlap_logits(a, c)).select("query_id", "frame_id", "score"))
    else:
        b = checkpointed(approach_b(a)) if b is None else b
        r = b.where(F.col("query_id").isin(*fallback_b)).select("query_id", "frame_id", "score").unionByName(c.where(~F.col("query_id").isin(*fallback_b)).select("query_id", "frame_id", "score"))
    top = rank.renumber(rank.temporal_dedup(r, only(a.frames(), r)), k)
    return fuse.squash_top(top)


def rocchio_search(a: Archive, anchors: DataFrame, k: int = TOP_K) -> DataFrame:
    """Search again with each query moved towards its anchor frame: ``anchors(query_id, frame_id)``."""
    v = a.vectors()
    moved = dense.rocchio(a.query_vectors().join(anchors.select("query_id"), "query_id", "left_semi"), anchors.join(v.select("frame_id", "vec"), "frame_id").select("query_id", "vec"))
    return dense.rank_topk(dense.topk_product(moved, v, k, qvec="qvec"), k)


def run_all(a: Archive, k: int = 10, on_failure: str = "empty") -> DataFrame:
    """Batch run: all queries by approaches A to D, de-duplicated, flagged, cut and numbered.

    ``query_id, approach, rank, frame_id, score, stream_name, multi_angle``.
    An approach that fails (or whose signals do) has no rows, and a warning
    says so; the others come out. With ``on_failure="raise"`` it is an error.
    """
    done: dict[str, DataFrame] = {}

    def attempt(name: str, plan: Callable[[], DataFrame]) -> None:
        try:
            done[name] = checkpointed(plan().select("query_id", "frame_id", "score"))
        except Exception as e:
            if on_failure == "raise":
                raise
            warnings.warn(f"approach {name} failed and has no rows: {str(e).splitlines()[0]}", stacklevel=2)

    def needed(name: str) -> DataFrame:
        if name not in done:
            raise RuntimeError(f"needs approach {name}, which failed")
        return done[name]

    def fused() -> DataFrame:
        t, c = dense_text(a)
        return approach_c(a, parts={"bm25": needed("A"), "visual": needed("B"), "transcript": t, "caption": c})

    attempt("A", lambda: approach_a(a))
    attempt("B", lambda: approach_b(a))
    attempt("C", fused)
    attempt("D", lambda: approach_d(a, c=needed("C")))
    if not done:
        return a.spark.createDataFrame([], "query_id string, approach string, rank int, frame_id string, score double, stream_name string, multi_angle boolean")
    # One pass over all lists: the approach is part of the list's name.
    long = reduce(DataFrame.unionByName, [d.select(F.concat_ws("|", "query_id", F.lit(n)).alias("query_id"), "frame_id", "score") for n, d in done.items()])
    f = rank.finish(long, only(a.frames(), long), k)
    q = F.split("query_id", r"\|")
    return f.select(F.get(q, F.lit(0)).alias("query_id"), F.get(q, F.lit(1)).alias("approach"), "rank", "frame_id", F.round("score", 4).alias("score"), "stream_name", "multi_angle")
