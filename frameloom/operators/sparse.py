"""Sparse retrieval: postings, BM25 over one or more fields, all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, text: str, key: str = "frame_id", split: Callable[[Column], Column] = tokens) -> DataFrame:
    """``term, <key>, tf`` of a text column, cut into terms by ``split``; counts are combined before the shuffle."""
    return docs.select(key, F.explode(split(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def postings_with_length(docs: DataFrame, text: str, split: Callable[[Column], Column] = tokens, key: str = "frame_id") -> DataFrame:
    """``term, <key>, tf, len``: postings that carry the length of their document, so that scoring needs no other table."""
    t = docs.select(key, split(F.col(text)).alias("toks"))
    return t.select(key, F.size("toks").alias("len"), F.explode("toks").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def term_weights(queries: DataFrame, terms: DataFrame, fields: DataFrame, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """``query_id, field, term, idf, avg_len`` of the terms of a stated query set: ``queries(query_id, query_text)``."""
    q = queries.select("query_id", F.explode(F.array_distinct(split(F.col("query_text")))).alias("term"))
    w = terms.join(F.broadcast(q), "term").join(F.broadcast(fields), "field")
    return w.select("query_id", "field", "term", (F.log(F.col("n_docs") / (F.col("df") + 1)) + 1).alias("idf"), "avg_len")


def bm25_fields(postings: DataFrame, weights: DataFrame, fields: list[str], k1: float = K1, b: float = B, key: str = "frame_id") -> DataFrame:
    """``query_id, <key>, <field>...``: BM25 (9 places) of every document with a query term, a column for each field (null without a hit).

    ``postings(field, term, <key>, tf, len)`` is scanned once for all fields
    and queries; the weights of a checked query set's terms are the small side.
    One exchange brings a document's parts together.
    """
    s = postings.where(F.col("field").isin(fields)).join(F.broadcast(weights), ["field", "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return s.groupBy("query_id", key).agg(*[F.round(F.sum(F.when(F.col("field") == f, part)), 9).alias(f) for f in fields])


def field_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row ``n_docs, avg_len``; documents without text count."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("avg_len"))


def bm25(docs: DataFrame, text: str, queries: DataFrame, key: str = "frame_id", k1: float = K1, b: float = B, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """``query_id, <key>, score`` (9 places) of every document with a query term; ``queries(query_id, query_text)``.

    Texts and queries are cut into terms by ``split``. A query's terms count once. idf(t) = ln(N / (df + 1)) + 1. The documents
    are scanned once: only postings of query terms are kept, the query terms
    being the small side, and the document length travels with the posting.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(split(F.col("query_text")))).alias("term"))
    terms = q.select("term").distinct()
    t = docs.select(key, split(F.col(text)).alias("toks")).withColumn("len", F.size("toks"))
    p = t.select(key, "len", F.explode("toks").alias("term")).join(terms, "term", "left_semi").groupBy("term", key, "len").agg(F.count("*").alias("tf"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    stats = t.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    # One row of statistics, and as many terms as the queries have.
    w = q.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log(F.col("n_docs") / (F.col("df") + 1)) + 1)
    s = p.join(w, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return s.groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))


def weighted_sum(parts: list[tuple[float, DataFrame]], key: str = "frame_id") -> DataFrame:
    """Outer union of score lists, each with its weight: one shuffle however many lists."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, [d.select("query_id", key, (F.col("score") * w).alias("score")) for w, d in parts])
    return all_.groupBy("query_id", key).agg(F.round(F.sum("score"), 9).alias("score"))
