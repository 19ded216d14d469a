"""Dense retrieval: exact inner-product top-k, text encoders, relevance feedback."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, l2_normalise, norm

#: Most query vectors a worker multiplies with a batch of rows; more are handled in several passes.
MAX_QUERY_BLOCK = 4_096
#: How many times k rows the dense text search fetches before it keeps the best for each frame.
OVERFETCH = 5
#: Most scores (queries times rows) that a worker holds at a time.
MAX_SCORES = 2_000_000


class Encoder(Protocol):
    """Anything that turns a list of texts (or image paths) into rows of a float matrix."""

    def encode(self, items: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Signed feature hashing of a text's words, a deterministic stand-in for a text encoder that needs no model.

    A word's md5 digest names its dimension and sign; the row holds the sums,
    which are small whole numbers.
    """

    def __init__(self, dims: int = 64):
        self.dims, self._known = dims, {}

    def _place(self, word: str) -> tuple[int, int]:
        if word not in self._known:
            if len(self._known) > 1_000_000:
                self._known.clear()
            h = hashlib.md5(word.encode()).hexdigest()
            self._known[word] = (int(h[:4], 16) % self.dims, 1 if h[4] <= "7" else -1)
        return self._known[word]

    def encode(self, items: list[str]) -> np.ndarray:
        m = np.zeros((len(items), self.dims), dtype=np.float32)
        for i, text in enumerate(items):
            for w in _ASCII_WORD.findall(text.replace("\u0130", "I").lower()):
                d, sign = self._place(w)
                m[i, d] += sign
        return m


_ASCII_WORD = re.compile(r"[a-z0-9]+")


def encode(df: DataFrame, item: str, make: Callable[[], Encoder], out: str = "vec") -> DataFrame:
    """Add a vector column with a pluggable encoder, made once for each worker process; null items get zero vectors.

    Batches arrive by Arrow. An item that fails to encode should come back from
    the encoder as a zero row.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            m = np.asarray(model.encode([x or "" for x in b[item]]), dtype=np.float32)
            m[b[item].isna().to_numpy()] = 0
            yield b.assign(**{out: list(m)})

    return df.mapInPandas(run, schema)


def cosine_scores(queries: DataFrame, vectors: DataFrame, key: str = "frame_id") -> DataFrame:
    """``query_id, <key>, score``: every query with every row, ``queries(query_id, qvec)`` being a stated, checked set.

    The product is computed with native array functions; a zero vector scores 0.
    """
    check_query_set(queries)
    # Norms are computed below the join, once for each row and each query.
    q = queries.select("query_id", "qvec", norm(F.col("qvec")).alias("qn"))
    v = vectors.select(key, "vec", norm(F.col("vec")).alias("vn"))
    n = F.col("qn") * F.col("vn")
    cos = F.when(n == 0, 0.0).otherwise(dot(F.col("qvec"), F.col("vec")) / n)
    return v.join(F.broadcast(q), how="cross").select("query_id", key, F.round(cos, 9).alias("score"))


def check_query_set(queries: DataFrame) -> None:
    """Refuse to broadcast more queries than a block."""
    if queries.limit(MAX_QUERY_BLOCK + 1).count() > MAX_QUERY_BLOCK:
        raise ValueError(f"more than {MAX_QUERY_BLOCK} queries; use topk_matmul, which takes them in blocks")


def topk_vectors(queries: DataFrame, vectors: DataFrame, k: int, key: str = "frame_id") -> DataFrame:
    """``query_id, <key>, score, rank``: exact k best by cosine; ties by key. The rank limit acts before the shuffle."""
    return rank_topk(cosine_scores(queries, vectors, key), k, key)


def _query_matrix(queries: DataFrame | tuple[list[str], np.ndarray], vec: str, most: int | None = MAX_QUERY_BLOCK) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of a stated query set on the driver; its number is checked before it is read."""
    if isinstance(queries, tuple):
        order = sorted(range(len(queries[0])), key=lambda i: queries[0][i])
        q = np.asarray(queries[1], dtype=np.float64).reshape(len(order), -1)[order] if order else np.zeros((0, 1))
        return [queries[0][i] for i in order], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    rows = queries.select("query_id", vec).where(F.col(vec).isNotNull())
    rows = (rows if most is None else rows.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"more than {most} queries; use topk_matmul, which takes them in blocks")
    if not rows:
        return [], np.zeros((0, 1))
    rows.sort(key=lambda r: r[0])
    q = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    return [r[0] for r in rows], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)


def _rows_matrix(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(q: np.ndarray, s: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k best of each query among candidates (query number, score, keys): by score, then by the keys in order."""
    order = np.lexsort((*keys[::-1], -s, q))
    sorted_q = q[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left") < k]


def topk_product(queries: DataFrame | tuple[list[str], np.ndarray], vectors: DataFrame, k: int, keys: tuple[str, ...] = ("frame_id",), qvec: str = "vec", positive: bool = False, best_of: str | None = None, most: int | None = MAX_QUERY_BLOCK) -> DataFrame:
    """``query_id, <keys>, score``: candidates for the k best by cosine (9 places) of each of a stated query set.

    ``queries(query_id, <qvec>)`` or names and matrix of a set that is on the
    driver already; ``vectors(<keys>, vec)`` without null vectors. A matrix product for each slice of an Arrow batch, of at most
    MAX_SCORES scores; each task hands on k rows for each query, those of the
    highest scores, ties by the keys. With ``positive`` scores of 0 and less
    don't count. With ``best_of``, one of the keys, only the best row of each
    of its values counts, which needs no more rows: a value among the k best
    of all is among the k best of the task that holds its best row.
    """
    ids, q = _query_matrix(queries, qvec, most)
    qid_type = "string" if isinstance(queries, tuple) else queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid_type}, " + ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys) + ", score double"
    if not ids:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    step = max(1, MAX_SCORES // len(ids))
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held: list[np.ndarray] = []  # query number, score, keys of what is best so far
        floor = np.full(len(ids), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                s = np.round(q @ _rows_matrix(part.column(len(keys))).T, 9)
                low = floor
                if s.shape[1] > k and best_of is None:
                    low = np.maximum(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                want = s >= low[:, None]
                if positive:
                    want &= s > 0
                qi, ri = np.nonzero(want)
                if not len(qi):
                    continue
                got = [qi, s[qi, ri], *(part.column(i).take(pa.array(ri)).to_numpy(zero_copy_only=False) for i in range(len(keys)))]
                held = got if not held else [np.concatenate(x) for x in zip(held, got)]
                if best_of is not None:
                    # The first of each (query, value) in the order of scores is its best row.
                    order = _best(held[0], held[1], held[2:], len(held[0]))
                    value = held[2 + keys.index(best_of)][order].astype(str)
                    first = np.sort(np.unique(np.rec.fromarrays([held[0][order], value]), return_index=True)[1])
                    held = [x[order[first]] for x in held]
                keep = _best(held[0], held[1], held[2:], k)
                held = [x[keep] for x in held]
                n = np.bincount(held[0], minlength=len(ids))
                least = np.full(len(ids), np.inf)
                np.minimum.at(least, held[0], held[1])
                floor = np.where(n >= k, least, -np.inf)
        if held:
            cols = [pa.array([ids[i] for i in held[0]]), *(pa.array(x) for x in held[2:]), pa.array(held[1])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    return vectors.select(*keys, "vec").mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def topk_matmul(queries: DataFrame, vectors: DataFrame, k: int, key: str = "frame_id", qvec: str = "qvec", block: int = MAX_QUERY_BLOCK) -> DataFrame:
    """``query_id, <key>, score, rank``: as topk_vectors, by matrix products, for any number of queries, taken in blocks of about ``block``."""
    from functools import reduce

    passes = max(1, -(-queries.count() // block))
    some = [queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)]
    return rank_topk(reduce(DataFrame.unionByName, [topk_product(x, vectors, k, (key,), qvec, most=None) for x in some]), k, key)


def best_query(queries: DataFrame, vectors: DataFrame, key: str = "frame_id", qvec: str = "vec") -> DataFrame:
    """``<key>, query_id, score`` (9 places): the most similar of a stated query set for each row; of several the lowest query."""
    ids, q = _query_matrix(queries, qvec)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    step = max(1, MAX_SCORES // max(1, len(ids)))
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, query_id {queries.schema['query_id'].dataType.simpleString()}, score double"
    if not ids:
        return vectors.sparkSession.createDataFrame([], schema)
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value  # in the order of their ids, and argmax takes the first
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                s = np.round(q @ _rows_matrix(part.column(1)).T, 9)
                top = s.argmax(axis=0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids[i] for i in top]).cast(target.field(1).type), pa.array(s[top, np.arange(s.shape[1])])], schema=target)

    return vectors.select(key, "vec").mapInArrow(run, schema)


def rank_topk(scores: DataFrame, k: int | None, key: str = "frame_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rank by score, highest first, ties by key; only the first k if asked."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    r = scores.withColumn("rank", F.row_number().over(w))
    return r if k is None else r.where(F.col("rank") <= k)


def overfetch_dedup(scores: DataFrame, k: int, factor: int = OVERFETCH, row_key: str = "row_index", exact: bool = False) -> DataFrame:
    """Best score for each frame of ``scores(query_id, frame_id, <row_key>, score)``, cut at k.

    As shipped, only the ``factor * k`` best rows are looked at, so fewer than
    k frames may come out; ``exact`` looks at all rows.
    """
    s = scores
    if not exact:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "frame_id", row_key)
        s = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= factor * k)
    return rank_topk(s.groupBy("query_id", "frame_id").agg(F.max("score").alias("score")), k)


def rocchio(queries: DataFrame, anchors: DataFrame, key: str = "query_id") -> DataFrame:
    """Move each query towards its anchor: ``query_id, qvec`` = normalise((q + a) / 2), both of unit length.

    ``queries(query_id, qvec)``, ``anchors(query_id, vec)``; a query without an
    anchor is an error when it is read.
    """
    j = queries.join(anchors.select(key, F.col("vec").alias("a")), key, "left")
    q, a = l2_normalise(F.col("qvec")), l2_normalise(F.col("a"))
    mean = F.zip_with(q, a, lambda x, y: (x + y) / 2)
    checked = F.when(F.col("a").isNull(), F.raise_error(F.concat(F.lit("unknown anchor of query "), F.col(key).cast("string"))).cast("array<double>")).otherwise(l2_normalise(mean))
    return j.select(key, checked.alias("qvec"))


def normalised(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors at unit length, as an index stores them."""
    return vectors.withColumn(vec, l2_normalise(F.col(vec)))
