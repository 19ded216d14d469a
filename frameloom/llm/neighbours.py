"""Problem 2: most similar vectors for every vector.

Randomly rotated one-bit codes. The residual of each vector from a centre is
rotated at random and keeps one bit for each direction, with two scalars that
correct the estimate of an inner product; the other side of a comparison is
rotated alike and rounded to four bits, so the estimate needs only AND and
bit counts. An error bound says how far the true value may lie above the
estimate, and only the vectors that may still be wanted are compared exactly.

For every vector against all (``neighbour_lists``) the vectors are put into the
cells of their nearest centroids, several each; similar vectors meet in a cell.
For a stated query set (``search``) all codes are scanned, in blocks.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes of the sample that the centroids are fitted on (the index holds every row); rows at home in a cell.
SAMPLE_ROWS, SAMPLE_BYTES, HOME_ROWS = 50_000, 64 << 20, 200
#: Centroids of the first level; with more rows than they have homes for, crowded cells get a second level of their own.
MAX_CELLS = 4_096
#: Cells a row is put into at most, and how much less than its nearest centroid's cosine another one's may be.
CELLS_EACH, MARGIN = 6, 0.07
#: Rows of a cell that are compared without a second level, and rows at home in a cell of that level.
SPLIT_ROWS, SUB_HOME_ROWS = 6_000, 600
#: Bytes of vectors that one task takes; cells beyond it are cut into blocks that meet pairwise.
TASK_BYTES = 64 << 20
#: Rows whose cells are packed together before they are sent, and comparisons that a task of the exchange is planned for.
PACK_ROWS, TASK_PAIRS = 65_536, 100_000_000
#: Groups of exact copies up to which their keys are broadcast (20 bytes each).
BROADCAST_GROUPS = 500_000
#: Width of the error bound in standard errors of the estimate.
EPSILON = 3.0
_QUERY_BITS = 4
_BLOCK = 256


def rotation(dim: int, code_bits: int, seed: int = 11) -> np.ndarray:
    """``code_bits x dim`` with orthonormal columns: a random rotation of the zero-padded vector."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_bits, code_bits)))
    return np.ascontiguousarray(q[:, :dim], dtype=np.float32)


class Codes:
    """One-bit codes and correction scalars of unit vectors ``x`` around a centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        bits = turn.shape[0]
        o = (x - centre).astype(np.float32)
        self.r = np.linalg.norm(o, axis=1)
        u = (o / np.maximum(self.r, 1e-12)[:, None]) @ turn.T
        f = np.maximum(np.abs(u).sum(1) / np.sqrt(bits), 1e-6)
        self.words = np.packbits(u > 0, axis=1, bitorder="little").view(np.uint64)
        pop = np.bitwise_count(self.words).sum(1)
        bound = np.sqrt(np.maximum(1 - f * f, 0)) / f * EPSILON / np.sqrt(bits - 1)
        self.scale = (self.r / f).astype(np.float32)
        # Right factor of all terms of the estimate's upper end that are no bit counts.
        self.terms = np.stack([pop * self.scale, self.scale, self.r * bound, x @ centre, np.ones(len(x))]).astype(np.float32)


class Questions:
    """The other side: rotated residuals in four-bit planes."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        bits = turn.shape[0]
        o = (x - centre).astype(np.float32)
        r = np.linalg.norm(o, axis=1)
        v = (o / np.maximum(r, 1e-12)[:, None]) @ turn.T
        lo, top = v.min(1), 2**_QUERY_BITS - 1
        step = np.maximum((v.max(1) - lo) / top, 1e-12)
        whole = np.rint((v - lo[:, None]) / step[:, None]).astype(np.uint8)
        self.planes = [np.packbits((whole >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(_QUERY_BITS)]
        total = lo * bits + step * whole.sum(1)
        root = np.sqrt(bits)
        self.gain = (2 * step * r / root).astype(np.float32)
        self.terms = np.stack([2 * lo * r / root, -total * r / root, r, np.ones(len(x)), x @ centre - centre @ centre], axis=1).astype(np.float32)


def upper_cosines(q: Questions, rows: slice, c: Codes) -> np.ndarray:
    """Upper ends of the cosines of some questions with all codes."""
    total = np.zeros((rows.stop - rows.start, len(c.scale)), dtype=np.uint16)
    for j, plane in enumerate(q.planes):
        for w in range(c.words.shape[1]):
            n = np.bitwise_count(plane[rows, w][:, None] & c.words[:, w][None, :])
            total += n if j == 0 else n.astype(np.uint16) << j
    up = total.astype(np.float32)
    up *= q.gain[rows][:, None]
    up *= c.scale[None, :]
    up += q.terms[rows] @ c.terms
    return up


def _kth(a: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each of n rows, ``a`` holding the row of each value in order; -8 where a row has fewer."""
    out = np.full(n, -8.0, dtype=np.float32)
    order = np.lexsort((-value, a))
    at = np.searchsorted(a, np.arange(n), side="left") + k - 1
    ok = at < np.searchsorted(a, np.arange(n), side="right")
    out[ok] = value[order[at[ok]]]
    return out


def best_of(qx: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, min_cosine: float | None, code_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query id, neighbour id, cosine)`` of the k best of ``x`` for each query, itself left out.

    ``qx`` and ``x`` are unit vectors in double. Equal cosines go by id.
    """
    turn = rotation(x.shape[1], code_bits)
    centre = x.mean(0)
    codes, asks = Codes(x, centre, turn), Questions(qx, centre, turn)
    x32, q32 = x.astype(np.float32), qx.astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(qx), _BLOCK):
        rows = slice(at, min(at + _BLOCK, len(qx)))
        up = upper_cosines(asks, rows, codes)
        up[qid[rows][:, None] == ids[None, :]] = -9
        floor = np.full(rows.stop - at, -8.0 if min_cosine is None else min_cosine, dtype=np.float32)
        if min_cosine is None and len(ids) > 2 * k:
            # The k-th best of those that look best is a floor for what may still be wanted.
            first = np.argpartition(-up, 2 * k - 1, axis=1)[:, : 2 * k]
            near = np.einsum("qd,qkd->qk", q32[rows], x32[first])
            near[np.take_along_axis(up, first, 1) < -8] = -9
            floor = np.maximum(floor, -np.partition(-near, k - 1, axis=1)[:, k - 1] - 1e-5)
        want = up >= floor[:, None]
        if want.mean() > 0.02:
            # Too many to pick one by one: the whole product of the block gives the same numbers.
            near = q32[rows] @ x32.T
            a, b = np.nonzero(want)
            near = near[a, b]
        else:
            a, b = np.nonzero(want)
            near = np.concatenate([np.einsum("nd,nd->n", q32[at + a[s : s + 65_536]], x32[b[s : s + 65_536]]) for s in range(0, len(a), 65_536)]) if len(a) else np.zeros(0, np.float32)
        # All that single precision leaves among the k best stay, however many ties there are.
        ok = near >= np.maximum(floor, _kth(a, near, k, rows.stop - at))[a] - 1e-5
        a, b = a[ok], b[ok]
        cos = np.concatenate([np.einsum("nd,nd->n", qx[at + a[s : s + 65_536]], x[b[s : s + 65_536]]) for s in range(0, len(a), 65_536)]) if len(a) else np.zeros(0)
        if min_cosine is not None:
            ok = cos >= min_cosine
            a, b, cos = a[ok], b[ok], cos[ok]
        order = np.lexsort((ids[b], -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        ok = rank < k
        out.append((qid[at + a[ok]], ids[b[ok]], cos[ok]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        best = np.concatenate([(sample[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(sample), 4096)])
        order = np.argsort(best, kind="stable")
        here, starts = np.unique(best[order], return_index=True)
        c[here] = np.add.reduceat(sample[order], starts, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def usable(vectors: DataFrame) -> DataFrame:
    """``id long, vec`` of the rows with an id and a vector that is neither null nor empty nor all zero and has only finite numbers."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    return v.where((F.size("vec") > 0) & ~odd & F.exists("vec", lambda x: x != 0))


def _census(v: DataFrame, k: int):
    """Of the most frequent vector length (of several the smallest): ``dim``, its rows ``n``, those to search, groups of more than k + 1 copies, and ``rest``, the rows of other lengths. None for no rows."""
    g = v.groupBy(F.size("vec").alias("dim"), *_copy_key()).agg(F.count("*").alias("n"))
    g = g.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.lit(k + 1))).alias("searched"), F.count_if(F.col("n") > k + 1).alias("groups"))
    g = g.withColumn("rest", F.sum("n").over(Window.partitionBy()) - F.col("n"))
    return g.orderBy(F.desc("n"), "dim").limit(1).first()


def _copy_key() -> list[Column]:
    return [F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")]


def _of_one_width(v: DataFrame, k: int, other_width: str) -> tuple[DataFrame, object]:
    """The rows of the most frequent length, and the census; rows of another length are an error or reported."""
    c = _census(v, k)
    if c is None:
        return v, None
    if c.rest:
        text = f"{c.rest} usable vectors have not {c.dim} values like most"
        if other_width == "raise":
            raise ValueError(text)
        warnings.warn(text + " and take no part", stacklevel=3)
    return v.where(F.size("vec") == c.dim), c


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(a), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _split_copies(v: DataFrame, k: int, groups: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows to search, and the lists that groups of more than k + 1 exact copies have without a search.

    Of such a group the k + 1 smallest ids are searched like any others; every
    member has the smallest of the others as neighbours. The groups are counted
    on the map side, and the limit acts before the shuffle, so a group of a
    third of all rows is never gathered. Where the ``groups`` are few enough
    their keys are broadcast, so the vectors themselves aren't shuffled here.
    """
    if not groups:
        return v, None
    small = F.broadcast if groups * (k + 1) <= BROADCAST_GROUPS else lambda d: d
    v = v.select("*", *_copy_key())
    big = v.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2")
    crowd = v.select("h1", "h2", "id").join(small(big), ["h1", "h2"], "left_semi").distinct()
    w = Window.partitionBy("h1", "h2").orderBy("id")
    first = crowd.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    lists = crowd.join(small(first.select("h1", "h2", F.col("id").alias("neighbour"), "place")), ["h1", "h2"])
    one = v.join(small(first.select("h1", "h2", "id")), ["h1", "h2", "id"], "left_semi").select("id", "vec")
    searched = v.join(small(big), ["h1", "h2"], "left_anti").select("id", "vec").unionByName(one)
    return searched, lists.where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))


def _different(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` that differ in the fifth decimal, in their order."""
    return x[np.sort(np.unique(np.round(x, 5) + 0.0, axis=0, return_index=True)[1])]


def _pairs_schema() -> str:
    return "id long, neighbour long, cosine double"


def _cells_of(x: np.ndarray, centroids: np.ndarray, each: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, cell)``: the ``each`` nearest centroids of each unit vector, of which none is further behind the nearest than ``margin``."""
    each = min(each, len(centroids))
    rows, cells = [], []
    for s in range(0, len(x), 4096):
        near = x[s : s + 4096] @ centroids.T
        at = np.argpartition(-near, each - 1, axis=1)[:, :each]
        near = np.take_along_axis(near, at, 1)
        r, c = np.nonzero(near >= near.max(1, keepdims=True) - margin)
        rows.append(r + s)
        cells.append(at[r, c])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pack(ids: np.ndarray, m: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Ids and rows of a block as bytes. Rows that half precision holds without loss go that way, the others in single.

    The bytes of equal weight stand together and are compressed, as those with sign and exponent are much alike.
    """
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    fits = (half.astype(np.float32) == m).all(1)
    for some, x in ((fits, half), (~fits, m.astype(np.float32))):
        if some.any():
            planes = np.ascontiguousarray(x[some].view(np.uint8).reshape(-1, x.itemsize).T)
            yield ids[some].astype(np.int64).tobytes(), bytes([x.itemsize]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(ids: pa.ChunkedArray, rows: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order and unit vectors of packed blocks; an id that comes twice counts once."""
    i = [np.frombuffer(x, dtype=np.int64) for x in ids.to_pylist()]
    m = []
    for n, x in zip(i, rows.to_pylist()):
        width = x[0]
        planes = np.frombuffer(pa.decompress(x[1:], decompressed_size=len(n) * dim * width, codec="zstd"), dtype=np.uint8).reshape(width, -1)
        m.append(np.ascontiguousarray(planes.T).view(np.float16 if width == 2 else np.float32).astype(np.float32).reshape(-1, dim))
    if not i:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    all_ids, at = np.unique(np.concatenate(i), return_index=True)
    return all_ids, _unit(np.concatenate(m)[at])


def _list_table(got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"id": pa.array(got[0], pa.int64()), "neighbour": pa.array(got[1], pa.int64()), "cosine": pa.array(got[2], pa.float64())})


def _join_lists(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of several cells as one: each neighbour once, the k best of each id."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, n, c = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((-c, n, i))
    i, n, c = i[order], n[order], c[order]
    once = np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])] if len(i) else np.zeros(0, bool)
    i, n, c = i[once], n[once], c[once]
    order = np.lexsort((n, -c, i))
    i, n, c = i[order], n[order], c[order]
    ok = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[ok], n[ok], c[ok]


def cell_lists(x: np.ndarray, ids: np.ndarray, second: np.ndarray, k: int, min_cosine: float | None, code_bits: int, each: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, neighbour, cosine)``: the k best of each row among the other rows of its cell.

    With ``second`` (a truth for each row) only rows that differ in it meet. A
    crowded cell gets centroids of its own, fitted on its rows, and is compared
    cell by cell of that second level, so the work grows with its rows and not
    with their square.
    """

    def meet(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not second.any():
            return best_of(x[at], ids[at], x[at], ids[at], k, min_cosine, code_bits)
        a, b = at[second[at]], at[~second[at]]
        both = [best_of(x[p], ids[p], x[q], ids[q], k, min_cosine, code_bits) for p, q in ((a, b), (b, a)) if len(p) and len(q)]
        return _join_lists(both, k)

    if len(x) <= SPLIT_ROWS:
        return meet(np.arange(len(x)))
    step = max(1, len(x) * x.shape[1] * 4 // (SAMPLE_BYTES // 8))
    different = _different(x[::step].astype(np.float32))
    centroids = _different(fit_centroids(different, max(1, min(len(different) // 4, len(x) // SUB_HOME_ROWS))))
    row, cell = _cells_of(x.astype(np.float32), centroids, each, margin)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(centroids) + 1))
    return _join_lists([meet(row[order[a:b]]) for a, b in zip(starts[:-1], starts[1:]) if b - a > 1], k)


def _sample(searched: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors of about SAMPLE_ROWS of the rows to search (fewer if they are wide), picked by a hash of their ids."""
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
    part = max(1, -(-n // rows))
    got = searched.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).limit(2 * rows).select("vec").toArrow().column(0)
    if not len(got):
        got = searched.limit(1000).select("vec").toArrow().column(0)
    return _unit(_matrix(got)).astype(np.float32)


def neighbour_lists(vectors: DataFrame, k: int = 10, min_cosine: float | None = None, code_bits: int | None = None, cells_each: int = CELLS_EACH, margin: float | None = None, home_rows: int = HOME_ROWS, other_width: str = "warn") -> DataFrame:
    """``id, neighbour, cosine, rank``: up to k nearest by cosine for every usable row of ``vectors(id, vec)``.

    Rows whose vector is null, empty, all zero or not finite take no part, nor
    do rows of another length than most, whose number is reported as a warning
    (or, with ``other_width="raise"``, an error). A row that comes twice is one
    row and not its own neighbour. Equal cosines are ranked by id. With
    ``min_cosine`` only neighbours of at least that cosine come out, and the
    codes' error bound drops most others unseen.

    Every row is put into the cells of its nearest centroids: at most
    ``cells_each``, and none whose cosine is behind the nearest's by more than
    ``margin`` (by default MARGIN with a ``min_cosine``, else no limit, as the
    neighbours wanted may then be far away). The centroids are fitted on the different ones of a bounded
    sample; two rows are compared if they share a cell, so a few may be missed,
    fewer the more similar they are. Rows travel in packed blocks, one for each
    cell and task. Crowded cells have a second level of centroids.

    Exact copies beyond the k + 1 smallest ids of a group have only copies as
    neighbours, so they needn't be searched; however many there are, they are
    never all paired with each other.
    """
    spark = vectors.sparkSession
    v, census = _of_one_width(usable(vectors), k, other_width)
    if census is None:
        return spark.createDataFrame([], _pairs_schema() + ", rank int")
    n, dim = census.searched, census.dim
    if margin is None:
        margin = 2.0 if min_cosine is None else MARGIN
    bits = code_bits or max(64, -(-dim // 64) * 64)
    searched, copies = _split_copies(v, k, census.groups)
    sample = _sample(searched, n, dim)
    # Equal rows would start as equal centroids, of which k-means moves only one.
    different = _different(sample)
    # What one task compares anyway needs no cells.
    cells = 1 if n <= SPLIT_ROWS else min(MAX_CELLS, len(different) // 4, n // home_rows)
    centroids = _different(fit_centroids(different, int(max(1, cells))))
    cells = len(centroids)
    # Sizes of the cells as the sample foretells them; one that no task can hold is split into blocks.
    share = np.bincount(_cells_of(sample, centroids, cells_each, margin)[1], minlength=cells) * (n / len(sample))
    blocks = np.maximum(1, np.ceil(share * dim * 4 / TASK_BYTES)).astype(np.int64)
    shared = spark.sparkContext.broadcast((centroids, blocks))  # MAX_CELLS centroids at most
    most = int(blocks.max())
    tasks = int(np.clip((np.minimum(share, SPLIT_ROWS) * share).sum() // TASK_PAIRS, int(spark.conf.get("spark.sql.shuffle.partitions")), cells * most * most))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, bl = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, m = (np.concatenate(p) for p in zip(*held))
            row, cell = _cells_of(_unit(m).astype(np.float32), c, cells_each, margin)
            mine = (ids[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % bl[cell]
            # A row of block b meets every block of its cell: group (cell, lower block, higher block).
            out = bl[cell]
            row, cell, mine = np.repeat(row, out), np.repeat(cell, out), np.repeat(mine, out)
            other = np.arange(len(row)) - np.repeat(np.cumsum(out) - out, out)
            group = (cell * most + np.minimum(mine, other)) * most + np.maximum(mine, other)
            side = mine > other
            order = np.lexsort((side, group))
            row, group, side = row[order], group[order], side[order]
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]) if len(row) else np.zeros(0, np.int64)
            recs = [(int(group[a]), bool(side[a]), *p) for a, b in zip(cuts, [*cuts[1:], len(row)]) for p in _pack(ids[row[a:b]], m[row[a:b]])]
            cols = list(zip(*recs)) or [[]] * 4
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["grp", "second", "ids", "rows"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), _matrix(b.column(1))))
            if sum(len(i) for i, _ in held) * dim * 4 >= min(PACK_ROWS * 256, TASK_BYTES):
                yield flush()
                held = []
        if held:
            yield flush()

    put = searched.mapInArrow(assign, "grp long, second boolean, ids binary, rows binary").repartition(tasks, "grp")

    def meet(t: pa.Table) -> pa.Table:
        sides = [_unpack(p.column("ids"), p.column("rows"), dim) for p in (t.filter(t.column("second")), t.filter(pc.invert(t.column("second"))))]
        ids, x = (np.concatenate(p) for p in zip(*sides))
        second = np.arange(len(ids)) < len(sides[0][0])
        return _list_table(cell_lists(x, ids, second, k, min_cosine, bits, cells_each, margin))

    lists = put.groupBy("grp").applyInArrow(meet, _pairs_schema())
    return _ranked(lists if copies is None else lists.unionByName(copies), k)


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    # One exchange by id serves both the union of a row's lists and their ranking.
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = lists.where("id <> neighbour").repartition(n, "id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, code_bits: int = 128, rows_per_task: int = 25_000, queries_per_task: int = 20_000, other_width: str = "warn") -> DataFrame:
    """``id, neighbour, cosine, rank``: the k nearest of all ``vectors(id, vec)`` for each of ``queries(id, vec)``.

    The codes of all rows are scanned: rows and queries meet in packed blocks of
    a bounded size, and each block gives k rows for each query at most. The
    same rules as in neighbour_lists hold for rows that take no part, rows that
    come twice and equal cosines.
    """
    spark = vectors.sparkSession
    v, census = _of_one_width(usable(vectors), k, other_width)
    if census is None:
        return spark.createDataFrame([], _pairs_schema() + ", rank int")
    dim = census.dim
    bits = max(code_bits, -(-dim // 64) * 64)
    q = usable(queries).where(F.size("vec") == dim)
    rows_per_task = max(1, min(rows_per_task, TASK_BYTES // (4 * dim)))
    shards = max(1, -(-census.n // rows_per_task))
    groups = max(1, -(-q.count() // queries_per_task))

    def packed(d: DataFrame, mine: int, others: int, query_side: bool) -> DataFrame:
        """Blocks ``grp, ask, ids, rows`` of one side; each of its ``mine`` parts goes to all ``others`` of the other side."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, m = b.column(0).to_numpy(), _matrix(b.column(1))
                part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % mine
                recs = []
                for p in np.unique(part):
                    for i, r in _pack(ids[part == p], m[part == p]):
                        recs += [(int(p * shards + o if query_side else o * shards + p), query_side, i, r) for o in range(others)]
                cols = list(zip(*recs)) or [[]] * 4
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["grp", "ask", "ids", "rows"])

        return d.mapInArrow(run, "grp long, ask boolean, ids binary, rows binary")

    both = packed(q, groups, shards, True).unionByName(packed(v, shards, groups, False))

    def meet(t: pa.Table) -> pa.Table:
        (qi, qx), (xi, x) = (_unpack(p.column("ids"), p.column("rows"), dim) for p in (t.filter(t.column("ask")), t.filter(pc.invert(t.column("ask")))))
        got = best_of(qx, qi, x, xi, k, None, bits) if len(qi) and len(xi) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _list_table(got)

    met = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups * shards, 10_000)), "grp").groupBy("grp").applyInArrow(meet, _pairs_schema())
    return _ranked(met, k)


def similar_pairs(vectors: DataFrame, min_cosine: float = 0.85, k: int = 10) -> DataFrame:
    """``row_a, row_b`` (row_a < row_b) with a cosine of at least ``min_cosine``, one being among the other's k nearest."""
    n = neighbour_lists(vectors, k, min_cosine)
    return n.select(F.least("id", "neighbour").cast("int").alias("row_a"), F.greatest("id", "neighbour").cast("int").alias("row_b")).distinct()
