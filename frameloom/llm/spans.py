"""Problem 8: long exact spans shared between records.

De Bruijn compaction over sampled k-mers. Every text is read as a sequence of
tokens: the character k-mers that are smallest in some window (minimisers), so
any common run of ``min_chars`` characters, wherever it lies, has a token in
both texts. Each token is an edge of the graph, and each junction links a token
to the next one of its text at a given distance. Tokens of one text only drop
out. Where all occurrences of a token go on to the same next token, and all of
that one come from it, the two belong to a nonbranching path; Spark joins mark
these junctions and each text's stretch of a path becomes one row. Texts that
share a path are candidates, and the characters at their source coordinates
decide how long the common run really is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

MIN_CHARS = 150
#: Characters of a token. With windows of MIN_CHARS - K + 1 tokens, two texts with a common run of MIN_CHARS share one.
K = 64
#: Characters hashed at a time; longer texts go in overlapping pieces.
PIECE = 800_000
#: Texts of one path that a single group pairs up; more are spread over several groups.
PATH_BLOCK = 512
#: Stretches of a path up to which shared_share compares each with each other; beyond, it compares hashes of windows.
CROWD = 32
#: Documents up to which their ids are broadcast to pick the texts that are compared (8 bytes each).
BROADCAST_DOCS = 1_000_000
#: Bits for each repeated token in the map that every task gets, the binary logarithm of the map's most bits, and of its slices.
BITS_EACH, MAX_BITS_LOG, SLICES_LOG = 16, 28, 6

_B = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xD6E8FEB86659FD93)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 20) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _hash_kmers(codes: np.ndarray, k: int, base: np.uint64 = _B) -> np.ndarray:
    """64-bit hash of each k-mer of the code points, by doubling its length."""
    power, length, h = base, 1, _mix(codes.astype(np.uint64) + np.uint64(1))
    total, done = None, 0
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if total is None:
                    total, done, total_power = h, length, power
                else:
                    m = len(codes) - done - length + 1
                    total = total[: max(m, 0)] * power + h[done : done + max(m, 0)]
                    done += length
            left >>= 1
            if left:
                m = max(len(h) - length, 0)
                h = h[:m] * power + h[length : length + m]
                power = power * power
                length *= 2
    return _mix(total)


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w entries."""
    length = 1
    while length * 2 <= w:
        a = np.minimum(a[:-length], a[length:])
        length *= 2
    return np.minimum(a[: len(a) - (w - length)], a[w - length :]) if w > length else a


def minimisers(codes: np.ndarray, ends: np.ndarray, k: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled k-mers of several texts laid end to end.

    ``ends`` holds the end of each text. A window is the k-mers of ``min_chars``
    characters of one text; of equal smallest hashes the rightmost is taken.
    The 44 leading bits of a hash decide which is smallest.
    """
    w = min_chars - k + 1
    if len(codes) < min_chars:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hash_kmers(codes, k)
    at = np.arange(len(h), dtype=np.uint64)
    low = _window_min((h & ~_LOW) | (_LOW - at), w)
    first = np.arange(len(low))
    inside = first + min_chars <= ends[np.searchsorted(ends, first, side="right")]
    got = (_LOW - (low[inside] & _LOW)).astype(np.int64)
    got = got[np.r_[True, got[1:] != got[:-1]]] if len(got) else got
    return got, h[got]


def tokens_of(texts: list[str], k: int = K, min_chars: int = MIN_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(number of the text, position, hash)`` of the sampled k-mers, in order of text and position."""
    held, size = [], 0

    def flush():
        codes = np.concatenate([c for _, _, c in held])
        lens = np.array([len(c) for _, _, c in held])
        ends = np.cumsum(lens)
        pos, h = minimisers(codes, ends, k, min_chars)
        which = np.searchsorted(ends, pos, side="right")
        return np.array([n for n, _, _ in held])[which], pos - (ends - lens)[which] + np.array([o for _, o, _ in held])[which], h

    for n, t in enumerate(texts):
        if t is None or len(t) < min_chars:
            continue
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # Pieces overlap by one character less than a window, so that each window lies in exactly one.
        for at in range(0, len(codes) - min_chars + 1, PIECE):
            c = codes[at : at + PIECE + min_chars - 1]
            if size + len(c) > _LOW - np.uint64(1) and held:
                yield flush()
                held, size = [], 0
            held.append((n, at, c))
            size += len(c)
            if size > PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _unlike(texts: list[str], n: np.ndarray, pos: np.ndarray, h: np.ndarray, k: int, min_chars: int) -> np.ndarray:
    """Which tokens to keep if of equal tokens of a text that also have equal surroundings only the first counts.

    A common run of min_chars characters around a token lies within its
    surroundings (min_chars - k characters before and after), so another token
    with the same ones finds nothing else. A period thus gives a few tokens
    for each of its ends and one for all between.
    """
    order = np.lexsort((pos, h, n))
    same = (n[order][1:] == n[order][:-1]) & (h[order][1:] == h[order][:-1])
    keep = np.ones(len(n), bool)
    if not same.any():
        return keep
    side, seen = min_chars - k, set()
    for i in order[np.r_[False, same] | np.r_[same, False]].tolist():
        p = int(pos[i])
        around = (int(n[i]), int(h[i]), min(p, side), texts[n[i]][max(0, p - side) : p + min_chars])
        keep[i] = around not in seen
        seen.add(around)
    return keep


def sampled_kmers(docs: DataFrame, k: int = K, min_chars: int = MIN_CHARS, unlike: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
    """``doc_id, pos, edge`` of every sampled k-mer of ``docs(doc_id, text)``; texts shorter than min_chars have none.

    With ``unlike`` a token that a text repeats comes out once for each of its
    different surroundings, which is enough to find the pairs of texts.
    ``wanted`` is a map of bits (see edge_bits); tokens without theirs are left
    out where they are made.
    """
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                texts = part.column(1).to_pylist()
                for n, pos, h in tokens_of(texts, k, min_chars):
                    # A piece may begin or end at the same k-mer as its neighbour.
                    keep = np.r_[True, (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])] if len(n) else np.zeros(0, bool)
                    if shared is not None:
                        bits = shared.value
                        place = _place(h, len(bits).bit_length() + 2)
                        keep &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    n, pos, h = n[keep], pos[keep], h[keep]
                    if unlike and len(n):
                        keep = _unlike(texts, n, pos, h, k, min_chars)
                        n, pos, h = n[keep], pos[keep], h[keep]
                    yield pa.record_batch([pa.array(ids[n], pa.int64()), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "pos", "edge"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= min_chars)
    return d.mapInArrow(run, "doc_id long, pos int, edge long")


def repeated_edges(kmers: DataFrame) -> DataFrame:
    """``edge`` of the tokens that stand in more than one text.

    The documents of each token are reduced to a smallest and a largest one on
    the map side, so a token of a third of all texts costs no more than any
    other.
    """
    return checkpointed(kmers.groupBy("edge").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("edge"))


def _place(h: np.ndarray, log: int) -> np.ndarray:
    """Place of a token in a map of 2 ** log bits. Sampled hashes are small ones, so they are mixed again."""
    return (h * _M1) >> np.uint64(64 - log)


def edge_bits(edges: DataFrame) -> np.ndarray:
    """A map of bits in which those of the given tokens are set.

    It has about BITS_EACH bits for each token, at most 2 ** MAX_BITS_LOG (32
    MB), so it is of bounded size however many tokens there are; a fuller map
    lets more others through, which the exact join then drops. Slices are
    built by tasks of their own, and only finished slices reach the driver.
    """
    log = int(np.clip(np.ceil(np.log2(BITS_EACH * edges.count() + 1)), SLICES_LOG + 3, MAX_BITS_LOG))
    size = 1 << (log - SLICES_LOG)  # bits of a slice

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            place = b.column(0).to_numpy()
            for k in np.unique(place // size).tolist():
                slices.setdefault(k, np.zeros(size, bool))[place[place // size == k] % size] = True
        yield pa.record_batch([pa.array(list(slices), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in slices.values()], pa.binary())], names=["slice", "bits"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(_place(b.column(0).to_numpy().view(np.uint64), log).astype(np.int64))], names=["place"])

    place = edges.select("edge").mapInArrow(places, "place long")
    got = place.repartition(F.floor(F.col("place") / size)).mapInArrow(build, "slice long, bits binary").collect()
    out = np.zeros((1 << log) // 8, np.uint8)
    for k, bits in got:
        out[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(bits, np.uint8)
    return out


def repeated_tokens(kmers: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The tokens that stand in more than one text (``edges``, if they are known already); the adaptive skew join splits a hot one."""
    return kmers.join(repeated_edges(kmers) if edges is None else edges, "edge")


def paths(repeated: DataFrame, k: int = K, min_chars: int = MIN_CHARS) -> DataFrame:
    """Compact nonbranching paths: ``path, doc_id, start, stop, gap`` of each text's stretch of a path (stop exclusive).

    ``gap`` is the widest step between two tokens of the stretch.

    Two tokens of a text are linked if they are at most a window apart. A
    junction is nonbranching if every occurrence of its first token goes on to
    the second at this distance and every occurrence of the second comes from
    the first. Every text on such a junction passes it whole, so a path is
    named by its first token wherever it occurs.
    """
    w = min_chars - k + 1
    d = Window.partitionBy("doc_id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(d)
    t = repeated.select("doc_id", "pos", "edge", F.when(gap <= w, F.lag("edge").over(d)).alias("before"), F.when(gap <= w, gap).alias("gap"))
    nxt = F.lead("pos").over(d) - F.col("pos")
    t = t.withColumn("came", F.when(gap <= w, F.xxhash64("before", "gap")).otherwise(0)).withColumn("goes", F.when(nxt <= w, F.xxhash64(F.lead("edge").over(d), nxt)).otherwise(0))
    # One row for each token: partial aggregates, however many texts hold it.
    node = t.groupBy("edge").agg((F.min("came") == F.max("came")).alias("one_in"), (F.min("goes") == F.max("goes")).alias("one_out"))
    t = t.select("doc_id", "pos", "edge", "gap", F.col("before").isNotNull().alias("linked")).join(node, "edge")
    inner = F.col("linked") & F.col("one_in") & F.lag("one_out").over(d)
    t = t.withColumn("first", F.coalesce((~inner).cast("int"), F.lit(1)))
    t = t.withColumn("run", F.sum("first").over(d.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc_id", "run").agg(F.min_by("edge", "pos").alias("path"), F.min("pos").alias("start"), (F.max("pos") + k).alias("stop"), F.coalesce(F.max(F.when(F.col("first") == 0, F.col("gap"))), F.lit(0)).alias("gap")).select("path", "doc_id", "start", "stop", "gap")


def exact_copies(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, rep`` for the texts that others hold whole: the smallest doc_id stands for its copies (rep has a row too)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("key"), F.length("text").alias("n")).where(F.col("n") >= min_chars)
    many = d.groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top").drop("top")
    return d.join(many, ["key", "n"]).select("doc_id", "rep")


def candidates(stretches: DataFrame, block: int = PATH_BLOCK) -> DataFrame:
    """``a, b, diag, lo, hi``: texts a < b that share paths, by the offset of b's coordinates to a's.

    The pairs of a path are those that have to come out; a path of many texts
    is split into blocks of texts that different tasks pair up.
    """
    size = stretches.groupBy("path").agg(F.ceil(F.count("*") / block).cast("int").alias("salts")).where(F.col("salts") >= 1)
    o = stretches.join(size, "path")
    left = o.select("path", F.col("doc_id").alias("a"), F.col("start").alias("at"), "stop", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int").alias("salt"))
    right = o.select("path", F.col("doc_id").alias("b"), F.col("start").alias("bt"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    p = left.join(right, ["path", "salt"]).where("a < b")
    return p.groupBy("a", "b", (F.col("bt") - F.col("at")).alias("diag")).agg(F.min("at").alias("lo"), F.max("stop").alias("hi"))


def common_runs(x: str, y: str, min_chars: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the stretches of at least ``min_chars`` places at which two strings agree."""
    n = min(len(x), len(y))
    if n < min_chars:
        return []
    a = np.frombuffer(x[:n].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = np.frombuffer(y[:n].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.r_[-1, np.flatnonzero(a != b), n]
    length = np.diff(stops) - 1
    return [(int(s) + 1, int(m)) for s, m in zip(stops[:-1], length) if m >= min_chars]


def _texts_of(docs: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids(doc_id)``, where they are few enough to be told to every task; else of all long enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= min_chars)
    ids = ids.select("doc_id").distinct()
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else texts


def verified_spans(cand: DataFrame, texts: DataFrame, min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """``a, b, start_a, start_b, length`` of the common runs at the candidates' coordinates, compared character by character.

    Every window of min_chars characters around a token ends at most
    min_chars - k characters beside it, so no more is looked at; longer runs
    have further tokens.
    """
    side = min_chars - k
    c = cand.withColumn("at", F.greatest(F.lit(0), F.col("lo") - side, -F.col("diag"))).withColumn("n", F.col("hi") + side - F.col("at"))
    key = ["a", "b", "diag", "at"]
    want = c.select(*key, "n", F.col("a").alias("doc_id"), F.lit(0).alias("side"), F.col("at").alias("begin"))
    want = want.unionByName(c.select(*key, "n", F.col("b").alias("doc_id"), F.lit(1).alias("side"), (F.col("at") + F.col("diag")).alias("begin")))
    # Each text is sent once; only the wanted slices go on.
    cut = want.join(texts, "doc_id").select(*key, "side", F.substring(F.col("text"), F.col("begin") + 1, F.col("n")).alias("slice"))
    both = cut.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("slice"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("slice"))).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.a, r.b, r.at + s, r.at + r.diag + s, m) for r in b.itertuples(index=False) for s, m in common_runs(r.x, r.y, min_chars)]
            yield pd.DataFrame(rows, columns=["a", "b", "start_a", "start_b", "length"])

    return both.mapInPandas(run, "a long, b long, start_a int, start_b int, length int")


def shared_stretches(docs: DataFrame, min_chars: int = MIN_CHARS, k: int = K, unlike: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stretches of paths of different texts (one document standing for its exact copies), and the copies."""
    # Both are read several times and are small beside the tokens they come from.
    copies = checkpointed(exact_copies(docs, min_chars))
    edges = repeated_edges(sampled_kmers(docs, k, min_chars, unlike))
    # The texts are read again, but only what may be repeated is sent again.
    stretches = paths(repeated_tokens(sampled_kmers(docs, k, min_chars, unlike, edge_bits(edges)), edges), k, min_chars)
    return checkpointed(stretches.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")), copies


def window_spans(stretches: DataFrame, texts: DataFrame, min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """``rep, s, e``: the runs of min_chars characters around the given stretches that another document holds too.

    Every window of min_chars characters that holds a stretch's first or last
    token gets a hash of 128 bits, and so has the whole stretch where its
    tokens leave no character out; where they do, every window of it. Hashes of
    more than one document are shared; they are counted by the smallest and
    largest document on the map side. The rows grow with the stretches.
    """
    w = min_chars - k + 1
    per = stretches.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "gap"))).alias("parts"))  # bounded by the text's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, parts, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                last = len(codes) - min_chars
                want = np.zeros(max(last + 1, 0), bool)
                whole = []
                for p in parts:
                    start, stop = p["start"], p["stop"]
                    if p["gap"] <= k and stop - start >= min_chars:
                        whole.append((start, stop - start))
                        want[max(0, start - w + 1) : max(0, start)] = True
                        want[max(0, stop - min_chars + 1) : stop - k + 1] = True
                    else:
                        want[max(0, start - w + 1) : stop - k + 1] = True
                at = np.flatnonzero(want)
                h1, h2 = (_hash_kmers(codes, min_chars, x)[at] if len(at) else np.zeros(0, np.uint64) for x in (_B, _B2))
                if whole:
                    more = [[_hash_kmers(codes[a : a + n], n, x)[0] for a, n in whole] for x in (_B, _B2)]
                    h1, h2 = (np.r_[h, np.array(m, np.uint64)] for h, m in zip((h1, h2), more))
                n = np.r_[np.full(len(at), min_chars), np.array([n for _, n in whole], np.int64)].astype(np.int32)
                at = np.r_[at, np.array([a for a, _ in whole], np.int64)].astype(np.int32)
                yield pa.record_batch([pa.array(np.full(len(at), doc), pa.int64()), pa.array(at), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "at", "n", "h1", "h2"])

    # The text's few stretches travel to it.
    r = per.join(texts, "doc_id").select("doc_id", "parts", "text").mapInArrow(run, "doc_id long, at int, n int, h1 long, h2 long")
    r = checkpointed(r)
    many = r.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("lo", "hi")
    return r.join(many, ["h1", "h2", "n"]).select(F.col("doc_id").alias("rep"), F.col("at").alias("s"), (F.col("at") + F.col("n")).alias("e"))


def shared_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_a, doc_b`` (doc_a < doc_b): documents with a common run of at least ``min_chars`` characters.

    Characters are Unicode code points, compared exactly, white space included.
    Null, empty and shorter texts are in no pair. Exact copies are compared
    once for all and written out at the end. doc_id is taken as unique; other
    columns are ignored.
    """
    stretches, copies = shared_stretches(docs, min_chars, unlike=True)
    spans = verified_spans(candidates(stretches), _texts_of(docs, stretches, min_chars), min_chars)
    pairs = spans.select("a", "b").distinct()
    for side in ("a", "b"):
        m = copies.select(F.col("rep").alias(side), F.col("doc_id").alias("member"))
        pairs = pairs.join(m, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    twins = copies.alias("l").join(copies.alias("r"), F.col("l.rep") == F.col("r.rep")).where("l.doc_id < r.doc_id").select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"))
    return pairs.unionByName(twins).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def shared_share(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_chars, shared_chars, share`` of every document.

    A character is shared if it lies in a run of at least ``min_chars``
    characters that another document holds too. Null and empty texts have 0
    characters and share 0; a text with an exact copy is shared whole if long
    enough.
    """
    stretches, copies = shared_stretches(docs, min_chars)
    crowded = stretches.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("path")
    texts = _texts_of(docs, stretches, min_chars)
    spans = verified_spans(candidates(stretches.join(crowded, "path", "left_anti")), texts, min_chars)
    cover = spans.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("start_a").alias("s"), "length"), F.struct(F.col("b").alias("rep"), F.col("start_b").alias("s"), "length"))).alias("x"))
    cover = cover.select("x.rep", "x.s", (F.col("x.s") + F.col("x.length")).alias("e"))
    hot = stretches.join(crowded, "path", "left_semi")
    cover = cover.unionByName(window_spans(hot, _texts_of(docs, hot, min_chars), min_chars)).distinct()
    w = Window.partitionBy("rep").orderBy("s", "e")
    reached = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cover = cover.withColumn("fresh", F.greatest(F.lit(0), F.col("e") - F.greatest("s", reached))).groupBy("rep").agg(F.sum("fresh").alias("covered"))
    copies = copies.select("doc_id", F.lit(True).alias("copied"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    d = d.join(cover.withColumnRenamed("rep", "doc_id"), "doc_id", "left").join(copies, "doc_id", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return d.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))
