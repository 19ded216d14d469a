"""Problem 7: filling fixed-capacity containers with items.

Swap-based local search: a first packing puts the largest items where they fit
tightest; then documents are moved, exchanged one for one or two for one
between underfull bins as long as the sum of squared fills rises, so that the
least filled bins run empty and are closed. Items are packed in shards of
bounded size, and what stays underfull in the shards is packed again together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import tokens

CAPACITY = 2_048
#: Items that one task packs at a time.
SHARD_ITEMS = 20_000
#: Bins that give in a round (or a twentieth of the underfull ones, if that is more), documents of a bin that
#: are tried in pairs, and pool documents tried as the first of a pair. They bound the search, not what is packed.
GIVING_BINS, PAIR_ITEMS, PAIR_PROBES = 24, 12, 24
SCHEMA = "shard long, bin long, fill long, doc_id long, piece int, n_tokens long"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item positions."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = free.pop(at)
            bins[b].append(i)
            insort(free, (left - sizes[i], b))
    return bins


def _best_exchange(taker: list[int], gap: int, sizes: list[int], pool: list[tuple[int, int]]) -> tuple[int, list[int], list[int]] | None:
    """The exchange that fills a bin's gap best: ``(gain, documents that leave the bin, places in the pool that enter)``.

    Tried are a move into the gap, one for one, two of the bin for one of the
    pool and one of the bin for two of the pool; each looks up the largest
    document that fits, so the gain is as near to the gap as it gets.
    """
    n = len(pool)
    top_id = len(sizes) + 1
    best: tuple[int, list[int], list[int]] | None = None

    def offer(out: list[int], weight: int) -> bool:
        nonlocal best
        at = bisect_right(pool, (weight + gap, top_id)) - 1
        if at >= 0 and (gain := pool[at][0] - weight) > 0 and (best is None or gain > best[0]):
            best = (gain, out, [at])
        return best is not None and best[0] == gap

    if offer([], 0):
        return best
    for j in taker:
        if offer([j], sizes[j]):
            return best
    some = taker[:PAIR_ITEMS]
    for x, j in enumerate(some):
        for k in some[:x]:
            if offer([j, k], sizes[j] + sizes[k]):
                return best
    step = max(1, n // PAIR_PROBES)
    for j in [None, *taker]:
        weight = sizes[j] if j is not None else 0
        for p in range(0, n, step):
            room = weight + gap - pool[p][0]
            if room <= 0:
                break
            q = bisect_right(pool, (room, top_id)) - 1
            if q == p:
                q -= 1
            if q >= 0 and (gain := pool[p][0] + pool[q][0] - weight) > 0 and (best is None or gain > best[0]):
                best = (gain, [] if j is None else [j], [p, q])
                if gain == gap:
                    return best
    return best


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Improve a packing by moves and exchanges between its underfull bins.

    The least filled bins give, all other underfull bins take, fullest first.
    Each exchange makes the taking bin fuller and the giving ones emptier, so
    the sum of squared fills rises. What the givers still hold is put together
    in as few bins as it needs, and those that run empty are closed. Rounds
    follow until no bin is saved; a round that saves none is taken back, so
    there are at most as many as bins.
    """
    while True:
        fill = [sum(sizes[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
        least = -(-sum(sizes[i] for b in bins for i in b) // capacity)
        if len(under) < 2 or len(bins) == least:
            break
        giving = under[: max(1, min(len(under) // 2, max(GIVING_BINS, len(under) // 20)))]
        pool = sorted((sizes[i], i) for b in giving for i in bins[b])
        taking = {b: list(bins[b]) for b in under[len(giving) :][::-1]}
        for b, mine in taking.items():
            gap = capacity - fill[b]
            while gap and pool and (found := _best_exchange(mine, gap, sizes, pool)):
                gain, out, places = found
                enter = [pool[at][1] for at in places]
                for at in sorted(places, reverse=True):
                    pool.pop(at)
                for j in out:
                    mine.remove(j)
                    insort(pool, (sizes[j], j))
                mine += enter
                gap -= gain
        left = [i for _, i in pool]
        again = [[left[x] for x in b] for b in best_fit([sizes[i] for i in left], capacity)]
        if len(again) >= len(giving):
            break
        gone = set(giving)
        bins = [taking.get(b, bins[b]) for b in range(len(bins)) if b not in gone] + again
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, capacity), capacity)


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, n_tokens``: a document larger than the capacity in pieces of it, any other whole."""
    d = sizes.where("n_tokens > 0")
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
    return d.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))


def _pack_round(items: DataFrame, capacity: int, shard_items: int) -> DataFrame:
    """Pack each partition's items in groups of at most ``shard_items``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal k
            pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            sizes = pdf["n_tokens"].tolist()
            at, fill = [0] * len(sizes), [0] * len(sizes)
            for b, members in enumerate(pack(sizes, capacity)):
                total = sum(sizes[i] for i in members)
                for i in members:
                    at[i], fill[i] = b, total
            pdf["shard"], pdf["bin"], pdf["fill"] = base * 1_000_000 + k, at, fill
            k += 1
            return pdf[["shard", "bin", "fill", "doc_id", "piece", "n_tokens"]]

        for b in batches:
            for at in range(0, len(b), shard_items):
                part = b.iloc[at : at + shard_items]
                if n + len(part) > shard_items and held:
                    yield flush(pd.concat(held))
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield flush(pd.concat(held))

    return items.mapInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, path: str | None = None) -> DataFrame:
    """``doc_id, piece, n_tokens, container`` for every document of ``docs(doc_id, text)`` that has tokens.

    A container holds at most ``capacity`` tokens. Only a document that alone
    exceeds it is split, into full pieces and one rest. Null and empty texts
    have no tokens and need no container; an empty table gives an empty result.
    Equal documents are packed like any others.
    """
    return pack_sizes(tokens.encode_documents(docs, path, counts_only=True), capacity, shard_items)


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, full_at: float = 0.995) -> DataFrame:
    """Pack ``doc_id, n_tokens`` (see pack_documents).

    Full pieces are containers of their own. The other items are packed shard
    by shard in two rounds: bins of the first round filled to ``full_at`` are
    closed, and the items of all others are shuffled together and packed anew,
    so what is left underfull is a few bins for each ``shard_items`` items of
    the second round. Nothing is collected, and no task holds more than a shard.
    """
    p = checkpointed(pieces_of(sizes, capacity))  # else each reader below would encode the corpus again
    first = _pack_round(p.where(F.col("n_tokens") < capacity), capacity, shard_items)
    first = checkpointed(first)
    closed = F.col("fill") >= full_at * capacity
    rest = first.where(~closed).select("doc_id", "piece", "n_tokens")
    groups = max(1, -(-rest.count() // shard_items))
    # Every group gets a fair share of all sizes.
    second = _pack_round(rest.repartition(groups, F.xxhash64("doc_id", "piece")), capacity, shard_items)
    name = lambda kind: F.concat_ws("-", F.lit(kind), F.col("shard"), F.col("bin"))
    cols = ["doc_id", "piece", "n_tokens"]
    return (
        p.where(F.col("n_tokens") == capacity).select(*cols, F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"))
        .unionByName(first.where(closed).select(*cols, name("a").alias("container")))
        .unionByName(second.select(*cols, name("b").alias("container")))
    )
