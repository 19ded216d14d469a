"""Problem 1: repeated consecutive events in sequences.

Adjacent agglomeration: every event starts as a run of its own; a linked list
holds the runs of an entity in time order and a priority queue holds the
similarity of each neighbouring pair. The most similar pair is merged again and
again until no pair reaches the wanted similarity within the gap limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import frame_id_of, offset_of, parse_frame
from ..functions.scores import TIERS, read_tier

RUN_SCHEMA = "entity string, block long, start_t double, end_t double, n long, state string, edge int"


def agglomerate(times, states, max_gap: float, min_similarity: float, ends=None, counts=None) -> list[tuple[int, int, dict]]:
    """Runs ``(first, last, histogram)`` of one time-ordered sequence of events, or of runs with ``ends`` and ``counts``.

    Similarity of two runs is the overlap of their state distributions (1 for
    the same distribution, 0 for disjoint ones); equal similarities merge from
    the left. A merge is allowed if the runs are at most ``max_gap`` apart.
    """
    n = len(times)
    last, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    ends = times if ends is None else ends
    size, version = [1] * n if counts is None else list(counts), [0] * n
    hist: list[dict] = [{s: c} for s, c in zip(states, size)]
    alive = [True] * n

    def similarity(a: int, b: int) -> float:
        ha, hb = hist[a], hist[b]
        if len(ha) == 1 and len(hb) == 1:
            return 1.0 if next(iter(ha)) == next(iter(hb)) else 0.0
        return sum(min(c / size[a], hb[s] / size[b]) for s, c in ha.items() if s in hb)

    def candidate(a: int):
        b = nxt[a]
        if b < n and times[b] - ends[last[a]] <= max_gap:
            s = similarity(a, b)
            if s >= min_similarity:
                return (-s, a, b, version[a], version[b])
        return None

    heap = [c for c in map(candidate, range(n)) if c]
    heapq.heapify(heap)
    while heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or version[a] != va or version[b] != vb:
            continue
        for s, c in hist[b].items():
            hist[a][s] = hist[a].get(s, 0) + c
        size[a] += size[b]
        last[a], nxt[a], alive[b] = last[b], nxt[b], False
        if nxt[a] < n:
            prv[nxt[a]] = a
        version[a] += 1
        for left in (a, prv[a]):
            if left >= 0 and (c := candidate(left)):
                heapq.heappush(heap, c)
    return [(a, last[a], hist[a]) for a in range(n) if alive[a]]


def collapse_runs(events: DataFrame, max_gap: float, min_similarity: float = 1.0, block_sec: int = 21_600) -> DataFrame:
    """Collapse runs of like events of each entity.

    ``events`` has ``entity string, t double, state string``, one row per event.
    Result: ``entity, state, start_t, end_t, n`` with one row per run; ``state``
    is the most frequent of the run (the alphabetically first of several).
    Events with a null entity, time or state are absent. Events at the same time
    are ordered by state. An empty input gives an empty result.

    Equal states have similarity 1, the highest, so they merge before all
    others, and in any order. A sequence is therefore cut into blocks of
    ``block_sec`` whose runs of equal states are found in parallel; only the two
    outermost runs of a block are then stitched over the entity, so no task ever
    holds a whole hot entity. Below similarity 1 the runs, not the events, are
    agglomerated further, stretch by stretch: a stretch ends where the gap
    exceeds ``max_gap``, which no merge can cross. Its cuts are counted block by
    block, so nothing is ordered over a whole entity but one row for each block.
    """
    e = events.select("entity", F.col("t").cast("double").alias("t"), "state").where("entity is not null and t is not null and state is not null")
    e = e.withColumn("block", F.floor(F.col("t") / block_sec).cast("long"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[list]) -> pa.RecordBatch:
            rows = []
            for entity, block, ts, ss in parts:
                got = [(entity, block, ts[a], ts[b], sum(h.values()), ss[a], 0) for a, b, h in agglomerate(ts, ss, max_gap, 1.0)]
                for at in {0, len(got) - 1}:
                    got[at] = (*got[at][:-1], 1)
                rows += got
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["entity", "block", "start_t", "end_t", "n", "state", "edge"])

        held: list | None = None  # a block may go on in the next batch
        for b in batches:
            parts = []
            for entity, block, t, state in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None or held[0] != entity or held[1] != block:
                    if held is not None:
                        parts.append(held)
                    held = [entity, block, [], []]
                held[2].append(t)
                held[3].append(state)
            yield found(parts)
        if held is not None:
            yield found([held])

    # A stated number of partitions: by their few bytes the adaptive plan would put all blocks into one or two tasks.
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = e.select("entity", "block", "t", "state").repartition(n, "entity", "block").sortWithinPartitions("entity", "block", "t", "state")
    runs = e.mapInArrow(blocks, RUN_SCHEMA)
    keep = ["entity", "state", "start_t", "end_t", "n"]
    # Only the outermost runs of a block share the entity's lane; the others stay in lanes of their own.
    lane = F.when(F.col("edge") == 1, F.lit(-1)).otherwise(F.col("block"))
    w = Window.partitionBy("entity", "lane").orderBy("start_t", "end_t", "state")
    prev = lambda c: F.lag(c).over(w)
    joins = (F.col("lane") == -1) & (F.col("block") != prev("block")) & (F.col("state") == prev("state")) & (F.col("start_t") - prev("end_t") <= max_gap)
    s = runs.withColumn("lane", lane).withColumn("new", F.coalesce((~joins).cast("long"), F.lit(1)))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = s.groupBy("entity", "lane", "run", "state").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.sum("n").alias("n")).select(*keep)
    return r if min_similarity >= 1.0 else _merge_further(r, max_gap, min_similarity, block_sec, n)


def _merge_further(runs: DataFrame, max_gap: float, min_similarity: float, block_sec: int, tasks: int) -> DataFrame:
    """Agglomerate runs of equal states below similarity 1, each gap-free stretch by itself."""
    order = ("start_t", "end_t", "state")
    w = Window.partitionBy("entity", "block").orderBy(*order)
    r = runs.withColumn("block", F.floor(F.col("start_t") / block_sec).cast("long"))
    r = r.withColumn("cut", F.coalesce((F.col("start_t") - F.lag("end_t").over(w) > max_gap).cast("long"), F.lit(0)))
    r = r.withColumn("cuts", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = r.groupBy("entity", "block").agg(F.min("start_t").alias("first_t"), F.max("end_t").alias("last_t"), F.max("cuts").alias("inside"))
    over = Window.partitionBy("entity").orderBy("block")
    b = b.withColumn("head", F.coalesce((F.col("first_t") - F.lag("last_t").over(over) > max_gap).cast("long"), F.lit(0)))
    before = F.coalesce(F.sum(F.col("head") + F.col("inside")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head")
    r = r.join(b.select("entity", "block", before.alias("before")), ["entity", "block"]).withColumn("stretch", F.col("before") + F.col("cuts"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        ts, es = pdf["start_t"].tolist(), pdf["end_t"].tolist()
        got = agglomerate(ts, pdf["state"].tolist(), max_gap, min_similarity, es, pdf["n"].tolist())
        rows = [(pdf["entity"].iloc[0], min(h, key=lambda s: (-h[s], s)), ts[a], es[b], sum(h.values())) for a, b, h in got]
        return pd.DataFrame(rows, columns=["entity", "state", "start_t", "end_t", "n"])

    r = r.select("entity", "stretch", "state", "start_t", "end_t", "n").repartition(tasks, "entity", "stretch")
    return r.groupBy("entity", "stretch").applyInPandas(one, "entity string, state string, start_t double, end_t double, n long")


def tier_events(classified: DataFrame) -> DataFrame:
    """One event per frame of qaff_classified: ``entity`` (stream__day), ``t`` (seconds of the day), ``state`` (tier).

    A frame has the tier of its latest ``scored_at`` among the rows with a
    readable tier (of equal times the alphabetically last; a null time is the
    earliest). Rows that name no frame are left out.
    """
    f = parse_frame(F.col("frame_id"), F.col("full_path_resized"), strict=True)
    e = classified.select(f.alias("f"), read_tier(F.col("tier")).alias("state"), F.col("scored_at")).where("state is not null").where("f is not null")
    t = F.col("f.hour") * 3600 + offset_of(F.col("f.frame_index"))
    e = e.select(F.concat_ws("__", "f.stream", "f.day").alias("entity"), t.alias("t"), "state", "scored_at").groupBy("entity", "t")
    if classified.schema["scored_at"].dataType.typeName().startswith("timestamp"):
        # Time and tier as one number, so that the latest is a plain maximum of a hash aggregate.
        names = F.array(*[F.lit(x) for x in sorted(TIERS)])
        at = F.coalesce(F.unix_micros(F.col("scored_at").cast("timestamp")), F.lit(-(1 << 60)))
        e = e.agg(F.max(at * 4 + F.array_position(names, F.col("state"))).alias("best")).withColumn("state", F.element_at(names, F.pmod(F.col("best"), F.lit(4)).cast("int")))
    else:
        e = e.agg(F.max(F.struct("scored_at", "state"))["state"].alias("state"))
    return e.select("entity", F.col("t").cast("double").alias("t"), "state")


def tier_runs(classified: DataFrame, max_gap: float = 15.0) -> DataFrame:
    """Runs of equal tiers: ``stream_name, day, tier, first_frame_id, last_frame_id, n_frames, duration_sec``."""
    r = collapse_runs(tier_events(classified), max_gap)
    stream, day = F.regexp_extract("entity", r"^(.+)__(day\d+)$", 1), F.regexp_extract("entity", r"^(.+)__(day\d+)$", 2)

    def frame_at(t: str) -> Column:
        s = F.col(t).cast("int")
        return frame_id_of(stream, day, F.floor(s / 3600).cast("int"), (F.floor(s % 3600 / 5) + 1).cast("int"))

    return r.select(
        stream.alias("stream_name"), day.alias("day"), F.col("state").alias("tier"), frame_at("start_t").alias("first_frame_id"), frame_at("end_t").alias("last_frame_id"),
        F.col("n").alias("n_frames"), (F.col("end_t") - F.col("start_t")).cast("int").alias("duration_sec"),
    )
