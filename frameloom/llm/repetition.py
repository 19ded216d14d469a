"""Problem 5: repetition inside a single document.

Every text gets cheap rule statistics: how many of its words, and of its pairs
of neighbouring words, aren't its first. An isolation forest of random splits,
grown on a bounded sample, turns them into path lengths: a text that few splits
isolate is an anomaly. The threshold is calibrated on the sample's rows, which
the exact rule has labelled, and lowered to the smallest score that a text of
the rule's region can have, so no case falls below it. The exact share is
computed only for the texts the forest lets through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Rule statistics, all between 0 and 1: words, and pairs of neighbouring words, that have stood before in the text.
FEATURES = ("old_word_share", "old_pair_share")
#: Rows the forest is grown on and its threshold calibrated with (at most), rows of one tree, trees.
SAMPLE_ROWS, TREE_ROWS, TREES = 20_000, 256, 64
MIN_WORDS, MIN_SHARE = 8, 0.4


def least_features(share: float) -> tuple[float, float]:
    """What a repeated share implies: its words have stood before, and of three repeated words at least two pairs have."""
    return share, share * 2 / 3


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


def cheap_statistics(words: list[str]) -> tuple[float, float]:
    """The FEATURES of a text's words; fewer than two words have zeros."""
    n = len(words)
    if n < 2:
        return 0.0, 0.0
    return 1 - len(set(words)) / n, 1 - len(set(zip(words, words[1:]))) / (n - 1)


def repeated_share(words: list[str]) -> float:
    """Share of the words that lie in three consecutive ones which already stood in the same order earlier; 0 without words."""
    seen: set[tuple[str, str, str]] = set()
    covered, until = 0, 0
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if t in seen:
            covered += i + 3 - max(i, until)
            until = i + 3
        else:
            seen.add(t)
    return covered / len(words) if words else 0.0


def _c(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random-split trees as flat arrays: feature (-1 at a leaf), cut, children, path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.rows = [], min(tree_rows, max(len(x), 1))
        for _ in range(trees):
            self.trees.append(self._grow(x[rng.choice(len(x), self.rows, replace=False)] if len(x) else x, rng))

    def _grow(self, x: np.ndarray, rng: np.random.Generator):
        limit = max(1, math.ceil(math.log2(max(2, len(x)))))
        nodes: list[list[float]] = []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _c(len(part))])
            if depth >= limit or len(part) <= 1:
                return at
            lo, hi = part.min(0), part.max(0)
            wide = np.flatnonzero(hi > lo)
            if not len(wide):
                return at
            f = int(rng.choice(wide))
            cut = float(rng.uniform(lo[f], hi[f]))
            below = part[:, f] < cut
            nodes[at][:2] = [f, cut]
            nodes[at][2], nodes[at][3] = node(part[below], depth + 1), node(part[~below], depth + 1)
            return at

        node(x, 0)
        a = np.array(nodes)
        return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); shorter mean paths score higher."""
        total = np.zeros(len(x))
        for f, cut, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return self._score(total / len(self.trees))

    def _score(self, mean_length):
        return np.exp2(-mean_length / max(_c(self.rows), 1e-9))

    def least_score(self, least) -> float:
        """The smallest score of any point whose features are all at least ``least``."""
        total = 0.0
        for f, cut, left, right, length in self.trees:
            stack, most = [0], 0.0
            while stack:
                at = stack.pop()
                if f[at] < 0:
                    most = max(most, length[at])
                else:
                    stack.append(right[at])
                    if least[f[at]] < cut[at]:
                        stack.append(left[at])
            total += most
        return float(self._score(total / len(self.trees)))


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.where("row_key is not null").select(F.col("text_field").cast("string").alias("text_field"), F.col("row_key").cast("long").alias("row_key"), "text")


def fit(texts: DataFrame, sample_rows: int = SAMPLE_ROWS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> tuple[IsolationForest, float]:
    """Forest and threshold from at most ``sample_rows`` rows of ``texts(text_field, row_key, text)``.

    The rows are picked by a hash of their keys before any text is read. Those
    of at least ``min_words`` words are labelled by the exact rule. The
    threshold is the lowest score of a positive row, or the forest's lowest
    score over the rule's whole region if that is lower, which makes the
    candidate step lossless for the rule.
    """
    d = _keyed(texts)
    n = d.count()
    h = F.pmod(F.xxhash64("text_field", "row_key"), F.lit(1 << 30))
    picked = d.where(h < int(min(1.0, 0.9 * sample_rows / max(n, 1)) * (1 << 30)) if n > sample_rows else F.lit(True))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [x for x in map(words_of, b.column(2).to_pylist()) if len(x) >= min_words]
            f = np.array([cheap_statistics(x) for x in w], dtype=float).reshape(len(w), len(FEATURES))
            yield pa.record_batch([*(pa.array(f[:, i]) for i in range(len(FEATURES))), pa.array([repeated_share(x) >= min_share for x in w], pa.bool_())], names=[*FEATURES, "positive"])

    got = picked.mapInArrow(label, ", ".join(f"{f} double" for f in FEATURES) + ", positive boolean").limit(sample_rows).toPandas()
    # Sorted, so that the forest doesn't depend on the order in which tasks end.
    got = got.sort_values([*FEATURES, "positive"])
    x = got[list(FEATURES)].to_numpy(dtype=float).reshape(len(got), len(FEATURES))
    forest = IsolationForest(x)
    positive = got["positive"].to_numpy(dtype=bool)
    calibrated = float(forest.score(x[positive]).min()) if positive.any() else 1.0
    return forest, min(calibrated, forest.least_score(least_features(min_share))) - 1e-9


def candidates(texts: DataFrame, sample_rows: int = SAMPLE_ROWS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``text_field, row_key, n_words, anomaly, repeated_share`` of the texts that the forest lets through.

    One pass over the texts: cheap statistics and the forest's score for each
    of at least ``min_words`` words, the exact share only for those whose score
    reaches the threshold. Null, empty and short texts are no candidates; rows
    that come twice come out twice.
    """
    forest, threshold = fit(texts, sample_rows, min_words, min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = list(map(words_of, b.column(2).to_pylist()))
            at = [i for i, w in enumerate(words) if len(w) >= min_words]
            x = np.array([cheap_statistics(words[i]) for i in at], dtype=float).reshape(len(at), len(FEATURES))
            score = forest.score(x)
            some = np.flatnonzero(score >= threshold)
            rows = pa.array([at[i] for i in some], pa.int64())
            w = [words[i] for i in rows.to_pylist()]
            yield pa.record_batch(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array([len(x) for x in w], pa.int32()), pa.array(score[some]), pa.array([repeated_share(x) for x in w], pa.float64())],
                names=["text_field", "row_key", "n_words", "anomaly", "repeated_share"],
            )

    return _keyed(texts).mapInArrow(run, "text_field string, row_key long, n_words int, anomaly double, repeated_share double")


def repetition(texts: DataFrame) -> DataFrame:
    """``text_field, row_key, n_words, repeated_share`` of each distinct row of ``texts(text_field, row_key, text)``.

    ``repeated_share`` is the share of words lying in three consecutive words
    that already stood in the same order earlier in the text. Null, empty and
    wordless texts have 0 words and share 0; case is ignored; a word is a
    stretch of letters (with their marks) and digits. Whole texts are read,
    however long. Rows that come twice come out once; rows without a key are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = list(map(words_of, b.column(2).to_pylist()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(x) for x in w], pa.int32()), pa.array([repeated_share(x) for x in w], pa.float64())], names=["text_field", "row_key", "n_words", "repeated_share"])

    return _keyed(texts).mapInArrow(run, "text_field string, row_key long, n_words int, repeated_share double").distinct()


def archive_texts(captions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The captions and raw transcript texts as ``text_field, row_key, text``."""
    parts = [
        captions.select(F.lit("caption").alias("text_field"), F.col("manifest_row_index").cast("long").alias("row_key"), F.col("caption").alias("text")),
        transcripts.select(F.lit("raw_text").alias("text_field"), F.col("row_index").cast("long").alias("row_key"), F.col("raw_text").alias("text")),
    ]
    return reduce(DataFrame.unionByName, parts)


def found(texts: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``text_field, row_key`` of the texts that are mostly repetition: those the forest lets through, and of them the ones the exact rule confirms."""
    return candidates(texts, min_words=min_words, min_share=min_share).where(F.col("repeated_share") >= min_share).select("text_field", "row_key").distinct()
