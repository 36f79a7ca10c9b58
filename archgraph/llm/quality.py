"""Quality rules on whole texts, and an isolation forest over their statistics.

``rule_statistics`` computes the base statistics of a text. An isolation forest gives each
document a mean path length over random splits: anomalous statistics are cut off early.
Splits are drawn over the box of the labelled rows' statistics; how many good rows each part
of it holds is counted over all labelled rows, and so are the box and the threshold on the
anomaly score: of all thresholds that lose at most ``max_clean_loss`` of the rows with
quality 1, the one that rejects the most rows with quality 0. Nothing is sampled or capped:
rows stay in DataFrames, and the driver gets a box, one count for each leaf, and histograms.

Defined cases: a null text has no words, and fails the base rules as an empty one does;
rows with repeated ids are judged one by one, and the
forest counts one of them; other columns, whatever their names, pass through ``keep_good`` only; without labelled rows, or with labels of one
kind only, there is nothing to calibrate, and the base rules decide alone; null labels
are ignored; an empty table gives no rows; very long texts are measured whole; of rows whose score is the threshold all stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile("[A-Z]")

MIN_WORDS = 10
#: Per cent of the words that may stand in repeated windows.
MAX_REPEATED = 20
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees of a document.
FEATURES = ("word_length", "symbols", "dup_lines", "repeated_words", "upper")


def squash(rate: float, half: float = 0.1) -> float:
    """A rate on [0, 1), finest near zero, where ordinary texts lie."""
    return rate / (rate + half)


def rule_statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base statistics of a text, and the forest's features."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0,) * 5, (0.0,) * len(FEATURES)
    chars = sum(map(len, words))
    symbols = len(SYMBOL.findall(text))
    lines = dup_lines = 0
    seen = set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup_lines += 1
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    upper = len(UPPER.findall(text)) / chars
    features = (chars / n, squash(symbols / n), dup_lines / lines if lines else 0.0, repeated / n, squash(upper))
    return (n, chars, symbols, dup_lines, repeated), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class IsolationForest:
    """Trees as arrays: children, split feature and value; ``depth`` of a leaf holds its path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    normal: float
    threshold: float = 1.0

    @classmethod
    def plant(cls, low: np.ndarray, high: np.ndarray, trees: int, limit: int, seed: int) -> "IsolationForest":
        """Trees of random splits over the box from ``low`` to ``high``, ``limit`` deep, that know no rows yet.

        Splits are uniform over a node's part of the box, not over the rows in it, so they
        need no rows. Children stand behind their parents; ``depth`` is each node's level.
        """
        rng = np.random.default_rng(seed)
        out: dict[str, list] = {k: [] for k in ("feature", "value", "left", "right", "depth")}

        def node(low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(out["feature"])
            for k, v in (("feature", -1), ("value", 0.0), ("left", at), ("right", at), ("depth", float(depth))):
                out[k].append(v)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or not len(open_):
                return at
            k = int(rng.choice(open_))
            cut = float(rng.uniform(low[k], high[k]))
            upper, lower = high.copy(), low.copy()
            upper[k] = lower[k] = cut
            out["feature"][at], out["value"][at] = k, cut
            out["left"][at] = node(low, upper, depth + 1)
            out["right"][at] = node(lower, high, depth + 1)
            return at

        roots = [node(low, high, 0) for _ in range(trees)]
        return cls(**{k: np.array(v) for k, v in out.items()}, roots=np.array(roots), normal=1.0)

    def settle(self, counts: np.ndarray, size: int) -> "IsolationForest":
        """The planted trees with ``counts`` rows in their leaves, ``size`` in each tree.

        A part that holds no two rows becomes a leaf at once, so that rows outside the
        support of those counted end on short paths.
        """
        held = counts.copy()
        for at in range(len(held) - 1, -1, -1):
            if self.feature[at] >= 0:
                held[at] = held[self.left[at]] + held[self.right[at]]
        out: dict[str, list] = {k: [] for k in ("feature", "value", "left", "right", "depth")}

        def node(at: int) -> int:
            new = len(out["feature"])
            inner = self.feature[at] >= 0 and held[at] >= 2
            depth = self.depth[at] + (0.0 if inner else _average_path(int(held[at])))
            for k, v in (("feature", int(self.feature[at]) if inner else -1), ("value", float(self.value[at]) if inner else 0.0), ("left", new), ("right", new), ("depth", float(depth))):
                out[k].append(v)
            if inner:
                out["left"][new] = node(int(self.left[at]))
                out["right"][new] = node(int(self.right[at]))
            return new

        roots = [node(int(root)) for root in self.roots]
        return IsolationForest(**{k: np.array(v) for k, v in out.items()}, roots=np.array(roots), normal=_average_path(size) or 1.0)

    @classmethod
    def grow(cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, subsample: int, seed: int) -> "IsolationForest":
        """Trees over the box from ``low`` to ``high``, each on its own subsample of ``rows``, or on all of them if there are no more."""
        rng = np.random.default_rng([seed, 1])
        size = min(subsample, len(rows))
        planted = cls.plant(low, high, trees, max(1, math.ceil(math.log2(max(2, size)))), seed)
        counts = np.zeros(len(planted.feature), dtype=np.int64)
        for root in planted.roots:
            np.add.at(counts, planted.leaves(root, rows[rng.choice(len(rows), size, replace=False)]), 1)
        return planted.settle(counts, size)

    def leaves(self, root: int, rows: np.ndarray) -> np.ndarray:
        """The leaf of the tree at ``root`` in which each row ends."""
        which = np.arange(len(rows))
        at = np.full(len(rows), root)
        while True:
            k = self.feature[at]
            inner = k >= 0
            if not inner.any():
                return at
            go = rows[which, np.maximum(k, 0)] <= self.value[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, in (0, 1): 2 ** -(mean path length / mean path of a random search)."""
        total = np.zeros(len(rows))
        for root in self.roots:
            total += self.depth[self.leaves(root, rows)]
        return 2.0 ** (-total / len(self.roots) / self.normal)


def calibrate(scores: np.ndarray, bad: np.ndarray, max_clean_loss: float) -> float:
    """The lowest threshold with at most that share of the good rows above it, halfway to the next score."""
    good, wrong = np.sort(scores[~bad]), np.sort(scores[bad])
    if not len(good) or not len(wrong):
        return 1.0
    spare = int(max_clean_loss * len(good))
    at = good[len(good) - 1 - spare]
    above = wrong[wrong > at]
    return float((at + above[0]) / 2) if len(above) else 1.0


def _labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``bad`` and ``FEATURES`` of each labelled id whose row passes the base rules; of rows that repeat an id, the one with the least statistics stands for it."""
    ids = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    rows = measured.select("doc_id", F.struct("base_failed", *FEATURES).alias("x")).join(ids, F.col("doc_id") == F.col("label_id"))
    of_id = rows.groupBy("label_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    return of_id.where("not x.base_failed").select((F.col("quality") == 0).alias("bad"), *(F.col(f"x.{k}").alias(k) for k in FEATURES))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in FEATURES])


def _leaf_counts(good: DataFrame, planted: IsolationForest) -> np.ndarray:
    """How many rows end in each leaf: counted in each task, then added up; the driver gets one row a leaf that has any."""

    def run(batches):
        counts = np.zeros(len(planted.feature), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch)
            for root in planted.roots:
                counts += np.bincount(planted.leaves(root, rows), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["leaf", "n"])

    found = good.select(*FEATURES).mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(planted.feature), dtype=np.int64)
    counts[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    return counts


#: Parts of a range that are counted at once in the search for a rank.
BINS = 1024


def nth_largest(values: DataFrame, n: int) -> float:
    """The value that ``n`` rows of the one column ``x`` stand above in order, exactly: ranges are counted and narrowed until one value is left."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        rows = values.where(F.col("x").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if n < r.n:
                low, high = r.low, r.high
                break
            n -= r.n
    return low


def _calibrated(scores: DataFrame, n_good: int, max_clean_loss: float) -> float:
    """``calibrate`` over rows score, bad."""
    at = nth_largest(scores.where("not bad").select(F.col("score").alias("x")), int(max_clean_loss * n_good))
    above = scores.where("bad").where(F.col("score") > at).agg(F.min("score")).first()[0]
    return 1.0 if above is None else (at + above) / 2


def fit(docs: DataFrame, labels: DataFrame, trees: int = 128, depth: int = 8, max_clean_loss: float = 0.005, seed: int = 7) -> IsolationForest | None:
    """Grow and calibrate a forest on all labelled rows; None where labels don't allow it.

    Trees of ``depth`` levels count the good rows that pass the base rules, and so isolate what differs from them.
    """
    return fit_measured(_measure(docs), labels, trees, depth, max_clean_loss, seed)


def fit_measured(measured: DataFrame, labels: DataFrame, trees: int = 128, depth: int = 8, max_clean_loss: float = 0.005, seed: int = 7) -> IsolationForest | None:
    """``fit`` on the rows of ``measure``."""
    rows = materialize(_labelled(measured, labels), "labelled")
    box = rows.agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"), *(f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in FEATURES)).first()
    if not box.n_bad or not box.n_good:
        return None
    low, high = (np.array([box[f"{f}_{k}"] for k in FEATURES]) for f in ("min", "max"))
    planted = IsolationForest.plant(low, high, trees, depth, seed)
    forest = planted.settle(_leaf_counts(rows.where("not bad"), planted), box.n_good)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(batch)), pa.float64()), batch.column("bad")], names=["score", "bad"])

    scores = materialize(rows.mapInArrow(scored, "score double, bad boolean"), "label-scores")
    forest.threshold = _calibrated(scores, box.n_good, max_clean_loss)
    return forest


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly_score double, kept boolean"


#: What is measured of a row before any forest: its id, the base statistics and the forest's features.
MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{k} double" for k in FEATURES)


def _measured(texts: list[str | None]) -> list[pa.Array]:
    """The columns of ``MEASURED`` behind the id, for these texts."""
    found = [rule_statistics(x) for x in texts]
    return [
        *(pa.array([b[k] for b, _ in found], pa.int64()) for k in range(len(BASE))), pa.array([base_failed(b[0], b[4]) for b, _ in found], pa.bool_()),
        *(pa.array([f[k] for _, f in found], pa.float64()) for k in range(len(FEATURES))),
    ]


def _verdict(failed: pa.Array, rows: np.ndarray, forest: IsolationForest | None) -> list[pa.Array]:
    """anomaly_score and kept."""
    scores = forest.score(rows) if forest is not None else np.zeros(len(rows))
    kept = ~failed.to_numpy(zero_copy_only=False) & (scores <= (forest.threshold if forest is not None else 1.0))
    return [pa.array(scores), pa.array(kept)]


def _measure(docs: DataFrame) -> DataFrame:
    """``MEASURED`` of each row of ``docs``. A map, without a shuffle."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_measured(part.column(1).to_pylist())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEASURED)


def measure(docs: DataFrame) -> DataFrame:
    """``MEASURED`` of each row of ``docs``, as a table: texts are read once, and what follows moves numbers only."""
    return materialize(_measure(docs), "measured")


def rate(measured: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """One row per row of ``measure``: doc_id and ``COLUMNS``. A map, without a shuffle."""
    names = ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))]

    def run(batches):
        for batch in batches:
            given = [batch.column(k) for k in range(2 + len(BASE))]
            yield pa.RecordBatch.from_arrays([*given, *_verdict(given[-1], _matrix(batch), forest)], names=names)

    return measured.mapInArrow(run, f"doc_id long, {COLUMNS}")


def apply_rules(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``COLUMNS``. A map, without a shuffle."""
    return rate(_measure(docs), forest)


def keep_good(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for part in slices(batches):
            found = _measured(part.column(at).to_pylist())
            rows = np.column_stack([x.to_numpy(zero_copy_only=False) for x in found[-len(FEATURES) :]])
            yield part.filter(_verdict(found[len(BASE)], rows, forest)[-1])

    return docs.mapInArrow(run, schema)
