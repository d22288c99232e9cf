"""Quality rules: statistics of whole texts, and an isolation forest over them with a calibrated threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_col, keeps, tidy, tune

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows that the forest is fitted on at most; trees; rows of a tree; share of good rows it may reject.
FIT_ROWS, TREES, TREE_ROWS, MAX_LOSS = 20_000, 100, 64, 0.002
#: Rows whose crc32(id as text) leaves remainder 0 here are not fitted on, so that they can tell how good the verdicts are.
FOLDS = 5
#: Share of good rows beyond each end of a usual range; least width of a range.
BEYOND, NARROW = 0.001, 0.01
_WORD = re.compile(r"[^ \t-\r]+")
_HAS_WORD = re.compile(r"[^ \t-\r]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has no words."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        with_word = [x for x in lines if _HAS_WORD.search(x)]
        dup = len(with_word) - len(set(with_word))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        first: dict = {}
        marked = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marked[j : j + 3] = marked[i : i + 3] = b"\1\1\1"
        repeat = sum(marked)
    return n, chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def shares(stats: np.ndarray) -> np.ndarray:
    """Of each row's statistics: symbols per word and per character, repeated words and lines per word, letters per word."""
    n = np.maximum(stats[:, 0], 1)
    return np.stack([stats[:, 2] / n, stats[:, 2] / np.maximum(stats[:, 1], 1), stats[:, 4] / n, stats[:, 3] / n, (stats[:, 1] - stats[:, 2]) / n], axis=1)


def usual_ranges(x: np.ndarray) -> np.ndarray:
    """The least and greatest usual value of each share, over rows that are good."""
    return np.quantile(x, [BEYOND, 1 - BEYOND], axis=0) if len(x) else np.zeros((2, x.shape[1]))


def features(stats: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """What the forest splits on: how far each share lies beyond its usual range, in widths of it (10 at most)."""
    x, (low, high) = shares(stats), ranges
    return np.clip(np.maximum(x - high, low - x) / np.maximum(high - low, NARROW), 0, 10)


@dataclass
class Forest:
    """Isolation forest: random splits of random features; anomalies are cut off after few of them."""

    feature: np.ndarray  # trees x nodes, -1 at leaves
    cut: np.ndarray
    length: np.ndarray  # path length that ends at the node
    norm: float
    threshold: float = np.inf
    ranges: np.ndarray | None = None

    @staticmethod
    def usual_length(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = int(np.ceil(np.log2(max(rows, 2))))
        nodes = 2 ** (depth + 1)
        feature, cut, length = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(1, x[rng.choice(len(x), rows, replace=False)], 0)]
            while todo:
                k, part, d = todo.pop()
                low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]),) * 2
                wide = np.flatnonzero(high > low)
                if d >= depth or len(part) < 2 or not len(wide):
                    length[t, k] = d + cls.usual_length(len(part))
                    continue
                f = rng.choice(wide)
                feature[t, k], cut[t, k] = f, rng.uniform(low[f], high[f])
                left = part[:, f] < cut[t, k]
                todo += [(2 * k, part[left], d + 1), (2 * k + 1, part[~left], d + 1)]
        return cls(feature, cut, length, max(cls.usual_length(rows), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over the usual one: near 1 for anomalies, below a half for the rest."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            at = np.ones(len(x), np.int64)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                k = at[inner]
                at[inner] = 2 * k + (x[every[inner], feature[k]] >= cut[k])
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)

    def calibrate(self, scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> None:
        """The threshold of the most right verdicts among those that reject at most max_loss of the good rows.

        It is set in the middle of the gap that it falls in. Without rows of both kinds nothing is rejected.
        """
        self.threshold = np.inf
        if not len(scores) or good.all() or not good.any():
            return
        order = np.argsort(-scores, kind="stable")
        s, g = scores[order], good[order]
        lost, found = np.cumsum(g), np.cumsum(~g)
        last = np.append(s[1:] < s[:-1], True)
        right = np.where(last & (lost <= max_loss * g.sum()), found - lost, 0)
        k = int(np.argmax(right))
        if right[k] > 0:
            self.threshold = (s[k] + (s[k + 1] if k + 1 < len(s) else s[k])) / 2


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> Forest:
    """Fits usual ranges, forest and threshold on at most fit_rows labelled rows (a documented bound), those of the least
    crc32 of the id; of an id's several rows the one of least statistics. Rows of the held-out fold are not among them."""
    picked = labels.where("quality is not null and doc_id is not null").where(~held_out_col("doc_id", folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(fit_rows)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = text.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), *(pa.array([s[i] for s in stats], pa.int64()) for i in range(5))], names=["doc_id", "quality", *BASE])

    got = rows.mapInArrow(measure, "doc_id long, quality int, " + ", ".join(f"{c} long" for c in BASE))
    got = got.groupBy("doc_id").agg(F.min(F.struct("quality", *BASE)).alias("m")).select("doc_id", "m.*").collect()
    got = sorted(tuple(r) for r in got)
    stats = np.array([r[2:] for r in got], float).reshape(-1, 5)
    good = np.array([r[1] == 1 for r in got], bool)
    passed = np.array([not base_failed(int(s[0]), int(s[4])) for s in stats], bool)
    if not passed.any():
        forest = Forest.fit(np.zeros((2, 5)))
        forest.ranges = np.zeros((2, 5))
        return forest
    usual = good[passed] if good[passed].any() else np.ones(int(passed.sum()), bool)
    ranges = usual_ranges(shares(stats[passed])[usual])
    x = features(stats[passed], ranges)
    forest = Forest.fit(x)
    forest.ranges = ranges
    forest.calibrate(forest.score(x), good[passed])
    return forest


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of docs: doc_id, the five statistics, base_failed, kept and the forest's score.

    Statistics read whole texts; a null or empty text has none and fails the base rules. Rows that pass these are
    judged by the forest. Without usable labels the forest rejects nothing. No shuffle; the model (a few hundred KB,
    fixed size) goes out once per executor. Repeated rows are judged alike; other columns are ignored; an empty table
    gives no rows.
    """
    spark = tune(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit_forest(docs, labels, id_col, text_col, fit_rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps()
        forest = model.value
        for b in batches:
            stats = np.array([statistics(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 5)
            failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
            score = forest.score(features(stats, forest.ranges))
            kept = ~failed & (score <= forest.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "anomaly"])
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double")


