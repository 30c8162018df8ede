"""Quality rules: an isolation forest on rule statistics of each text.

The statistics of every whole text are shares that do not depend on its length: symbols and
exclamation marks per word, capitals among characters, and the mean word length. A forest of
random trees is grown on a bounded sample of rows labelled good; the range of every node is
widened by a part of the spread of all labelled rows, so that values which no good row has
are cut off early. The mean path length on which a document is isolated becomes its score, and
short paths are anomalies. The threshold is calibrated on all labelled rows: the score that at
most a given share of the good ones exceeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from docmetrics.llm.common import BYTES, mix, slices, stored, table, utf8_of, with_text, word_hashes

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols", "capitals", "shouts", "mean_length")
SLICE = 250_000  # bytes of text whose words a task has in memory at once

_DROP = {name: bytes(b for b in range(256) if b not in keep) for name, keep in {
    "symbols": SYMBOLS, "capitals": bytes(range(65, 91)), "shouts": b"!"}.items()}
#: The bytes of a UTF-8 character after its first, and what separates words.
_NO_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\r\v\f"


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BASE and SHARES of whole texts in UTF-8, a row for each."""
    flat, sizes = word_hashes(texts, BYTES)
    with np.errstate(over="ignore"):
        # Windows of three words; those that reach over the end of a text are marked and left out.
        w = mix((flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + flat[2:])
    repeats, at = [], 0
    for n in sizes.tolist():
        got = 0
        if n >= 4:
            own = w[at: at + n - 2]
            order = np.sort(own)
            same = order[1:] == order[:-1]
            if same.any():
                again = order[1:][same]
                hit = again[np.searchsorted(again, own).clip(max=len(again) - 1)] == own
                cover = np.zeros(n, bool)
                for k in range(3):
                    cover[k: n - 2 + k] |= hit
                got = int(cover.sum())
        repeats.append(got)
        at += n
    base, shares = [], []
    for t, n, rep in zip(texts, sizes.tolist(), repeats, strict=True):
        word_chars = len(t.translate(None, _NO_CHARS))
        symbols, capitals, shouts = (len(t.translate(None, _DROP[k])) for k in ("symbols", "capitals", "shouts"))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        base.append((n, word_chars, symbols, dup, rep))
        shares.append((symbols / max(1, n), capitals / max(1, word_chars), shouts / max(1, n), word_chars / max(1, n)))
    return np.array(base, np.int64).reshape(-1, len(BASE)), np.array(shares).reshape(-1, len(SHARES))


class Forest:
    """Isolation trees as arrays: feature, threshold, children, path length at leaves."""

    def __init__(self, rows: np.ndarray, spread: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 5) -> None:
        """spread: how far beyond its rows a node's range goes in each direction, so that values
        that no row has are isolated too, and columns that are constant are split."""
        rng = np.random.default_rng(seed)
        self.depth = int(np.ceil(np.log2(max(2, min(sample, len(rows))))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, size), np.int16)
        self.split = np.full((trees, size), np.inf)
        self.length = np.zeros((trees, size))
        self.usual = mean_path(min(sample, len(rows)))
        for t in range(trees):
            picked = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
            todo = [(0, picked, 0)]
            while todo:
                at, x, d = todo.pop()
                lo, hi = (x.min(0) - spread, x.max(0) + spread) if len(x) else (spread, spread)
                wide = np.flatnonzero(hi > lo)
                if d == self.depth or len(x) <= 1 or not len(wide):
                    self.fill(t, at, d, d + mean_path(len(x)))
                    continue
                f = int(rng.choice(wide))
                cut = rng.uniform(lo[f], hi[f])
                self.feature[t, at], self.split[t, at] = f, cut
                left = x[:, f] < cut
                todo += [(2 * at + 1, x[left], d + 1), (2 * at + 2, x[~left], d + 1)]

    def fill(self, tree: int, at: int, depth: int, length: float) -> None:
        """A leaf; whatever lies below it in the array has its length too."""
        level, width = at, 1
        for _ in range(self.depth - depth + 1):
            self.length[tree, level: level + width] = length
            level, width = 2 * level + 1, 2 * width

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: 2 ** -(mean path length / usual path length)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] >= self.split[t, at])
            total += self.length[t, at]
        return 2.0 ** -(total / len(self.feature) / self.usual)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Model(NamedTuple):
    forest: Forest | None
    threshold: float


def with_statistics(docs: DataFrame, columns: list[str], forest: Forest | None = None) -> DataFrame:
    """The given columns of every row under names c0, c1, ..., BASE counts and shares; with a forest, the score too."""
    rows, text = with_text(docs, columns)
    schema = StructType([
        *rows.schema.fields[:len(columns)], *[StructField(c, LongType()) for c in BASE], StructField("shares", ArrayType(DoubleType())),
        *([StructField("score", DoubleType())] if forest else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, text, 4 * SLICE):  # few batches to return and to score
                part = batch.slice(lo, hi - lo)
                found = [statistics(utf8_of(part.column(text).slice(a, b - a))) for a, b in slices(part, text, SLICE)]
                base, shares = (np.concatenate(x) for x in zip(*found, strict=True))
                ends = np.arange(0, shares.size + 1, len(SHARES), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(columns)], *[pa.array(c) for c in base.T.copy()],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(shares.ravel())), *([pa.array(forest.scores(shares))] if forest else [])],
                    names=[*part.schema.names[:len(columns)], *BASE, "shares", *(["score"] if forest else [])])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """Rows of with_statistics() and their score."""
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("shares").flatten().to_numpy().reshape(-1, len(SHARES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(x))], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def fit(stats: DataFrame, labels: DataFrame, sample: int = 4000, good_lost: float = 0.002) -> Model:
    """Grow the forest and calibrate its threshold.

    stats: rows of with_statistics() whose c0 is doc_id; labels: doc_id, quality (1: good, 0:
    bad, null: not labelled). At most about 2 * sample rows come to the driver; quantiles and
    the threshold are taken over all labelled rows. Without good rows nothing is rejected but
    what the base rules reject.
    """
    known = labels.where("quality is not null").select(F.col("doc_id").alias("c0"), F.col("quality").alias("label"))
    rows = stored(stats.join(known, "c0").where(~base_failed()).select("c0", "label", *BASE, "shares"), "labelled")
    facts = rows.select(
        F.count_if(F.col("label") == 1).alias("good"),
        *[F.percentile_approx(F.col("shares")[i], [0.01, 0.99], 10000).alias(f"q{i}") for i in range(len(SHARES))]).first()
    if not facts["good"]:
        return Model(None, float("inf"))
    some = F.pmod(F.xxhash64("c0"), F.lit(1 << 20)) < F.lit(min(1.0, 1.5 * sample / facts["good"]) * (1 << 20))
    picked = rows.where((F.col("label") == 1) & some).select("c0", "shares").orderBy("c0", "shares").limit(2 * sample).collect()
    if not picked:
        picked = rows.where("label = 1").select("c0", "shares").orderBy("c0", "shares").limit(sample).collect()
    spread = np.array([0.25 * (facts[f"q{i}"][1] - facts[f"q{i}"][0]) for i in range(len(SHARES))])
    forest = Forest(np.array([r["shares"] for r in picked]), spread)
    limit = scored(rows.where("label = 1"), forest).select(F.percentile_approx("score", 1 - good_lost, 100000)).first()[0]
    return Model(forest, limit)


def judged(docs: DataFrame, model: Model, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """The given columns of every row as c0, c1, ..., BASE counts, base_failed and kept.

    docs needs text and the columns; null text counts as empty. kept is false if the base rules
    fail (under 50 words, or over half the words in repeated windows of three) or the score is
    over the threshold. Rows are independent: null and repeated ids come back as they are. Long
    texts are read whole. Empty table: no rows. stats: rows of with_statistics(docs, columns),
    if they have been made before.
    """
    if model.forest is None:
        rows = (with_statistics(docs, columns) if stats is None else stats).withColumn("score", F.lit(0.0))
    else:  # statistics and score in one step of Python
        rows = with_statistics(docs, columns, model.forest) if stats is None else scored(stats, model.forest)
    return rows.select(
        *[f"c{i}" for i in range(len(columns))], *BASE, base_failed().alias("base_failed"),
        (~base_failed() & (F.col("score") <= F.lit(model.threshold))).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with the model fitted on docs and labels."""
    model = fit(stored(with_statistics(docs, ["doc_id"]), "statistics"), labels)
    return judged(docs, model, docs.columns).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_quality(spark, sf_dir):
    """Quality verdict on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(with_statistics(docs, ["doc_id"]), "statistics")
    return judged(docs, fit(stats, table(spark, sf_dir, "labels")), ["doc_id"], stats).withColumnRenamed("c0", "doc_id")
