"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source gets the same expected number of copies, target / source size. Its
whole part is taken; its fraction is an inclusion probability. The flight phase moves the
probabilities of a few documents at a time along a direction that keeps the expected totals
of words and documents (a null vector of the balancing constraints) until one of them is 0 or
1, and goes on with the next ones; at most two documents per block stay undecided. Sources
are cut into blocks of bounded size, so that a source of any size is many tasks; the undecided
documents of all blocks fly again in blocks of their own, level by level, until one block per
source is left. There a few documents, spread over the sizes, are kept back: with the flight's
last two they are the landing problem, decided by the outcome that comes nearest to the
expected words.

Documents that alone are a sizeable part of their source's target are decided before the others,
which then get the rate that reaches what is left: one document that holds most of a source's
words costs the mix no more than what the others can't make up for.

Documents fly from large to small, ties by a hash of the row, and random draws come from such hashes, so
that every run takes the same documents.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import mix, n_words, stored, table

BLOCK = 4000  # documents of a block
POOL = 12  # documents that the landing decides, beside the two that a flight leaves
EPS = 1e-9
LARGE = 8  # documents of at least about target / LARGE words (a power of two) are decided first


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source. Sources by code point, null last, weigh `weights` in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full: dict[str | None, float] = {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        each = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: most * sizes[s] for s, x in each.items() if x > most * sizes[s]}
        if not over:
            return {s: full.get(s, each.get(s, 0.0)) for s in order}
        full |= over


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are neither 0 nor 1, keeping sum(p) and sum(p * size)."""
    p = np.clip(p.astype(float), 0, 1)
    x = size.astype(float)
    out = p.tolist()
    sizes = x.tolist()
    draw = draws.tolist()
    held: list[int] = []
    for i, v in enumerate(out):
        if not EPS < v < 1 - EPS:
            out[i] = float(round(v))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for j, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - out[j]) / d), min(down, out[j] / d)
            elif d < 0:
                up, down = min(up, out[j] / -d), min(down, (1 - out[j]) / -d)
        step = up if draw[i] * (up + down) < down else -down
        for j, d in zip(held, u, strict=True):
            v = min(1.0, max(0.0, out[j] + step * d))
            out[j] = float(round(v)) if not EPS < v < 1 - EPS else v
        held = [j for j in held if 0.0 < out[j] < 1.0]
    return np.array(out)


def landing(p: np.ndarray, size: np.ndarray, low: float = 0.0, high: float = 0.0) -> np.ndarray:
    """Decide the last few documents: the outcome nearest to the expected words, then documents.

    low and high bound what documents decided later can make up for; an outcome within them, or
    as little outside as can be, comes first.
    """
    out = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = choices @ size[left] - p[left] @ size[left]
    beyond = np.maximum(0, np.maximum(low - off, off - high))
    docs = np.abs(choices.sum(1) - p[left].sum())
    out[left] = choices[np.lexsort((docs, np.abs(off).round(6), beyond.round(6)))[0]] if len(left) else 0
    return out


def decided(p: np.ndarray, size: np.ndarray, draws: np.ndarray, low: float = 0.0, high: float = 0.0) -> np.ndarray:
    """Flight and landing of all documents. A few, spread over the sizes, are left to the landing."""
    open_at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = open_at[np.argsort(size[open_at], kind="stable")]
    pool = by_size[np.unique(np.linspace(0, len(by_size) - 1, min(POOL, len(by_size))).astype(int))] if len(by_size) else by_size
    rest = np.setdiff1d(np.arange(len(p)), pool)
    out = p.astype(float)
    out[rest] = flight(p[rest], size[rest], draws[rest])
    return landing(out, size.astype(float), low, high)


def _flown(rows: DataFrame, last: bool) -> DataFrame:
    """One level: p of the rows is moved, block by block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Large documents fly first, so that the undecided ones at the end are small.
        group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        size, key = group["size"].to_numpy(), group["key"].to_numpy().view(np.uint64)
        draws = (mix(key + np.uint64(1)) >> np.uint64(11)) / float(1 << 53)
        if last:
            group["p"] = decided(group["p"].to_numpy(), size, draws, group["low"].iloc[0], group["high"].iloc[0])
        elif group["blocks"].iloc[0] > 1:  # a single block waits for the last level
            group["p"] = flight(group["p"].to_numpy(), size, draws)
        return group

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def _mixed_rows(rows: DataFrame, by_source: DataFrame, large: bool, blocks: int, block: int) -> DataFrame:
    """The large rows or the others with p decided, by levels of flights."""
    which = F.col("bits") >= F.col("limit")
    rows = rows.join(by_source, F.col("source").eqNullSafe(F.col("s"))).where(which if large else ~which).drop("s", "bits", "limit")
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("long")).withColumn(
        "p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).drop("rate")
    done = None
    for level in itertools.count(1):
        flown = stored(_flown(rows, blocks <= 1), "mix")
        sure = flown.where("p = 0 or p = 1")
        done = sure if done is None else done.union(sure)
        if blocks <= 1:
            return done
        blocks = -(-2 * blocks // block)  # two documents of a block are left at most
        rows = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("int")).withColumn(
            "block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")).cast("long"))


def draw(docs: DataFrame, columns: list[str], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
         most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The given columns of every row of docs, and size, source_size, target, copies.

    docs needs source and text; columns that aren't named are not read. size is the number of
    words (null text: 0); copies says how often the mix takes the row, at most `most` times. See
    targets() for what each source gets; a null source is one of its own, the last. Rows with
    one doc_id or a null one are documents of their own; of equal rows it does not matter
    which is taken. Documents without words count as documents only; a source without words
    is not taken. Long texts are counted whole. Empty table: no rows.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(columns))]  # whatever the columns are called
    carried = [F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]
    rows = docs.select(
        *carried, F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in columns], "source", "text").alias("key"))
    bits = F.length(F.bin("size"))
    counts = rows.groupBy("source", bits.alias("bits")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # some 20 a source
    sizes: dict[str | None, int] = {}
    for r in counts:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["words"]
    aims = targets(sizes, weights, share, most)
    limit = {s: max(1, math.ceil(aims[s] / LARGE) - 1).bit_length() + 1 for s in sizes}
    large = {s: [sum(r[c] for r in counts if r["source"] == s and r["bits"] >= limit[s]) for c in ("words", "n")] for s in sizes}
    rows = rows.withColumn("bits", bits)

    def facts(rate_of, n_of, bounds_of) -> DataFrame:
        """Per source: what its rows need to know for one round of flights."""
        out = [(s, sizes[s], float(aims[s]), limit[s], rate_of(s), max(1, -(-n_of(s) // block)), *bounds_of(s)) for s in sizes]
        return spark.createDataFrame(out, "s string, source_size long, target double, limit int, rate double, blocks int, low double, high double")

    rate = {s: aims[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}
    small = {s: sizes[s] - large[s][0] for s in sizes}
    first = _mixed_rows(rows, facts(rate.get, lambda s: large[s][1], lambda s: (float((rate[s] - most) * small[s]), float(rate[s] * small[s]))), True,
                        max([-(-n // block) for _, n in large.values()], default=1), block)
    taken = {r["source"]: r["words"] for r in first.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.col("p"))).alias("words")).collect()}
    count = {s: sum(r["n"] for r in counts if r["source"] == s) - large[s][1] for s in sizes}
    rest = {s: min(most, max(0.0, (aims[s] - taken.get(s, 0)) / small[s])) if small[s] else 0.0 for s in sizes}
    second = _mixed_rows(rows, facts(rest.get, count.get, lambda s: (0.0, 0.0)), False, max([-(-n // block) for n in count.values()], default=1), block)
    done = first.union(second)
    return done.select(
        *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "size", "source_size", "target",
        (F.col("whole") + F.col("p")).cast("int").alias("copies"))


MIX = ["size", "source_size", "target", "copies"]


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with MIX columns (these names are taken from docs)."""
    return draw(docs, [c for c in docs.columns if c not in MIX]).where("copies > 0")


def op9_mixing(spark, sf_dir):
    """All documents mixed to source weights 5, 2, 1."""
    found = draw(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
