"""Hard negatives by best-first search in STR-packed R-trees.

Rows are packed by sort-tile-recursive: cut into slabs by label, each slab by the coordinate of
greatest variance, and so on, down to leaves of LEAF rows with their minimum bounding boxes. The
upper cuts, down to tiles of some thousand rows, are quantiles of a bounded sample of rows, and
every row is put into its tile; the tiles are packed exactly, each in a task of its own, and written
as a table of leaves. Rows that tie on a coordinate are cut by a hash of their id, so that no
tile grows with the copies of one vector.

The inner product of an anchor with any row of a box lies between sums of per-coordinate
extremes. A search takes boxes in falling order of the greatest product they allow. Boxes outside an
anchor's score windows are left out, and so are boxes strictly below the k-th score found
for each window; boxes that tie with it are searched, since ties go by id. Leaves are taken in waves
of doubling width, all anchors of a block at once, so that scores are small matrix products.

Anchors are a block at a time against a tile at a time; boxes of tiles (MOST_TILES at most) prune
pairs of anchor and tile before anything moves. The best rows per tile are merged by Spark's
ranking, cut off before its shuffle.

Scores are exact: entries are integers and no partial sum exceeds 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmetrics.llm.common import mix, stored, table

#: Rows of a leaf, of a tile (at least), the greatest number of tiles, sampled rows, anchors of a block.
LEAF, TILE, MOST_TILES, SAMPLE, BLOCK = 64, 4096, 2048, 1 << 15, 8192
#: Vectors whose squared length is this or more would have inexact scores.
LONGEST = float(1 << 52)
#: Anchors that are searched at once within a block.
AT_ONCE = 512

LOW, HIGH = -(1 << 62), 1 << 62


def entries(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of a vector; null if it is null, too long, or holds null or non-finite entries."""
    wide = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    length = F.aggregate(wide, F.lit(0.0), lambda s, c: s + c * c)
    return F.when(~bad & (length < LONGEST), F.transform(wide, lambda c: c.cast("int")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


# ------------------------------------------------------------------ packing


def spread(vec_id: np.ndarray) -> np.ndarray:
    """A number in [0, 1) per id, that cuts rows which tie on a coordinate."""
    return (mix(vec_id.astype(np.int64).view(np.uint64)) >> np.uint64(12)).astype(float) / (1 << 52)


def slabs(parts: int, levels: int) -> int:
    """Slabs of one level if parts are wanted after all of them."""
    return int(np.ceil(round(parts ** (1 / max(1, levels)), 9)))


def levels_of(parts: int, keys: int) -> int:
    return max(1, min(keys, 4, int(np.ceil(np.log2(max(parts, 2))))))


def cuts_of(keys: np.ndarray, parts: int) -> tuple | int:
    """The upper tree: nested (bounds, children) by the columns of keys, down to numbered tiles."""
    number = iter(range(1 << 62))

    def cut(rows: np.ndarray, level: int, parts: int, levels: int) -> tuple | int:
        if parts <= 1 or level == levels:
            return next(number)
        k = slabs(parts, levels - level)
        order = rows[np.argsort(rows[:, level], kind="stable")]
        at = [len(order) * i // k for i in range(1, k)]
        each = np.split(order, at)
        share = [parts * (i + 1) // k - parts * i // k for i in range(k)]
        return [float(order[i, level]) if i < len(order) else np.inf for i in at], [cut(e, level + 1, p, levels) for e, p in zip(each, share, strict=True)]

    return cut(keys, 0, parts, levels_of(parts, keys.shape[1]))


def tile_of(tree: tuple | int, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int32)

    def walk(node: tuple | int, rows: np.ndarray, level: int) -> None:
        if isinstance(node, int):
            out[rows] = node
            return
        side = np.searchsorted(node[0], keys[rows, level], side="right")
        for i, child in enumerate(node[1]):
            if len(part := rows[side == i]):
                walk(child, part, level + 1)

    walk(tree, np.arange(len(keys)), 0)
    return out


def str_order(keys: np.ndarray, leaf: int) -> np.ndarray:
    """The order in which each leaf rows in a row make a leaf."""
    def pack(rows: np.ndarray, level: int, levels: int) -> np.ndarray:
        rows = rows[np.argsort(keys[rows, level], kind="stable")]
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or level + 1 == levels:
            return rows
        size = -(-leaves // slabs(leaves, levels - level)) * leaf
        return np.concatenate([pack(rows[i: i + size], level + 1, levels) for i in range(0, len(rows), size)])

    return pack(np.arange(len(keys)), 0, levels_of(-(-len(keys) // leaf), keys.shape[1]))


def packed(rows: DataFrame, leaf: int = LEAF, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Leaves of the R-tree over rows (vec_id, label, x of one length), and the boxes of its tiles.

    Leaves: tile, leaf, label_lo, label_hi, lo, hi (binary, int32), ids (binary, int64), labels
    and rows (binary, int32). Tiles: tile, label_lo, label_hi, lo, hi, n.
    """
    spark = rows.sparkSession
    n = rows.count()
    per_tile = max(tile, -(-n // MOST_TILES))
    parts = max(1, -(-n // per_tile))
    chance = F.shiftrightunsigned(F.xxhash64("vec_id", F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance < SAMPLE / max(n, 1)).select("vec_id", "label", "x").toArrow()
    d = len(drawn.column("x")[0]) if drawn.num_rows else 0
    sample = matrix(drawn.column("x").combine_chunks(), d) if d else np.zeros((drawn.num_rows, 0), np.int32)
    axes = np.argsort(-sample.astype(float).var(axis=0), kind="stable")[:6] if len(sample) else np.arange(min(6, d))

    def keys_of(vec_id: np.ndarray, label: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.column_stack([label, x[:, axes]]).astype(float) + spread(vec_id)[:, None]

    tree = cuts_of(keys_of(drawn.column("vec_id").to_numpy(), drawn.column("label").to_numpy(), sample), parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(batch.column("x")[0])) if batch.num_rows else np.zeros((0, 1), np.int32)
            keys = keys_of(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), x) if batch.num_rows else np.zeros((0, 7))
            yield pa.RecordBatch.from_arrays([pa.array(tile_of(tree, keys)), batch.column("vec_id"), batch.column("label"),
                                              pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())], names=["tile", "vec_id", "label", "x"])

    def pack(rows: pa.Table) -> pa.Table:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int32).reshape(len(ids), -1)
        order = np.lexsort((ids,))
        order = order[str_order(keys_of(ids[order], labels[order], x[order]), leaf)]
        out = []
        for at in range(0, len(order), leaf):
            o = order[at: at + leaf]
            out.append((int(rows.column("tile")[0].as_py()), at // leaf, int(labels[o].min()), int(labels[o].max()), x[o].min(axis=0).tobytes(),
                        x[o].max(axis=0).tobytes(), ids[o].tobytes(), labels[o].astype(np.int32).tobytes(), x[o].tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                    names=["tile", "leaf", "label_lo", "label_hi", "lo", "hi", "ids", "labels", "rows"])

    leaves = stored(rows.mapInArrow(place, "tile int, vec_id long, label int, x binary").groupBy("tile").applyInArrow(
        pack, "tile int, leaf int, label_lo int, label_hi int, lo binary, hi binary, ids binary, labels binary, rows binary"), "rtree")

    def box(rows: pa.Table) -> pa.Table:
        lo, hi = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int32).reshape(rows.num_rows, -1) for c in ("lo", "hi"))
        one = [rows.column("tile")[0], pc.min(rows.column("label_lo")), pc.max(rows.column("label_hi")), pa.scalar(lo.min(axis=0).tobytes()),
               pa.scalar(hi.max(axis=0).tobytes())]
        return pa.Table.from_arrays([pa.array([x.as_py()], k) for x, k in zip(one, [pa.int32()] * 3 + [pa.binary()] * 2, strict=True)],
                                    names=["tile", "label_lo", "label_hi", "lo", "hi"])

    tiles = leaves.select("tile", "label_lo", "label_hi", "lo", "hi").groupBy("tile").applyInArrow(
        box, "tile int, label_lo int, label_hi int, lo binary, hi binary")
    return leaves, stored(tiles, "rtree-tiles")


# ------------------------------------------------------------------ search


class Boxes:
    """Minimum bounding boxes and the interval of inner products that each allows."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray) -> None:
        self.lo, self.hi, self.label_lo, self.label_hi = lo.astype(float), hi.astype(float), label_lo, label_hi

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest products, anchors by boxes, widened by the rounding of their sums."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        least, most = plus @ self.lo.T + minus @ self.hi.T, plus @ self.hi.T + minus @ self.lo.T
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T)
        return least - slack, most + slack

    def allowed(self, label: np.ndarray, same: bool) -> np.ndarray:
        """Boxes that may hold a row of the anchor's label, or one of another."""
        if same:
            return (self.label_lo <= label[:, None]) & (label[:, None] <= self.label_hi)
        return ~((self.label_lo == label[:, None]) & (self.label_hi == label[:, None]))


class Tree:
    """The leaves of one tile, and the boxes over runs of them."""

    RUN = 16

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("leaf")
        col = lambda c, k: np.frombuffer(b"".join(rows.column(c).to_pylist()), k)
        n = rows.num_rows
        ids = col("ids", np.int64)
        self.ends = np.cumsum([len(b) // 8 for b in rows.column("ids").to_pylist()])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.ids, self.labels, self.x = ids, col("labels", np.int32), col("rows", np.int32).reshape(len(ids), -1).astype(float)
        lo, hi = col("lo", np.int32).reshape(n, -1), col("hi", np.int32).reshape(n, -1)
        a, b = rows.column("label_lo").to_numpy(), rows.column("label_hi").to_numpy()
        self.leaves = Boxes(lo, hi, a, b)
        at = np.arange(0, n, self.RUN)
        self.nodes = Boxes(np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(a, at), np.maximum.reduceat(b, at))

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple:
        """The first k rows per anchor and window: anchor, window, id, score.

        low, high: anchors by windows, with low > high where an anchor has fewer windows.
        """
        windows = low.shape[1]
        floor = low.copy()  # no row below this is among the first k
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # anchor * windows + window, score, id

        def useful(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            out = np.zeros(least.shape, bool)
            for w in range(windows):
                out |= (most >= floor[:, w, None]) & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
            return out

        inner = useful(*self.nodes.products(q)) & self.nodes.allowed(labels, same)
        least, most = self.leaves.products(q)
        open_ = np.repeat(inner, self.RUN, axis=1)[:, : most.shape[1]] & self.leaves.allowed(labels, same) & useful(least, most)
        order = np.argsort(np.where(open_, -most, np.inf), axis=1, kind="stable")
        done, width = 0, 1
        while done < order.shape[1] and open_.any():
            wave = order[:, done: done + width]
            visits = np.zeros_like(open_)
            np.put_along_axis(visits, wave, True, axis=1)
            visits &= open_
            open_ &= ~visits
            found = []
            for leaf in np.flatnonzero(visits.any(axis=0)):
                who = np.flatnonzero(visits[:, leaf])
                s = slice(self.starts[leaf], self.ends[leaf])
                score = q[who] @ self.x[s].T
                ok = ((self.labels[s] == labels[who, None]) == same) & (self.ids[s] != ids[who, None])
                for w in range(windows):
                    i, j = np.nonzero(ok & (score >= floor[who, w, None]) & (score <= high[who, w, None]))
                    found.append((who[i] * windows + w, score[i, j].astype(np.int64), self.ids[s][j]))
            if found:
                key, score, other = (np.concatenate([a, *b]) for a, b in zip(kept, zip(*found, strict=True), strict=True))
                by = np.lexsort((other, -score, key))
                key, score, other = key[by], score[by], other[by]
                rank = np.arange(len(key)) - np.searchsorted(key, key)
                kept = tuple(x[rank < k] for x in (key, score, other))
                full = rank == k - 1
                flat = floor.reshape(-1)
                flat[key[full]] = np.maximum(flat[key[full]], score[full])
                open_ &= useful(least, most)
            done, width = done + width, width * 2
        return kept[0] // windows, kept[0] % windows, kept[2], kept[1]


def windows_of(scores: list[list[int]], bounds: tuple[int, int] | None) -> tuple[np.ndarray, ...]:
    """Windows of anchors from their scores p, as wide arrays: p, and the least and greatest score allowed.

    bounds (low, high): low * p <= 100 * s <= high * p, in whole numbers; none: any score.
    """
    most = max(map(len, scores), default=0)
    p = np.array([[*x, *[0] * (most - len(x))] for x in scores], np.int64).reshape(len(scores), most)
    there = np.arange(most) < np.array([len(x) for x in scores])[:, None]
    low, high = (-(-bounds[0] * p // 100), bounds[1] * p // 100) if bounds else (np.full(p.shape, LOW), np.full(p.shape, HIGH))
    return p, np.where(there, low, HIGH).astype(float), np.where(there, high, LOW).astype(float)


def _searched(leaves: DataFrame, tiles: DataFrame, anchors: DataFrame, blocks: int, k: int, bounds: tuple[int, int] | None) -> DataFrame:
    """The first k rows per anchor and score p: anchor, p, other, score, rank.

    anchors: anchor (a number of its own), vec_id, label, x, block, scores (array<long>). Without
    bounds rows of the anchor's label are searched, with bounds those of other labels.
    """
    same = bounds is None
    boxes = tiles.orderBy("tile").collect()  # MOST_TILES rows at most
    numbers = [r["tile"] for r in boxes]
    as_rows = lambda c: np.frombuffer(b"".join(bytes(r[c]) for r in boxes), np.int32).reshape(len(boxes), -1)
    top = Boxes(as_rows("lo"), as_rows("hi"), np.array([r["label_lo"] for r in boxes]), np.array([r["label_hi"] for r in boxes])) if boxes else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                q = matrix(part.column("x"), top.lo.shape[1]).astype(float)
                (least, most), (_, low, high) = top.products(q), windows_of(part.column("scores").to_pylist(), bounds)
                ok = top.allowed(part.column("label").to_numpy(), same)
                ok &= ((most[:, :, None] >= low[:, None, :]) & (least[:, :, None] <= high[:, None, :]) & (low <= high)[:, None, :]).any(axis=2)
                for t in np.flatnonzero(ok.any(axis=0)):
                    some = part.filter(pa.array(ok[:, t]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, numbers[t], np.int32)), *some.columns], names=["tile", *some.schema.names])

    def search(anchors: pa.Table, leaves: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and leaves.num_rows:
            tree = Tree(leaves)
            anchors = anchors.sort_by("anchor")
            for at in range(0, anchors.num_rows, AT_ONCE):
                part = anchors.slice(at, AT_ONCE).combine_chunks()
                p, low, high = windows_of(part.column("scores").to_pylist(), bounds)
                if p.shape[1]:
                    a, w, other, score = tree.search(part.column("vec_id").to_numpy(), part.column("label").to_numpy(),
                                                     matrix(part.column("x").combine_chunks(), tree.x.shape[1]).astype(float), low, high, k, same)
                    out.append((part.column("anchor").to_numpy()[a], p[a, w], other, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "p", "other", "score"])

    sent = anchors.select("anchor", "vec_id", "label", "x", "block", "scores").mapInArrow(
        send, "tile int, anchor long, vec_id long, label int, x array<int>, block int, scores array<long>")
    dealt = leaves.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = sent.groupBy("tile", "block").cogroup(dealt.groupBy("tile", "block")).applyInArrow(search, "anchor long, p long, other long, score long")
    order = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of anchors among vectors; both have vec_id, label and x (array<int>, see entries).

    Per anchor, its positives are the first rows of its label by falling inner product, ties by
    smaller vec_id; per anchor and positive, the first rows of other labels whose score s obeys
    low * p <= 100 * s <= high * p for the positive's score p. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    A row is never a partner of rows of its own vec_id. Rows with a null vec_id, label or x
    take no part; equal rows count once; rows of one vec_id that differ are rows of their own.
    Vectors that are not of the most common length (of equally common ones, the longest) take no
    part. Empty vectors all score 0. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    slim = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "x").dropna().distinct()
    rows = stored(slim(vectors), "rtree-rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not common:
        return spark.createDataFrame([], schema)
    leaves, tiles = packed(rows.where(F.size("x") == common["d"]))
    asked = slim(anchors).where(F.size("x") == common["d"]).withColumn("anchor", F.xxhash64("vec_id", "label", "x"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.col("anchor"), F.lit(blocks)).cast("int"))
    first = stored(_searched(leaves, tiles, asked.withColumn("scores", F.array(F.lit(0).cast("long"))), blocks, positives, None).select(
        "anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = first.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # `positives` at most
    found = _searched(leaves, tiles, asked.join(scores, "anchor"), blocks, negatives, (low, high))
    found = found.select("anchor", F.col("p").alias("positive_score"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return first.join(found, ["anchor", "positive_score"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of each embedding whose id is divisible by 100, among all embeddings."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", relabelled.alias("label"), entries(F.col("embedding")).alias("x"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


#: The same rows in DuckDB SQL.
OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""
