"""MinHash near-duplicates from bottom-k sketches of one hash function.

A text's set is its distinct word shingles, each hashed to 64 bits. The k smallest hashes are
its bottom-k sketch; a set of at most k shingles is held whole by it. Texts with equal sets
form a class, named by the digest of the set, so copies never meet as pairs.

Inverted lists over retained values find candidates. Sets as similar as the threshold share
most retained values, so two sketches that agree in `share` of m values must agree in one of
the m - share + 1 that are rarest over all classes (ties by value). Only those are listed: a
passage that many documents hold comes last and is listed where little else is shared. Two
sweeps are made, the second over what the first left and with the whole sketch.

Each class is compared with the head of its lists first (the class with the fewest values of
its own), one pair per class. Then pairs of classes that are still apart are compared, unless
the values that nobody shares, up to where both sketches reach, already rule a link out. A long
list (a template of many texts, copies with a few words changed) is not compared pair by pair: the
head, the class with the fewest values of its own, is asked how each class differs from it, on full
sets. Two classes that link with the head need no other pair. If one of two linked classes does not,
nearly half of either's differences (values it lacks or has beside the head) are the other's too, and
how many follows from their sizes. Values that nobody else in the list differs by don't count, so a
class that differs mostly by words of its own meets nobody; the others meet by their rarest
differences. A group of n near copies and n texts of one template so cost about n pairs.
The bottom k of the union of two sketches estimates their similarity; where
it holds both sets whole it is exact, all others that pass are checked on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import LOWERED, mix, slices, stored, text_arg, word_hashes

FIRST_K = 32  # retained values of the first sweep
FIRST_SHARE = 16  # of these, similar sets share so many (mean 27 at 0.85, 5.5 deviations less); 14 at 0.8
LAST_K = 20  # retained values by which classes that are still apart meet
LAST_SHARE = 8  # of these, similar sets share so many (mean 17 at 0.85, 5.6 deviations less); 7 at 0.8
SIGMAS = 5.0
SLICE = 250_000  # bytes of text that a task works on at once
LONG = 64  # classes in a list, beyond which its head is asked how they differ from it
EVERY = 16  # of a sketch's shared values, one in so many goes along to bound what two classes share


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    flat, sizes = word_hashes(texts, LOWERED)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j: j + len(rolled)]
        rolled = mix(rolled)
        for n in sizes.tolist():
            if n >= width:
                out.append(np.unique(rolled[at: at + n - width + 1]))
            elif n:
                h = np.uint64(n)
                for x in flat[at: at + n]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def _signed(a: np.ndarray) -> np.ndarray:
    """Order-preserving 64-bit signed form."""
    return (a ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, width: int = 5, k: int = 256) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, digest of the set (null if empty), sketch (k smallest hashes, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                kept = [_signed(s[:k]) for s in sets]
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("t"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else [], pa.int64())),
                ], names=["doc_id", "t", "n_shingles", "digest", "sketch"])

    return _keyed(docs).mapInArrow(run, "doc_id long, t long, n_shingles long, digest binary, sketch array<long>")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, text as bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("t"), text_arg())


def union_estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int) -> tuple[int, int, bool]:
    """Shared values, values, and whether they are those of the whole sets."""
    both = np.union1d(a, b)
    whole = na <= k and nb <= k
    if not whole:
        both = both[:k]
    shared = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(shared, both[-1], "right")) if len(both) else 0, len(both), whole


def _estimated(pairs: DataFrame, sk: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose union sketch passes: a, b, sure (true: the sketch was exact), id and text hash of both."""
    t = num / den
    names = ["a", "b", "ida", "ta", "idb", "tb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            oa, va = (x.to_numpy() for x in (batch.column("sa").offsets, batch.column("sa").values))
            ob, vb = (x.to_numpy() for x in (batch.column("sb").offsets, batch.column("sb").values))
            keep, sure = [], []
            for i in range(batch.num_rows):
                x, n, whole = union_estimate(va[oa[i]: oa[i + 1]], vb[ob[i]: ob[i + 1]], na[i], nb[i], k)
                drawn = n / max((na[i] + nb[i]) / (1 + t), n)  # of the union of two sets at t, which the sketch may nearly hold
                ok = den * x >= num * n if whole else x >= n * t - SIGMAS * (n * t * (1 - t) * (1 - drawn)) ** 0.5
                if ok:
                    keep.append(i)
                    sure.append(whole)
            kept = batch.select(names).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sure, pa.bool_())], names=[*names, "sure"])

    left = sk.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("doc_id").alias("ida"), F.col("t").alias("ta"))
    right = sk.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("doc_id").alias("idb"), F.col("t").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select(
        *names, "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary, ida long, ta long, idb long, tb long, sure boolean")


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (with ida, ta, idb, tb) with both texts: xa, xb."""
    ids = pairs.select(F.col("ida").alias("doc_id"), F.col("ta").alias("t")).union(pairs.select("idb", "tb")).distinct()
    texts = _keyed(docs).join(ids, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    left = texts.select(F.col("doc_id").alias("ida"), F.col("t").alias("ta"), F.col("text").alias("xa"))
    right = texts.select(F.col("doc_id").alias("idb"), F.col("t").alias("tb"), F.col("text").alias("xb"))
    return pairs.join(left, ["ida", "ta"]).join(right, ["idb", "tb"]).select("a", "b", "xa", "xb")


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number and both full sets."""
    for lo, hi in slices(batch, "xa", SLICE):
        part = batch.slice(lo, hi - lo)
        a, b = (shingle_sets(part.column(c).to_pylist(), width) for c in ("xa", "xb"))
        yield from zip(range(lo, hi), a, b, strict=True)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links among the pairs, on the full sets of both texts: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, x, y in _sets_of(batch, width):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and den * shared >= num * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _with_texts(pairs, docs).mapInArrow(run, "a binary, b binary")


def _differences(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of each pair of a class a and a head b: a, b, n and nb (sizes of the full sets), vals (that one of them has and the other has not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n", "nb", "vals"]
        for batch in batches:
            rows, held = [], 0
            for i, x, y in _sets_of(batch, width):
                rows.append((i, len(x), len(y), np.setxor1d(x, y, assume_unique=True)))
                held += len(rows[-1][3])
                if held > 1_000_000 or i == batch.num_rows - 1:
                    at, n, nb, vals = zip(*rows, strict=True)
                    some = batch.select(["a", "b"]).take(pa.array(at))
                    ends = np.cumsum([0, *map(len, vals)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        *some.columns, pa.array(n, pa.int64()), pa.array(nb, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(vals)), pa.int64()))], names=names)
                    rows, held = [], 0

    return _with_texts(pairs, docs).mapInArrow(run, "a binary, b binary, n long, nb long, vals array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges (a, b).

    Alternates joining larger neighbours and smaller neighbours to the smallest one until
    nothing changes; each step is a written table. Nodes without an edge have no row.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    marks = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    mark = now.agg(*marks).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        now = stored(small, "edges")
        got = now.agg(*marks).first()
        if got == mark:
            break
        mark = got
    ends = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = ends.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return ends.union(roots)


def _share(m: int, most: int, t: float) -> int:
    """Of m retained values, how many sets as similar as t share, less SIGMAS deviations; `most` at most."""
    return max(1, min(most, math.floor(m * t - SIGMAS * (m * t * (1 - t)) ** 0.5)))


def _prefixes(values: DataFrame, whole: int, share_of) -> DataFrame:
    """The rarest shared values of each node: node, n, m, own (values nobody else has), prefix, held (all that others have), v.

    values: node, n, m, v. share_of(n, m): how many of its m values a partner shares.
    """
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(often, "v").groupBy("node", "n", "m").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))  # at most the sketch size
    held = held.withColumn("own", F.col("m") - F.size("held"))
    take = F.col("m") - share_of(F.col("n"), F.col("m")) + 1 - F.col("own")
    held = held.withColumn("take", take.cast("int")).where("take > 0")
    return held.select("node", "n", "m", "own", F.slice("held.v", 1, F.col("take")).alias("prefix"), "held.v").withColumnRenamed(
        "v", "held").withColumn("v", F.explode("prefix"))


def _differing_alike(differences: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b of different components that may be linked, and do not both link with their head.

    differences: g (the head), node, n, nb, c (component), vals. With a set's differences from the
    head as its own, two sets of n and m values with x differences in common differ by d = |A| + |B| - 2x
    values, and are linked if (den + num) * d <= (den - num) * (n + m): if 2 * (den + num) * x reaches
    the sum of both weights, (den + num) * |A| - (den - num) * n each. A set links with the head if its
    weight is at most (den - num) * nb, else it is far.
    """
    both, less = den + num, den - num
    weight = both * F.size("vals") - less * F.col("n")
    sides = differences.withColumn("weight", weight).withColumn("far", F.col("weight") > less * F.col("nb"))
    key = ["g", "node", "n", "nb", "c", "weight", "far"]
    values = sides.select(*key, F.explode("vals").alias("v"))
    often = values.groupBy("g", "v").agg(F.count("*").alias("df"), F.max("far").alias("any")).where("df > 1 and any").drop("any")
    held = values.join(often, ["g", "v"]).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))  # at most the text's own set and its head's
    # Common differences, at least: of a partner that is far, and of one that links with the head.
    largest = F.floor(F.col("n") * den / F.lit(num))
    alike = F.greatest(F.floor((F.col("weight") + less * F.col("nb")) / (2 * both)) + 1, F.ceil((F.col("weight") - less * largest) / both))
    near = F.ceil((F.col("weight") - less * F.least(largest, F.floor(F.col("nb") * den / F.lit(num)))) / both)
    take = F.size("held") + 1 - F.greatest(alike, F.lit(1))
    long = F.when(F.col("far"), F.greatest(take, F.size("held") + 1 - F.greatest(near, F.lit(1)))).otherwise(take)
    held = held.withColumn("take", take.cast("int")).withColumn("long", F.least(long, F.size("held")).cast("int")).where("long > 0")
    held = stored(held.select(
        *key, "take", F.size("held").alias("open"), F.slice("held.v", 1, F.col("long")).alias("prefix")).withColumn("long", F.size("prefix")), "held")
    left = held.where("far").select(
        "g", "node", "n", "c", "weight", "open", "take", "prefix", F.posexplode("prefix").alias("at", "v"))
    right = held.where("take > 0").withColumn("prefix", F.slice("prefix", 1, F.col("take"))).select(
        "g", *(F.col(x).alias("r" + x) for x in ("node", "n", "c", "weight", "open", "far", "prefix")), F.explode("prefix").alias("v"))
    pairs = left.join(right, ["g", "v"]).where(
        (F.col("c") != F.col("rc"))
        & (~F.col("rfar") | ((F.col("at") < F.col("take")) & (F.col("node") < F.col("rnode"))))
        & (den * F.least("n", "rn") >= num * F.greatest("n", "rn"))
        & (2 * both * F.least("open", "ropen") >= F.col("weight") + F.col("rweight"))
        & (F.array_intersect("prefix", "rprefix")[0] == F.col("v")))
    return pairs.select(F.least("node", "rnode").alias("a"), F.greatest("node", "rnode").alias("b"))


def _every(values: Column) -> Column:
    """One in EVERY of the sorted values."""
    return F.filter(values, lambda _, i: (i + 1) % EVERY == 0)


def _up_to(count: str, steps: str, reach: Column) -> Column:
    """The most that `count` sorted values, of which steps are one in EVERY, can have up to reach."""
    return F.least(F.col(count), EVERY * F.size(F.filter(steps, lambda x: x <= reach)) + (EVERY - 1))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100, k: int = 256) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are not read. Two documents are linked if
    den * intersection >= num * union of their shingle sets (num / den at least 0.8).
    component_id is the smallest doc_id that links reach, itself included; kept says whether
    that is the document's own. One row comes back per row that came in.

    Null or wordless text: empty set, linked with nothing. Null doc_id: linked with nothing,
    component_id null, kept. Repeated rows get equal results; rows with one doc_id but
    different texts are each judged by their own text. Equal sets are linked, the smallest
    id stands for them. Empty table: no rows.
    """
    return _grouped(docs, width, num, den, k).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100, k: int = 256) -> DataFrame:
    """near_duplicates() with t (hash of the text), digest and component (a digest, the same for all that links reach)."""
    t = num / den
    sk = stored(sketches(docs, width, k), "sketches")
    ids = sk.select("doc_id", "t", "n_shingles", "digest")
    reps = ids.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "t")).alias("rep")).select("digest", "rep.*")
    key = ["digest", "doc_id", "t"]
    nodes = stored(
        sk.where("digest is not null").join(reps, key, "left_semi")
        .select(*key, F.col("n_shingles").alias("n"), F.slice("sketch", 1, FIRST_K).alias("top"))
        .dropDuplicates(key).withColumnRenamed("digest", "node"), "nodes")

    # First sweep: a few values of every class.
    first = _prefixes(
        nodes.select("node", "n", F.size("top").cast("long").alias("m"), F.explode("top").alias("v")), k,
        lambda n, m: F.ceil(m * _share(FIRST_K, FIRST_SHARE, t) / FIRST_K))
    lone = first.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    left = first.join(lone, "v", "left_semi").select("node").distinct()

    # Second sweep: all retained values of the classes that are left.
    near = stored(
        sk.where("digest is not null").join(
            nodes.join(left, "node", "left_semi").select(F.col("node").alias("digest"), "doc_id", "t"), key, "left_semi")
        .dropDuplicates(key)
        .select(F.col("digest").alias("node"), "doc_id", "t", F.col("n_shingles").alias("n"), "sketch"), "near")
    slack = F.lit(SIGMAS * (k * t * (1 - t)) ** 0.5)

    def second_share(n: Column, m: Column) -> Column:
        # A partner has up to n / t shingles. If that is more than k, its sketch may hide some of them.
        whole = F.ceil(n * num / F.lit(den))
        seen = F.floor(k * t - slack * F.sqrt(F.greatest(F.lit(0.0), 1 - k * num / (n * den))))
        return F.when(n * den < (k + 1) * num, whole).when(n <= k, F.least(whole, seen)).otherwise(F.floor(k * t - slack))

    lists = stored(_prefixes(
        near.select("node", "n", F.size("sketch").cast("long").alias("m"), F.explode("sketch").alias("v")), k,
        second_share)
        .withColumn("steps", _every(F.sort_array("held"))).drop("prefix", "held"), "lists")
    head = lists.groupBy("v").agg(F.min(F.struct("own", "node")).alias("h"), F.count("*").alias("c")).where("c > 1")
    star = lists.join(head, "v").groupBy("node").agg(F.min("h").alias("h")).select(
        F.col("node").alias("a"), F.col("h.node").alias("b")).where("a <> b")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(pairs: DataFrame, name: str) -> DataFrame:
        passed = stored(_estimated(pairs, near, k, num, den), f"{name}-passed")
        open_pairs = passed.where("not sure")
        return stored(passed.where("sure").select("a", "b").union(_verified(open_pairs, docs, width, num, den)), name)

    first_links = links(star, "star")
    known = stored(components(first_links), "known")

    # Pairs that are still apart meet by a few values, each pair in the list of its first common
    # one. A value of one class that no sketch holds is missing from another class only if that
    # one's sketch reaches so far: what two classes share is bounded up to the smaller reach.
    reach = near.select("node", "n", F.when(F.col("n") > k, F.element_at("sketch", -1)).otherwise(F.lit((1 << 63) - 1)).alias("reach"))
    facts = stored(
        lists.select("node", "n", (F.col("m") - F.col("own")).alias("open"), "steps").dropDuplicates(["node", "n"])
        .join(reach, ["node", "n"]).join(known, "node", "left")
        .select("node", "n", "open", "steps", "reach", F.coalesce("component", "node").alias("c")), "facts")
    last = _prefixes(
        near.select("node", "n", F.least(F.size("sketch"), F.lit(LAST_K)).cast("long").alias("m"), F.explode(F.slice("sketch", 1, LAST_K)).alias("v")),
        k, lambda n, m: F.ceil(m * _share(LAST_K, LAST_SHARE, t) / LAST_K))

    def bounded(side: DataFrame) -> DataFrame:
        """Pairs a, b of one list v that are apart and that the bounds allow; side has facts and the list's largest part."""
        rest = side.where("c <> most").select("v", *(F.col(c).alias("r" + c) for c in ("node", "n", "c", "open", "prefix", "steps", "reach")))
        both = F.least("reach", "rreach")
        most = F.least(_up_to("open", "steps", both), _up_to("ropen", "rsteps", both))
        whole = (num + den) * F.least("open", "ropen") >= num * (F.col("n") + F.col("rn"))
        hidden = F.greatest(F.lit(0.0), 1 - k * (1 + t) / (F.col("n") + F.col("rn")))  # share of the union beyond the sketch
        pairs = rest.join(side, "v").where(
            (F.col("c") != F.col("rc"))
            & (den * F.least("n", "rn") >= num * F.greatest("n", "rn"))
            & F.when(F.greatest("n", "rn") <= k, whole).otherwise(most >= k * t - slack * F.sqrt(hidden) - 1e-6)
            & (F.array_intersect("prefix", "rprefix")[0] == F.col("v")))
        return pairs.select(F.least("node", "rnode").alias("a"), F.greatest("node", "rnode").alias("b"))

    side = stored(last.select("v", "node", "prefix").join(facts, "node"), "apart")
    own = F.least(F.col("n"), F.lit(k)) - F.col("open")
    lists_now = stored(
        side.groupBy("v", "c").agg(F.count("*").alias("size"), F.min(F.struct(own.alias("own"), "n", "node")).alias("h"))
        .groupBy("v").agg(F.max(F.struct("size", "c")).alias("x"), F.count("*").alias("parts"), F.sum("size").alias("size"), F.min("h").alias("h"))
        .where("parts > 1").select("v", F.col("x.c").alias("most"), F.when(F.col("size") > LONG, F.col("h.node")).alias("head")), "lists")
    pairs = bounded(side.join(lists_now.where("head is null"), "v"))
    if not lists_now.where("head is not null").isEmpty():
        asked = side.join(lists_now.where("head is not null"), "v").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
        asked = asked.join(near.select(F.col("node").alias("a"), F.col("doc_id").alias("ida"), F.col("t").alias("ta")), "a").join(
            near.select(F.col("node").alias("b"), F.col("doc_id").alias("idb"), F.col("t").alias("tb")), "b")
        differ = _differences(asked, docs, width).join(facts.select(F.col("node").alias("a"), "c"), "a").join(
            facts.select(F.col("node").alias("b"), F.col("c").alias("hc")), "b")
        differ = stored(differ.select(F.col("b").alias("g"), F.col("a").alias("node"), "n", "nb", "c", "hc", "vals"), "differ")
        with_head = differ.where((F.col("c") != F.col("hc")) & ((den + num) * F.size("vals") <= (den - num) * (F.col("n") + F.col("nb"))))
        pairs = pairs.union(with_head.select(F.least("node", "g").alias("a"), F.greatest("node", "g").alias("b"))).union(
            _differing_alike(differ, num, den))
    more = links(stored(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs"), "rest")
    classes = reps.join(known.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "doc_id", F.coalesce("component", "digest").alias("component"))
    if not more.isEmpty():  # links between the components that the first ones made
        into = classes.select("digest", "component")
        between = more.join(into.toDF("a", "ca"), "a").join(into.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(between).toDF("component", "root")
        classes = classes.join(joined, "component", "left").select("digest", "doc_id", F.coalesce("root", "component").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    out = ids.join(classes.drop("doc_id").join(smallest, "component"), "digest", "left")
    own = F.coalesce("smallest", "doc_id")
    return out.select(
        "doc_id", "t", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group of near_duplicates(): of the rows with the smallest doc_id, the
    one whose set, then text, has the smaller hash, and of rows equal in both the smallest. Texts without words are
    groups of their own. Rows without a doc_id stay. Columns are those of docs."""
    rows = _grouped(docs, **how).where("kept and doc_id is not null").groupBy("component", "doc_id", "digest", "t").agg(F.count("*").alias("n"))
    rows = stored(rows, "kept")  # read twice
    one = rows.where("component is not null").groupBy("component").agg(
        F.min(F.struct("doc_id", "digest", "t", "n")).alias("row")).select("row.doc_id", "row.t", "row.n")
    ids = one.union(rows.where("component is null").select("doc_id", "t", "n")).select(
        F.col("doc_id").alias("_kept_id"), F.col("t").alias("_kept_t"), F.col("n").alias("_kept_n"))
    found = docs.join(ids, (docs["doc_id"] == ids["_kept_id"]) & (_text_hash(docs["text"]) == ids["_kept_t"]))
    lone = found.where("_kept_n = 1").select(*[docs[c] for c in docs.columns])
    more = found.where("_kept_n > 1").groupBy("_kept_id", "_kept_t").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_kept_row")).select("_kept_row.*")
    return lone.union(more).union(docs.where("doc_id is null"))


def op1_near_duplicates(spark, sf_dir):
    """Near-duplicates of all documents at 0.85."""
    from docmetrics.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
