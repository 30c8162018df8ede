"""Toxic spans by a linear-chain conditional random field.

Tokens are the words of a text; the states say whether a token is part of a toxic span. A
token's features are its lower-case form without punctuation, its beginnings of three to five
letters and its last three; those that no toxic token has weigh nothing. Rows are labelled, not
tokens, so labelled tokens are derived first: a word or beginning that is far more frequent
in documents labelled toxic marks its tokens there. The field is then fitted to these tokens by
gradient ascent on a bounded sample of labelled rows.

Forward-backward runs over the joined tokens of many texts: with two states a step is a map
r -> (a + b r) / (c + d r), and maps compose as 2 x 2 matrices. The tokens are cut into pieces
whose maps are composed first, so that all pieces are then walked at once. The first token of a
text has a constant map, which keeps texts apart. Marginals give a document its score (a
logistic function of the greatest one and of their sum, fitted on the same rows) and its spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import learnable, slices, table, text_arg

EDGE = re.compile(r"^\W+|\W+$")
TOKEN = re.compile(r"\S+")
LIMIT = 30.0  # of a token's score


def parts(word: str) -> list[str]:
    """The features of a token by name; none without a letter or digit."""
    w = EDGE.sub("", word)
    if not w:
        return []
    return ["=" + w, *["^" + w[:k] for k in (3, 4, 5) if len(w) >= k], "$" + w[-3:]]


def walked(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a + b r[t-1]) / (c + d r[t-1]) from r[-1] = 1, for all t."""
    n = len(a)
    if not n:
        return np.zeros(0)
    width = max(1, int(n ** 0.5))
    rows = -(-n // width)  # pieces; a step works on all of them
    pad = rows * width - n
    a, b, c, d = (np.concatenate([x, np.full(pad, y)]).reshape(rows, width).T.copy()
                  for x, y in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0)))
    p, q, u, v = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)  # r -> (p r + q) / (u r + v)
    for i in range(width):
        p, q, u, v = b[i] * p + a[i] * u, b[i] * q + a[i] * v, d[i] * p + c[i] * u, d[i] * q + c[i] * v
        top = np.maximum(np.maximum(p, q), np.maximum(u, v))
        p, q, u, v = p / top, q / top, u / top, v / top
    start, r = np.empty(rows), 1.0
    for k, (x, y, z, w) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
        start[k] = r
        r = min(1e30, max(1e-30, (x * r + y) / (z * r + w)))
    out = np.empty((width, rows))
    now = start
    for i in range(width):
        now = np.clip((a[i] + b[i] * now) / (c[i] + d[i] * now), 1e-30, 1e30)
        out[i] = now
    return out.T.ravel()[:n]


def forward_backward(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and expected moves between neighbours (0-1, 1-0, 1-1) and at starts.

    e: token scores; first: marks the first token of each text; move: log weights of a start
    in the toxic state and of the moves 0-1, 1-0, 1-1.
    """
    if not len(e):
        return np.zeros(0), np.zeros(4)
    s, m01, m10, m11 = np.exp(move)
    y = np.exp(np.clip(e, -LIMIT, LIMIT))
    r = walked(y * np.where(first, s, m01), np.where(first, 0.0, y * m11), np.ones(len(e)), np.where(first, 0.0, m10))
    last = np.append(first[1:], True)
    nxt = np.append(y[1:], 1.0)
    q = walked(*(x[::-1] for x in (np.where(last, 1.0, m10), np.where(last, 0.0, m11 * nxt), np.ones(len(e)), np.where(last, 0.0, m01 * nxt))))[::-1]
    p = r * q / (1 + r * q)
    after = nxt * np.append(q[1:], 1.0)
    total = 1 + m01 * after + r * (m10 + m11 * after)
    inner = ~last
    return p, np.array([p[first].sum(), (m01 * after / total)[inner].sum(), (r * m10 / total)[inner].sum(),
                        (r * m11 * after / total)[inner].sum()])


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    move: np.ndarray
    score: np.ndarray  # of 1, the greatest marginal, log(1 + sum of marginals)


def summed(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Per text: 1, the greatest marginal, log(1 + their sum)."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = 1
    at = 0
    for i, n in enumerate(sizes):
        if n:
            out[i, 1:] = p[at: at + n].max(), np.log1p(p[at: at + n].sum())
        at += n
    return out


def without_copies(tokens: list[list[str]], toxic: list[int]) -> tuple[list[list[str]], list[int]]:
    """One of each group of texts whose five-word windows have the same smallest hash: copies
    would make their chance words look typical."""
    import xxhash

    kept = {}
    for ws, label in zip(tokens, toxic, strict=True):
        least = min((xxhash.xxh3_64_intdigest(" ".join(ws[i: i + 5])) for i in range(max(1, len(ws) - 4))))
        kept.setdefault((label, least), ws)
    return list(kept.values()), [label for label, _ in kept]


def marking(tokens: list[list[str]], toxic: list[int], chance: float, odds: float) -> set[str]:
    """Words and beginnings that mark toxic tokens.

    All are `odds` times more frequent in toxic documents than in clean ones, and in so many that
    by a chance of 10 ** -chance any of the words tried, if none had a meaning, would be in toxic ones only. Those in 3 %
    of the toxic ones mark; of the others, those that as many toxic documents not yet explained
    have, most first.
    """
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    within = [{x for w in set(ws) for x in parts(w) if x[0] != "$"} for ws in tokens]
    clean: Counter[str] = Counter()
    held: dict[str, list[int]] = {}
    for i, (xs, label) in enumerate(zip(within, toxic, strict=True)):
        if label:
            for x in xs:
                held.setdefault(x, []).append(i)
        else:
            clean.update(xs)
    tried = len(held.keys() | clean.keys())
    least = max(2, math.ceil((chance + math.log10(max(1, tried))) / math.log10((n_toxic + n_clean) / n_toxic)))
    good = {x: at for x, at in held.items() if len(at) >= least and len(at) / n_toxic >= odds * (clean[x] + 0.5) / n_clean}
    marks = {x for x, at in good.items() if len(at) >= max(least, 0.03 * n_toxic)}
    explained = {i for x in marks for i in good[x]}
    while good:
        gain = {x: sum(i not in explained for i in at) for x, at in good.items() if x not in marks}
        best = min(gain, key=lambda x: (-gain[x], x), default=None)
        if best is None or gain[best] < least:
            break
        marks.add(best)
        explained.update(good[best])
    return marks


def train(texts: list[str], toxic: list[int], steps: int = 40, chance: float = 2.0, odds: float = 20.0) -> Model:
    """Fit the field and the document score on whole texts with their labels."""
    tokens, toxic = without_copies([t.lower().split() for t in texts], toxic)
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    marks = marking(tokens, toxic, chance, odds)
    if not marks:  # nothing tells toxic tokens from others
        return Model({}, -LIMIT, np.zeros(4), np.array([-2.0, 4.0, 1.0]))
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for ws in tokens for w in ws), np.int64)
    of = [parts(w) for w in names]
    marked = np.array([any(x in marks for x in f) for f in of] + [False])
    vocabulary: dict[str, int] = {}
    for f, m in zip(of, marked.tolist(), strict=False):
        if m:
            for x in f:
                vocabulary.setdefault(x, len(vocabulary))
    none = len(vocabulary)
    table = np.full((len(names) + 1, 5), none, np.int64)
    for i, f in enumerate(of):
        table[i, : len(f)] = [vocabulary.get(x, none) for x in f]
    sizes = [len(ws) for ws in tokens]
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *sizes])[:-1][np.array(sizes, bool)]] = True
    gold = marked[ids] & np.repeat(np.array(toxic, bool), sizes)
    weights, bias, move = np.zeros(none + 1), -2.0, np.array([0.0, 0.0, 0.0, 0.0])
    hist_w, hist_o = np.full(none + 1, 1e-6), np.full(5, 1e-6)
    inner = ~np.append(first[1:], True) if len(first) else first
    after = np.append(gold[1:], False)
    want = np.array([gold[first].sum(), (~gold & after & inner).sum(), (gold & ~after & inner).sum(), (gold & after & inner).sum()], float)
    for _ in range(steps if len(ids) else 0):
        e = (weights[table].sum(1) + bias)[ids]
        p, got = forward_backward(e, first, move)
        by_word = np.bincount(ids, gold - p, minlength=len(names) + 1)
        g = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), minlength=none + 1) - 0.02 * weights
        g[none] = 0
        hist_w += g * g
        weights += 0.6 * g / np.sqrt(hist_w)
        o = np.concatenate([[float(by_word.sum())], want - got])
        hist_o += o * o
        step = 0.4 * o / np.sqrt(hist_o)
        bias += step[0]
        move = np.clip(move + step[1:], -6, 6)
    p, _ = forward_backward((weights[table].sum(1) + bias)[ids], first, move)
    x, y = summed(p, sizes), np.array(toxic, float)
    score = np.array([-2.0, 4.0, 1.0])
    share = np.where(y > 0, 0.25 / n_toxic, 0.75 / n_clean) * len(y)  # toxic rows are fewer outside the sample
    for _ in range(300 if len(y) else 0):  # Newton steps on a ridge-penalised logistic fit
        m = 1 / (1 + np.exp(-np.clip(x @ score, -30, 30)))
        h = (x * (share * m * (1 - m))[:, None]).T @ x + 0.05 * np.eye(3)
        d = np.linalg.solve(h, x.T @ (share * (y - m)) - 0.05 * (score - np.array([-2.0, 4.0, 1.0])))
        score = score + np.clip(d, -1, 1)
        if np.abs(d).max() < 1e-6:
            break
    return Model({x: float(weights[i]) for x, i in vocabulary.items()}, float(bias), move, score)


def learned(docs: DataFrame, labels: DataFrame, each: int = 1000) -> Model:
    """Fit on about `each` toxic and twice as many clean rows, those whose ids have the smallest hashes.

    Only rows that may be learned from count; toxic null is no label. The bound is on what the
    driver holds; without labelled rows the model scores everything as clean.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(learnable(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = {t: min(1.0, (each if t else 2 * each) / n) for t, n in counts.items()}
    picked = known.where(h < F.when(F.col("toxic") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))) * (1 << 30)).collect()
    if not picked:
        return train([], [])
    ids = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["toxic"]) for r in picked}), "doc_id long, toxic int")
    # The bound on hashes holds for documents too, so that few of them are moved.
    near = docs.where(h < F.lit(max(share.values()) * (1 << 30)))
    rows = near.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, score, spans of every row.

    docs needs doc_id and text; other columns are not read. score is in 0 to 1, higher where
    a toxic label is likelier; null and empty texts have a score too. spans holds start and
    end (characters, end exclusive) of the runs of tokens that are toxic rather than not
    (empty if with_spans is false). Rows are independent: null and repeated ids come back as
    they are. Long texts are read whole. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        known: dict[str, float] = {}

        def emission(word: str) -> float:
            got = known.get(word)
            if got is None:
                if len(known) > 1_000_000:
                    known.clear()
                got = known[word] = sum(weights.get(x, 0.0) for x in parts(word)) + model.bias
            return got

        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                tokens = [t.lower().split() for t in texts]
                sizes = [len(w) for w in tokens]
                e = np.fromiter((emission(w) for ws in tokens for w in ws), float)
                first = np.zeros(len(e), bool)
                first[np.cumsum([0, *sizes])[:-1][np.array(sizes, bool)]] = True
                p, _ = forward_backward(e, first, model.move)
                x = summed(p, sizes)
                scores = 1 / (1 + np.exp(-np.clip(x @ model.score, -30, 30)))
                spans, at = [], 0
                for t, n, top in zip(texts, sizes, x[:, 1].tolist(), strict=True):
                    spans.append(found(t, p[at: at + n] > 0.5) if with_spans and top > 0.5 else [])
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.array(spans, SPANS)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", text_arg()).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def found(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit tokens as character offsets."""
    out: list[dict[str, int]] = []
    before = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if i < len(hit) and hit[i]:
            if before == i - 1 and out:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            before = i
    return out


def op5_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = toxicity(docs, learned(docs, table(spark, sf_dir, "labels")), with_spans=False)
    return rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
