"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words; words are hashed to a fixed number of terms. Document
frequencies are counted over the passages of all documents. A randomised singular value
decomposition of the TF-IDF matrix of all passages of all documents and benchmark items gives the
latent space: tasks multiply their passages with a random matrix and return their part of the Gram
matrix of the products and of the products with the TF-IDF matrix, a row per term. The parts are added
up; from the Gram matrix the driver takes what makes the products an orthonormal basis (Cholesky QR),
and decomposes the projected matrix. Every window of every document is searched in the space.

The latent vector of a window is the sum of its words' vectors, scaled by the singular values.
Windows whose cosine with an item reaches CUT are candidates. They are checked on the
words themselves: the longest common subsequence of item and window, and the share of the item's
answer (its rarest words) that the window has. Long subsequences are copies; shorter ones with
the answer paraphrases. What the check accepts holds some of the item's rarest words, so inverted
lists of these find the windows that the cosine misses: the exact way beside it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmetrics.llm import common
from docmetrics.llm.common import LOWERED, slices, table, text_arg, utf8_of, with_text

TERMS = 1 << 15
PASSAGE = 64  # words of a passage
STEP = 8  # words of a block; windows begin at blocks
CUT = 0.67  # cosine of candidates; see the README for the recall measured
SLICE = 250_000  # bytes of text that a task works on at once
RANK, EXTRA = 48, 16  # latent dimensions, and what the random matrix has beyond them
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"

MATCH = "array<struct<item_id:long,similarity:double,lcs:int,n_words:int,answer_share:double,start:int>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("lcs", pa.int32()), ("n_words", pa.int32()),
                                 ("answer_share", pa.float64()), ("start", pa.int32())]))


#: Letter case and punctuation don't count.
_LETTER = LOWERED.copy()
_LETTER[list(EDGES)] = 0


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return common.word_hashes(texts, _LETTER)


def word_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The term of every word of all texts, and how many words each text has."""
    hashed, sizes = word_hashes(texts)
    return _term(hashed).astype(np.int64), sizes


def _term(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(TERMS - 1)).astype(np.int32)  # TERMS is a power of two


def bare(word: bytes) -> bytes:
    return word.lower().strip(EDGES) or word


class Item(NamedTuple):
    item_id: int
    words: list[bytes]


class Index(NamedTuple):
    idf: np.ndarray
    vectors: np.ndarray  # a term's weighted latent vector


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all texts together: the passage and the term of every word, and the number of passages."""
    term, sizes = word_terms(texts)
    per = -(-sizes // PASSAGE)
    first = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first[:-1], sizes) + within // PASSAGE, term, int(first[-1])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages per term, and passages in all, over all documents. The result has TERMS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE):
                passage, term, k = _passages(batch.column("text").slice(lo, hi - lo).to_pylist())
                key = np.sort((passage * TERMS + term).astype(np.uint32 if k < (1 << 32) // TERMS else np.uint64))
                if len(key):
                    total[:TERMS] += np.bincount((key[np.append(True, key[1:] != key[:-1])] & (TERMS - 1)).astype(np.int64), minlength=TERMS)
                n += k
        total[TERMS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    rows = docs.select(text_arg()).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def _weighted(passage: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF entries by term, with rows of length one: row, term, value; and what each row was divided by."""
    key = np.sort((term * n + passage).astype(np.uint32 if n < (1 << 32) // TERMS else np.uint64))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    col, row = np.divmod(key[at].astype(np.int64), max(n, 1))
    value = np.diff(np.append(at, len(key))) * idf[col]
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    norm[norm == 0] = 1.0
    return row, col, value / norm[row], norm


def _projected(passage: np.ndarray, term: np.ndarray, norm: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The product of the TF-IDF rows with the random matrix. omega: its rows times idf, and a row of zeros, for no word."""
    out = np.zeros((len(norm), omega.shape[1]))
    first = np.searchsorted(passage, np.arange(len(norm)))
    inside = np.arange(PASSAGE) < np.diff(np.append(first, len(term)))[:, None]
    words = np.where(inside, term[np.where(inside, first[:, None] + np.arange(PASSAGE), 0)], TERMS) if len(term) else inside
    for lo in range(0, len(norm), 16):  # as much as stays in a cache
        np.take(omega, words[lo: lo + 16], axis=0).sum(1, out=out[lo: lo + 16])
    return out / norm[:, None]


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, for ascending places that may repeat."""
    if len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total[at[first]] += np.add.reduceat(rows, first, axis=0)


def _add_products(total: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, few: int = 3, chunk: int = 512) -> None:
    """total += a.T @ y, for entries of a by term. Terms of few entries, most of them, are added up entry by entry."""

    def product(i: np.ndarray) -> np.ndarray:
        out = np.take(y, row[i], axis=0)
        out *= value[i, None]
        return out

    first = np.flatnonzero(np.append(True, col[1:] != col[:-1])) if len(col) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(col)))
    for n in range(1, few + 1):
        of = first[size == n]
        for lo in range(0, len(of), chunk):
            i = of[lo: lo + chunk]
            rows = product(i)
            for j in range(1, n):
                rows += product(i + j)
            total[col[i]] += rows
    often = np.flatnonzero(np.repeat(size > few, size))
    for lo in range(0, len(often), chunk):
        i = often[lo: lo + chunk]
        _add_rows(total, col[i], product(i))


def fit(docs: DataFrame, benchmark: DataFrame, seed: int = 11) -> Index:
    """Term weights over all documents, and the latent space of all passages of all documents and benchmark items."""
    df, n = document_frequencies(docs)
    idf = np.log(1 + n / (1.0 + df))
    width = RANK + EXTRA

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.default_rng(seed).standard_normal((TERMS, width)).astype(np.float32)  # each task makes the same one
        weighted = np.vstack([omega * idf[:, None], np.zeros((1, width))])
        # A task's part of a.T @ y, a row per term, and below it that of y.T @ y.
        total = np.zeros((TERMS + width, width))
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE):
                passage, term, k = _passages(batch.column("text").slice(lo, hi - lo).to_pylist())
                row, col, value, norm = _weighted(passage, term, k, idf)
                y = _projected(passage, term, norm, weighted)
                total[TERMS:] += y.T @ y
                _add_products(total, row, col, value, y)
        yield from _as_rows(total)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS + width, width))
        for batch in batches:
            at = batch.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            _add_rows(total, at[order], np.frombuffer(b"".join(batch.column("cells").to_pylist())).reshape(-1, width)[order])
        # The driver gets a few long rows: many short ones would take it several times their memory.
        used = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        for lo in range(0, len(used), 4096):
            cells = [used[lo: lo + 4096].tobytes()], [total[used[lo: lo + 4096]].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], names=["at", "cells"])

    # A task's part has a row per term whatever it reads, so there are a few tasks a core, however long the tables are.
    texts = docs.select(text_arg()).union(benchmark.select(text_arg())).coalesce(3 * docs.sparkSession.sparkContext.defaultParallelism)
    b = np.zeros((TERMS + width, width))
    for r in texts.mapInArrow(parts, "at int, cells binary").repartition("at").mapInArrow(summed, "at binary, cells binary").collect():
        b[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["cells"]).reshape(-1, width)
    g, b = b[TERMS:], b[:TERMS]
    # q = y @ turn has orthonormal columns; a ridge keeps small samples solvable.
    lower = np.linalg.cholesky(g + np.eye(width) * (1e-9 * np.trace(g) + 1e-12))
    turn = np.linalg.inv(lower).T
    for lo in range(0, TERMS, 4096):
        b[lo: lo + 4096] = b[lo: lo + 4096] @ turn  # a.T @ q
    values, u = np.linalg.eigh(b.T @ b)
    order = np.argsort(-values)[:RANK]
    sigma = np.sqrt(np.maximum(values[order], 1e-12))
    good = sigma > 1e-4 * sigma[0]
    # b @ u / sigma are the right singular vectors.
    scaled = u[:, order] / sigma * np.where(good, 1 / np.where(good, sigma, 1.0), 0.0)
    vectors = np.zeros((TERMS, RANK), np.float32)
    for lo in range(0, TERMS, 4096):
        vectors[lo: lo + 4096] = b[lo: lo + 4096] @ scaled * idf[lo: lo + 4096, None]
    return Index(idf, vectors)


def _as_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix that are not all zero, each with its number."""
    used = np.flatnonzero(total.any(axis=1))
    for lo in range(0, len(used), 4096):
        at = used[lo: lo + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in total[at]], pa.binary())], names=["at", "cells"])


def lcs(item: list[bytes], window: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in window:
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def items_of(benchmark: DataFrame, least: int, per_block: int = 10_000) -> Iterator[list[Item]]:
    """The items in blocks of about per_block. Those with fewer than `least` words are left out."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-rows.count() // per_block))
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = [Item(r["item_id"], [bare(w) for w in r["text"].encode().split()]) for r in got]
        yield [x for x in items if len(x.words) >= least]


def with_matches(docs: DataFrame, columns: list[str], index: Index, items: list[Item],
                 copied: float = 0.8, shared: float = 0.5, answered: float = 0.8) -> DataFrame:
    """The given columns as c0, c1, ..., and the matches of the items in text.

    A match has at least `copied` of the item's words as a common subsequence, or `shared` of
    them and `answered` of its answer. One match per item: the longest subsequence, then the
    highest cosine, then the first window.
    """
    rows, text = with_text(docs, columns)
    schema = StructType([*rows.schema.fields[:len(columns)], *StructType.fromDDL(f"matches {MATCH}").fields])
    spans = np.array([-(-(len(x.words) + STEP - 1) // STEP) for x in items], int)
    vec = item_vectors(items, index)
    answers = [_answer(x.words, index.idf) for x in items]
    lists = _lists(items, index.idf, copied, answered)
    known = [word_hashes([b" ".join(x.words)])[0] for x in items]
    vocabulary = _vocabulary(known)
    known = [k.tolist() for k in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, text, SLICE):
                part = batch.slice(lo, hi - lo)
                texts = utf8_of(part.column(text))
                split: dict[int, list[bytes]] = {}
                found: list[dict[int, tuple]] = [{} for _ in texts]
                hashed, sizes = word_hashes(texts)
                near = itertools.chain(_near(hashed, sizes, index, vec, spans), _candidates(hashed, sizes, lists, spans))
                begin = np.cumsum(sizes) - sizes
                for doc, block, item in _sharing(near, hashed, sizes, spans, vocabulary, shared):
                    start, stop, n = max(0, (block - 1) * STEP), (block + spans[item] + 1) * STEP, len(items[item].words)
                    have = set(hashed[begin[doc] + start: begin[doc] + min(stop, sizes[doc])].tolist())
                    if sum(map(have.__contains__, known[item])) < shared * n:
                        continue  # no subsequence can be long enough; equal words have equal hashes
                    if doc not in split:
                        split[doc] = [bare(w) for w in texts[doc].split()]
                    window = split[doc][start:stop]
                    have = set(window)
                    length = lcs(items[item].words, window)
                    if length >= shared * n:
                        share = sum(w in have for w in answers[item]) / len(answers[item])
                        if length >= copied * n or share >= answered:
                            cos = _cosine(split[doc][block * STEP: (block + spans[item]) * STEP], index, vec[item])
                            rank = (length, round(cos, 6), -start)
                            if item not in found[doc] or rank > found[doc][item][0]:
                                found[doc][item] = rank, {"item_id": items[item].item_id, "similarity": cos, "lcs": length, "n_words": n,
                                                          "answer_share": share, "start": start}
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(columns)], pa.array([[m for _, (_, m) in sorted(f.items())] for f in found], MATCH_TYPE)],
                    names=[*part.schema.names[:len(columns)], "matches"])

    return rows.mapInArrow(run, schema)


def item_vectors(items: list[Item], index: Index) -> np.ndarray:
    """Latent vectors of the items, of length one."""
    vec = np.array([index.vectors[word_terms([b" ".join(x.words)])[0]].sum(0) for x in items]).reshape(-1, RANK)
    return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)


def _answer(words: list[bytes], idf: np.ndarray) -> list[bytes]:
    """The rarest quarter of an item's distinct words, two at least."""
    distinct = list(dict.fromkeys(words))
    weight = dict(zip(distinct, idf[word_terms([b" ".join(distinct)])[0]].tolist(), strict=True))
    distinct.sort(key=lambda w: -weight[w])
    return distinct[: max(2, len(distinct) // 4)]


def _cosine(words: list[bytes], index: Index, vector: np.ndarray) -> float:
    w = index.vectors[word_terms([b" ".join(words)])[0]].sum(0)
    return float(w @ vector / max(float(np.linalg.norm(w)), 1e-9))


class Lists(NamedTuple):
    hashes: np.ndarray  # of the listed words, ascending
    first: np.ndarray  # where the items of each begin
    items: np.ndarray
    need: np.ndarray  # per item: so many of its listed words are in all that the check accepts


def _lists(items: list[Item], idf: np.ndarray, copied: float, answered: float) -> Lists:
    """Inverted lists of each item's rarest words, as many as make a match hold several of them.

    A copy misses at most n - copied * n words; the fewest listed words are left if these are
    the ones that the item repeats least. A paraphrase has `answered` of the answer.
    """
    hashes, owner, need = [], [], []
    for i, x in enumerate(items):
        hashed = word_hashes([b" ".join(x.words)])[0]
        word, often = np.unique(hashed, return_counts=True)
        word_idf = idf[_term(word)]
        answer = np.unique(word_hashes([b" ".join(_answer(x.words, idf))])[0])
        n_answer = len(_answer(x.words, idf))
        # Words of one hash are missing together: fewer hashes than words can be there.
        least = max(1, len(answer) - int(n_answer - answered * n_answer + 1e-9))
        rest = np.flatnonzero(~np.isin(word, answer))
        order = np.concatenate([np.flatnonzero(np.isin(word, answer)), rest[np.argsort(-word_idf[rest], kind="stable")]])
        may_miss = int(len(x.words) - copied * len(x.words) + 1e-9)
        took, left = len(answer), 0
        while True:
            gone = int(np.searchsorted(np.cumsum(np.sort(often[order[:took]])), may_miss, "right"))
            left = took - gone
            if left >= least or took == len(order):
                break
            took += 1
        hashes.append(word[order[:took]])
        owner.append(np.full(took, i))
        need.append(max(1, min(least, left)))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    whose = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    listed, first = np.unique(flat[order], return_index=True)
    return Lists(listed, np.append(first, len(flat)), whose[order], np.array(need, np.int64))


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # of all words of all items, ascending
    keys: np.ndarray  # item * number of hashes + place of each word, ascending
    sizes: np.ndarray  # words of each item


def _vocabulary(known: list[np.ndarray]) -> Vocabulary:
    flat = np.concatenate(known) if known else np.zeros(0, np.uint64)
    sizes = np.array([len(k) for k in known], np.int64)
    hashes, place = np.unique(flat, return_inverse=True)
    return Vocabulary(hashes, np.unique(np.repeat(np.arange(len(known)), sizes) * len(hashes) + place), sizes)


def _sharing(found: Iterator[tuple[int, int, int]], hashed: np.ndarray, sizes: np.ndarray, spans: np.ndarray, words: Vocabulary,
             shared: float) -> list[list[int]]:
    """Of the candidates (document, first block, item), once each, those whose window has enough places with words of the item.

    A common subsequence takes one place of the window for each of its words, so the others can't be long enough.
    """
    found = np.array(list(dict.fromkeys(found)), np.int64).reshape(-1, 3)
    if not len(found):
        return []
    some = np.zeros(1 << 20, bool)
    some[(words.hashes >> np.uint64(44)).astype(np.int64)] = True
    place = np.full(len(hashed) + 1, -1, np.int64)
    at = np.flatnonzero(some[(hashed >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(words.hashes, hashed[at]), len(words.hashes) - 1)
    place[at] = np.where(words.hashes[k] == hashed[at], k, -1)
    begin = np.cumsum(sizes) - sizes
    kept = []
    for lo in range(0, len(found), 4096):
        doc, block, item = found[lo: lo + 4096].T
        first = begin[doc] + np.maximum(0, (block - 1) * STEP)
        width = np.minimum(begin[doc] + sizes[doc], begin[doc] + (block + spans[item] + 1) * STEP) - first
        which = np.repeat(np.arange(len(doc)), width)
        seen = place[first[which] + np.arange(len(which)) - (np.cumsum(width) - width)[which]]
        which, seen = which[seen >= 0], seen[seen >= 0]
        key = item[which] * len(words.hashes) + seen
        j = np.minimum(np.searchsorted(words.keys, key), len(words.keys) - 1)
        count = np.bincount(which[words.keys[j] == key], minlength=len(doc))
        kept.extend(found[lo: lo + 4096][count >= shared * words.sizes[item]].tolist())
    return kept


def _near(hashed: np.ndarray, sizes: np.ndarray, index: Index, items: np.ndarray, spans: np.ndarray, cut: float = CUT) -> Iterator[tuple[int, int, int]]:
    """Document, first block and item of windows whose cosine reaches the cut.

    items: vectors of length one; spans: blocks of a window of each item.
    """
    blocks = -(-sizes // STEP)
    total = int(blocks.sum())
    if not total or not len(items):
        return
    doc = np.repeat(np.arange(len(sizes)), blocks)
    first = np.cumsum(blocks) - blocks
    begin = (np.cumsum(sizes) - sizes)[doc] + (np.arange(total) - first[doc]) * STEP
    term = _term(hashed)
    words = begin[:, None] + np.arange(STEP)
    inside = words < np.cumsum(sizes)[doc][:, None]
    upto = np.zeros((total + 1, items.shape[1]), np.float32)
    for lo in range(0, total, 1024):
        by_block = np.take(index.vectors, term[np.where(inside[lo: lo + 1024], words[lo: lo + 1024], 0)], axis=0)
        by_block[~inside[lo: lo + 1024]] = 0
        by_block.sum(axis=1, out=upto[lo + 1: lo + 1 + len(by_block)])
    np.cumsum(upto, axis=0, out=upto)
    end_of = (first + blocks)[doc]
    items = items.astype(np.float32)
    # In pieces too small to be worth a thread each: threads of several workers on one machine wait for each other.
    pieces = np.zeros((-(-total // 128), 128, items.shape[1]), np.float32)
    window = pieces.reshape(-1, items.shape[1])[:total]
    for span in np.unique(spans):
        of = np.flatnonzero(spans == span)
        inner = max(0, total - int(span))
        np.subtract(upto[span: span + inner], upto[:inner], out=window[:inner])
        last = np.flatnonzero(np.arange(total) + span > end_of)  # windows that end with their document
        window[last] = upto[end_of[last]] - upto[last]
        least = cut * np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
        for lo in range(0, len(of), 32):
            close = np.matmul(pieces, items[of[lo: lo + 32]].T).reshape(len(pieces) * 128, -1)[:total]
            at, item = np.nonzero(close >= least[:, None])
            yield from zip(doc[at].tolist(), (at - first[doc[at]]).tolist(), of[lo + item].tolist(), strict=True)


def _candidates(hashed: np.ndarray, sizes: np.ndarray, lists: Lists, spans: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Document, first block and item of windows that hold enough of the item's listed words."""
    if not len(hashed) or not len(lists.hashes):
        return
    some = np.zeros(1 << 20, bool)
    some[(lists.hashes >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(some[(hashed >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(lists.hashes, hashed[at]), len(lists.hashes) - 1)
    hit = lists.hashes[k] == hashed[at]
    at, k = at[hit], k[hit]
    count = lists.first[k + 1] - lists.first[k]
    item = lists.items[np.repeat(lists.first[k] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    word, at = np.repeat(k, count), np.repeat(at, count)
    begin = np.cumsum(sizes) - sizes
    doc = np.searchsorted(np.cumsum(sizes), at, "right")
    block = (at - begin[doc]) // STEP
    # A word counts once in a block.
    item, doc, block, word = np.unique(np.stack([item, doc, block, word]), axis=1)
    if not len(item):
        return
    ahead = np.arange(len(item)) + lists.need[item] - 1
    inside = np.minimum(ahead, len(item) - 1)
    good = (ahead < len(item)) & (item[inside] == item) & (doc[inside] == doc) & (block[inside] - block <= spans[item] + 1)
    blocks = -(-sizes // STEP)
    seen: set[tuple[int, int, int]] = set()
    for i in np.flatnonzero(good).tolist():
        d, j = int(doc[i]), int(item[i])
        for b in range(max(0, int(block[inside[i]]) - int(spans[j])), min(int(blocks[d]) - 1, int(block[i]) + 1) + 1):
            if (d, b, j) not in seen:
                seen.add((d, b, j))
                yield d, b, j


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, item_id, similarity, lcs, n_words, answer_share, start of every document that holds an item.

    docs needs doc_id and text, benchmark item_id and text; other columns are not read. A row
    per row of docs and item found in it; start is the window's first word. Null and empty
    texts hold nothing; items that are null, have no id or under `least` words are in nothing.
    Equal items are found each under its own id. Rows are independent: null and repeated ids
    come back as they are. Whole texts are searched. Empty tables: no rows.
    """
    index = fit(docs, benchmark)
    out = None
    for items in items_of(benchmark, least):
        got = with_matches(docs, ["doc_id"], index, items).select(F.col("c0").alias("doc_id"), F.explode("matches").alias("m")).select(
            "doc_id", "m.*")
        out = got if out is None else out.union(got)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """The given columns of the rows of docs that hold no benchmark item. See contaminations()."""
    index = fit(docs, benchmark)
    for items in items_of(benchmark, least):
        docs = with_matches(docs, columns, index, items).where(F.size("matches") == 0).select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
    return docs


def op3_decontamination(spark, sf_dir):
    """Benchmark items in all documents."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
