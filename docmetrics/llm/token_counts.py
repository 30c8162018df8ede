"""Token counts of a byte-level BPE tokenizer by finite-state transduction.

Two deterministic transducers are compiled from the tokenizer file.

The outer one reads characters by class (letter, number, space, other white space, other) and
emits a mark where a pre-token begins, as the pattern of the file asks. It is definite: after
any character its state is that character's class, with two characters looked ahead, so the
state map of every chunk is constant and the prefix scan over chunk maps is a shift by one
place. Marks, pre-token keys (a scan of modular sums) and counts per text (a scan of the
emissions) are therefore computed for all characters of many texts at once.

The inner one reads pre-tokens. Its arcs carry the number of tokens that the pre-token's bytes
emit. Arcs of pre-tokens that are one token come from the vocabulary; the others are made
when first read, by merging the bytes in rank order with a heap, and are remembered up to a
bound. It returns to its start state after each pre-token, so counts of chunks add up.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import mix, powers, slices, table, text_arg

LETTER, NUMBER, SPACE, BLANK, OTHER, END = range(6)

# The endings that are pre-tokens of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    # White space in Unicode.
    for lo, hi in ((9, 13), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo: hi + 1] = BLANK
    out[32] = SPACE
    return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Transducer:
    """Compiled from a byte-level BPE file; counts tokens of whole texts."""

    def __init__(self, path: str, most_arcs: int = 600_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level files without normalizer and prefix space are compiled")
        self.classes = char_classes()
        self.letters = byte_letters()
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.arcs: dict[int, int] = {}
        self.most_arcs = most_arcs
        self.scatter = mix(np.arange(1, 0x110001, dtype=np.uint64))

    def merged(self, token: str) -> int:
        """Tokens of one pre-token: adjacent parts join in rank order, leftmost first."""
        rank = self.rank
        parts = [self.letters[b] for b in token.encode("utf-8", "surrogatepass")]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            alive -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (p := before[i]) >= 0 and (r := rank.get((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return alive

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks where pre-tokens begin. first marks the first character of each text."""
        n = len(cp)
        cls = np.append(self.classes[cp], END)
        ends = np.append(first[1:], True)  # the next character belongs to another text
        now, nxt = cls[:-1], np.where(ends, END, cls[1:])
        prev = np.where(first, END, np.append(np.uint8(END), cls[:-2]))
        blank = (now == SPACE) | (now == BLANK)
        prev_blank = (prev == SPACE) | (prev == BLANK)
        next_blank = (nxt == SPACE) | (nxt == BLANK)
        mark = np.zeros(n, bool)
        # White space: the run is one piece but for its last character before a visible one.
        mark |= blank & ~prev_blank
        mark |= blank & ~next_blank & (nxt != END)
        # A visible character begins a piece where the class changes; a space before it joins it.
        mark |= ~blank & (prev != now) & (prev != SPACE)
        # An apostrophe that begins a piece takes one of the endings.
        quote = np.flatnonzero((cp == 39) & mark & (nxt == LETTER))
        if len(quote):
            left = np.flatnonzero(np.append(first, True))  # first of each text, and the end
            stop = left[np.searchsorted(left, quote, "right")]
            text = cp
            for q, e in zip(quote.tolist(), stop.tolist(), strict=True):
                tail = "".join(map(chr, text[q + 1: min(q + 3, e)].tolist()))
                for ending in ENDINGS:
                    if tail.startswith(ending):
                        mark[q + 1] = False
                        at = q + 1 + len(ending)
                        if at < e:
                            mark[at] = True
                        break
        return mark

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        # Special strings in a text are one token and cut it.
        extra = [0] * len(texts)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            cut = [t]
            for s in self.specials:
                if s in t:
                    split = [x.split(s) for x in cut]
                    extra[i] += sum(len(x) - 1 for x in split)
                    cut = [y for x in split for y in x]
            for c in cut:
                if c:
                    pieces.append(c)
                    owner.append(i)
        out = np.array(extra, np.int64)
        if pieces:
            joined = "".join(pieces)
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.zeros(len(cp), bool)
            at = np.cumsum([0, *map(len, pieces)])
            first[at[:-1]] = True
            begin = np.flatnonzero(self.starts(cp, first))
            emitted = np.concatenate([[0], np.cumsum(self._emitted(joined, cp, begin))])
            cut = np.searchsorted(begin, at)
            np.add.at(out, owner, emitted[cut[1:]] - emitted[cut[:-1]])
        return out.tolist()

    def _emitted(self, text: str, cp: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token. Equal pre-tokens get equal 64-bit keys by a scan of sums."""
        with np.errstate(over="ignore"):
            n = len(cp)
            up, down = powers(n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.scatter[cp] * up[:n])])
            stop = np.append(begin[1:], n)
            keys = mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
        uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.arcs) > self.most_arcs:
            self.arcs.clear()
        counts = np.empty(len(uniq), np.int64)
        arcs = self.arcs
        for i, (key, w) in enumerate(zip(uniq.tolist(), where.tolist(), strict=True)):
            got = arcs.get(key)
            if got is None:
                got = arcs[key] = self.merged(text[begin[w]: stop[w]])
            counts[i] = got
        return counts[back]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    docs needs doc_id and text; other columns are not read. tokenizer is the path of a
    byte-level BPE file, the same on every machine. Null and empty texts have 0 bytes and 0
    tokens. Rows are independent: a null or repeated doc_id comes back as it is. Texts of
    any length are counted whole. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = None
        for batch in batches:
            transducer = transducer or Transducer(tokenizer)
            for lo, hi in slices(batch, "text", 1_500_000):
                part = batch.slice(lo, hi - lo)
                raw = part.column("text").to_pylist()
                n = pa.array(transducer.count([t.decode("utf-8", "replace") for t in raw]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), n],
                    names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", text_arg()).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    """Tokens of all documents by the 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
