"""Token ids in binary files, with keyed access through minimal perfect hashing.

A folder holds

* `ids-<shard>.bin`: raw token ids, little-endian, 2 bytes wide if the vocabulary allows and 4
  otherwise, of documents in ascending order of their key; each document ends with the end id;
* `index-<part>.mph`: for the keys of one part of a hash space, a minimal perfect hash function
  and one entry of fixed size per key: fingerprint, shard, offset and count of ids;
* `manifest/` and `index/`: one row per file (records, ids, bytes, SHA-256), written last by
  Spark's own commit.

A key is found in constant time: hash, part, a few bits of the hash function, one entry, one
range of a payload file. The fingerprint (64 bits, from another hash) tells absent keys.

The hash function is a cascade of bit fields. Each key falls on one bit of the first field; bits
that one key alone falls on are set, the other keys go on to the next field. A key's number is
the number of set bits before its own. A part whose keys are not apart after 64 fields is built
again with another seed.

Keys may repeat: the n-th document of a key (0 first, in file order) has the key (doc_id, n), so
that a key which a third of all rows share spreads over all parts and is read like any other.

Shards are ranges of (doc_id, a hash of the text) with about equal bytes of text; their bounds
come from a bounded sample of keys, drawn in proportion to bytes. Files are written under temporary
names and renamed; a task that runs again writes the same bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm.common import fresh_path, mix, slices, table, text_arg
from docmetrics.llm.token_counts import byte_letters

#: Id that ends each document.
END_ID = 1
#: Keys that are drawn per shard for the bounds, and the greatest number of shards.
DRAWN, MOST_SHARDS = 64, 65_536

MAGIC = b"DMPH0001"
ENTRY = np.dtype([("print", "<u8"), ("offset", "<u8"), ("shard", "<u4"), ("count", "<u4")])
#: Bits of a field per key that is left.
SPACE = 2.0
FIELDS = 64


# ------------------------------------------------------------------ hash functions


def key_hashes(doc_id: np.ndarray, is_null: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of (doc_id, copy); a null id is a key of its own."""
    with np.errstate(over="ignore"):
        base = np.where(is_null, np.uint64(0), doc_id.astype(np.int64).view(np.uint64))
        more = copy.astype(np.int64).view(np.uint64) * np.uint64(2) + is_null.astype(np.uint64)
        return tuple(mix(mix(base ^ np.uint64(a)) + mix(more ^ np.uint64(b)))
                     for a, b in ((0x243F6A8885A308D3, 0x13198A2E03707344), (0xA4093822299F31D0, 0x082EFA98EC4E6C89)))


def _place(h: np.ndarray, seed: int, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash function over 64-bit values: numbers 0 to n - 1, in any order."""

    def __init__(self, seed: int, n: int, sizes: list[int], words: np.ndarray) -> None:
        self.seed, self.n, self.sizes, self.words = seed, n, sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, h: np.ndarray) -> "PerfectHash":
        """Of distinct values; of values that repeat it fails."""
        for seed in range(16):
            left, sizes, fields = h, [], []
            while len(left) and len(sizes) < FIELDS:
                size = -(-max(64, int(len(left) * SPACE)) // 64) * 64
                at = _place(left, seed, len(sizes), size)
                hits = np.bincount(at.astype(np.int64), minlength=size)
                alone = hits == 1
                fields.append(np.packbits(alone, bitorder="little").view("<u8"))
                sizes.append(size)
                left = left[~alone[at.astype(np.int64)]]
            if not len(left):
                return cls(seed, len(h), sizes, np.concatenate(fields) if fields else np.zeros(0, "<u8"))
        raise ValueError("keys repeat")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of values; of a value that is not a key: any number, or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(h[left], self.seed, level, size).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return MAGIC + struct.pack("<QQQ", self.seed, self.n, len(self.sizes)) + np.array(self.sizes, "<u8").tobytes() + self.words.tobytes()

    @staticmethod
    def size_of(head: bytes) -> int:
        """Bytes of head and sizes, from the first 32 bytes."""
        if head[:8] != MAGIC:
            raise ValueError("not an index file")
        return 32 + 8 * struct.unpack("<Q", head[24:32])[0]

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["PerfectHash", int]:
        """The function, and where it ends."""
        top = cls.size_of(raw)
        seed, n, _ = struct.unpack("<QQQ", raw[8:32])
        sizes = np.frombuffer(raw[32:top], "<u8").astype(int).tolist()
        end = top + sum(sizes) // 8
        return cls(seed, n, sizes, np.frombuffer(raw[top:end], "<u8")), end


# ------------------------------------------------------------------ files


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, blocks: Iterable[bytes]) -> tuple[int, str]:
    """A file under a temporary name, then renamed; its bytes and SHA-256."""
    at, path = _opened(folder)
    at.create_dir(path, recursive=True)
    temp, sha, n = f"{path}/_temporary-{uuid.uuid4().hex}-{name}", hashlib.sha256(), 0
    with at.open_output_stream(temp, compression=None) as out:
        for block in blocks:
            out.write(block)
            sha.update(block)
            n += len(block)
    if at.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        at.delete_file(f"{path}/{name}")  # by an earlier run of this task: the same bytes
    at.move(temp, f"{path}/{name}")
    return n, sha.hexdigest()


def shard_file(shard: int) -> str:
    return f"ids-{shard:06d}.bin"


def index_file(part: int) -> str:
    return f"index-{part:06d}.mph"


class Remembered(dict):
    """Values of a function, remembered up to a bound; when it is full, those not asked for since the last time go."""

    def __init__(self, of, most: int, longest: int = 64) -> None:
        super().__init__()
        self.of, self.most, self.longest, self.old = of, most, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


# The pattern of the file, for lower-case letters of ASCII and the two blocks of Latin
# letters after it, with the letters first; and texts of those letters and ASCII, which no normalization changes.
PARTS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
ASCII_PARTS = re.compile("[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z0-9]+")
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")


class Encoder:
    """Ids of whole texts as the library gives them.

    A text of plain letters and marks is cut as the pattern cuts it, and the library's model
    merges each part. In other texts this is done for the pieces between white space of ASCII,
    across which normalizer and pattern never join characters; a piece with other characters, or
    with what may be a special token, goes through the whole library. Parts are remembered up to a bound.
    """

    def __init__(self, path: str, width: int, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.kind = f"<u{width}"
        self.raw = [i.to_bytes(width, "little") for i in range(vocabulary_size(path))]
        self.byte_letters = {i: c for i, c in enumerate(byte_letters())}
        self.parts = Remembered(self.of_part, most)

    def of_part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_letters)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(letters)])

    def of_text(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, (ASCII_PARTS if text.isascii() else PARTS).findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if PLAIN.fullmatch(whole) and "<|" not in whole:
            return self.of_text(whole)
        return b"".join([self.of_text(x) for x in re.split("[\t\n\r ]+", whole)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(path: str, width: int) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return 1 + max([*data["model"]["vocab"].values(), *(t["id"] for t in data.get("added_tokens", []))])


# ------------------------------------------------------------------ writer


def _tie() -> Column:
    """Order among documents of one id: a hash of the text, and a count that tells equal rows apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(-65536)).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(65535)))


def shard_bounds(rows: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """Lower bounds of all shards but the first, as (id is null, id, tie).

    From keys drawn in proportion to their bytes, DRAWN per shard in the mean.
    """
    size = F.octet_length("text").cast("long") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    shards = min(MOST_SHARDS, -(-total // shard_bytes))
    if shards < 2:
        return []
    step = total / (DRAWN * shards)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "tie", F.lit("drawn")), 11) / F.lit(float(1 << 53))
    drawn = rows.select("doc_id", "tie", size.alias("size")).where(chance < F.col("size") / F.lit(step)).collect()
    keys = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["tie"], max(r["size"], step)) for r in drawn)
    upto = np.cumsum([k[3] for k in keys])
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards) if keys else []
    return sorted({keys[i][:3] for i in cut})


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = 32 << 20,
                 part_keys: int = 1 << 18) -> DataFrame:
    """Write the ids of all texts into folder, with their index; returns the manifest of shards.

    docs needs doc_id and text; other columns are not read. A null or empty text has the end id
    alone. Null ids come last and have the key (null, n). Rows that repeat an id are documents of
    their own: they stand in order of a hash of their text, as copies 0, 1, ... Empty table: no
    files, empty manifests. Manifest: shard, file, docs, tokens, start (ids before the shard),
    width, bytes, sha256.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_arg()).withColumn("tie", _tie())
    bounds = shard_bounds(rows, shard_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, width)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                ids, ties = part.column("doc_id").to_pylist(), part.column("tie").to_pylist()
                shards = [bisect.bisect_right(bounds, (i is None, i or 0, t)) for i, t in zip(ids, ties, strict=True)]
                data = [encoder(x) + end for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), part.column("doc_id"), part.column("tie"), pa.array(data, pa.binary())],
                                                 names=["shard", "doc_id", "tie", "ids"])

    names = ["shard", "doc_id", "copy", "start", "count", "bytes", "sha256"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, then one for the file: its ids, documents, bytes and digest."""
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        shard = batch.column("shard")[0].as_py()
        ready: list[pa.RecordBatch] = []
        last, n, at, docs_n = object(), 0, 0, 0

        def blocks() -> Iterator[bytes]:
            nonlocal batch, last, n, at, docs_n
            while batch is not None:
                ids, data = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
                copies, starts, counts = [], [], []
                for i, x in zip(ids, data, strict=True):
                    n, last = (n + 1, i) if i == last else (0, i)
                    copies.append(n)
                    starts.append(at)
                    counts.append(len(x) // width)
                    at += counts[-1]
                    yield x
                docs_n += len(ids)
                cols = [[shard] * len(ids), ids, copies, starts, counts, [None] * len(ids), [None] * len(ids)]
                ready.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names))
                batch = next((b for b in batches if b.num_rows), None)

        size, sha = _write(folder, shard_file(shard), blocks())
        yield from ready  # 40 bytes a document
        cols = [[shard], [None], [docs_n], [0], [at], [size], [sha]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
    written = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_last(), "tie").mapInArrow(
        write, "shard int, doc_id long, copy long, start long, count long, bytes long, sha256 string")
    written.write.mode("overwrite").parquet(f"{folder}/directory")
    directory = spark.read.schema(written.schema).parquet(f"{folder}/directory")

    entries = directory.where("sha256 IS NULL")
    ends = {r["shard"]: r for r in entries.groupBy("shard").agg(
        F.min_by(F.struct("doc_id"), "start").alias("first"), F.max_by(F.struct("doc_id", "copy"), "start").alias("last"),
        F.count("*").alias("docs")).collect()}  # MOST_SHARDS rows at most
    files = {r["shard"]: r for r in directory.where("sha256 IS NOT NULL").collect()}
    manifest, base, carried, before, start = [], {}, 0, object(), 0
    for s in sorted(files):
        first, (last, n), docs_n = ends[s]["first"][0], ends[s]["last"], ends[s]["docs"]
        base[s] = carried if first == before else 0
        carried, before = (base[s] if n + 1 == docs_n else 0) + n + 1, last
        f = files[s]
        manifest.append((s, shard_file(s), f["copy"], f["count"], start, width, f["bytes"], f["sha256"]))
        start += f["count"]
    keys = sum(r["docs"] for r in ends.values())
    parts = max(1, -(-keys // part_keys))
    heads = {s: (ends[s]["first"][0], base[s]) for s in base if base[s]}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shard = batch.column("doc_id"), batch.column("shard").to_numpy()
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            value, copy = pc.fill_null(ids, 0).to_numpy(), batch.column("copy").to_numpy().copy()
            for s in set(np.unique(shard).tolist()) & set(heads):
                first, n = heads[s]
                copy[(shard == s) & (null if first is None else ~null & (value == first))] += n
            h, mark = key_hashes(value, null, copy)
            yield pa.RecordBatch.from_arrays(
                [pa.array((h % np.uint64(parts)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(mark.view(np.int64)), batch.column("shard"),
                 batch.column("start"), batch.column("count")], names=["part", "h", "mark", "shard", "start", "count"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for the keys of one part, part_keys of them in the mean."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        col = lambda c: rows.column(c).to_numpy()
        h = col("h").view(np.uint64)
        function = PerfectHash.build(h)
        out = np.zeros(len(h), ENTRY)
        at = function.find(h)
        for name, c in (("print", col("mark").view(np.uint64)), ("offset", col("start")), ("shard", col("shard")), ("count", col("count"))):
            out[name][at] = c
        part = int(col("part")[0])
        size, sha = _write(folder, index_file(part), [function.to_bytes(), out.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
            (part, pa.int32()), (index_file(part), pa.string()), (len(h), pa.int64()), (size, pa.int64()), (sha, pa.string()))],
            names=["part", "file", "keys", "bytes", "sha256"])

    index = entries.mapInArrow(keyed, "part int, h long, mark long, shard int, start long, count long").repartitionById(
        parts, F.col("part")).mapInArrow(build, "part int, file string, keys long, bytes long, sha256 string")
    index.withColumn("parts", F.lit(parts)).write.mode("overwrite").parquet(f"{folder}/index")
    schema = "shard int, file string, docs long, tokens long, start long, width int, bytes long, sha256 string"
    spark.createDataFrame(manifest, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


# ------------------------------------------------------------------ readers


def _found(raw: bytes, h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the index file holds, and the entries of those."""
    function, end = PerfectHash.from_bytes(raw)
    entries = np.frombuffer(raw, ENTRY, function.n, end)
    at = function.find(h)
    ok = at >= 0
    ok[ok] = entries["print"][at[ok]] == mark[ok]
    return ok, entries[at[ok]]


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Where the documents of keys (doc_id, copy) are: doc_id, copy, shard, start, count.

    Keys that the folder does not hold have no row; keys asked for twice have two. A null copy counts as 0.
    """
    parts = (spark.read.parquet(f"{folder}/index").agg(F.max("parts")).first()[0]) or 1
    rows = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("copy"), F.lit(0)).cast("long").alias("copy"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            h, mark = key_hashes(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), batch.column("copy").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(parts)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(mark.view(np.int64)),
                                              ids, batch.column("copy")], names=["part", "h", "mark", "doc_id", "copy"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if raw is None:
                at, path = _opened(folder)
                name = f"{path}/{index_file(batch.column('part')[0].as_py())}"
                if at.get_file_info(name).type == fs.FileType.NotFound:
                    return
                with at.open_input_stream(name, compression=None) as f:
                    raw = f.read()
            ok, e = _found(raw, batch.column("h").to_numpy().view(np.uint64), batch.column("mark").to_numpy().view(np.uint64))
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(ok), batch.column("copy").filter(ok), pa.array(e["shard"].astype(np.int32)),
                 pa.array(e["offset"].astype(np.int64)), pa.array(e["count"].astype(np.int64))], names=["doc_id", "copy", "shard", "start", "count"])

    return rows.mapInArrow(hashed, "part int, h long, mark long, doc_id long, copy long").repartitionById(parts, F.col("part")).mapInArrow(
        find, "doc_id long, copy long, shard int, start long, count long")


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame, gap: int = 1 << 16, span: int = 4 << 20) -> DataFrame:
    """The documents of keys (doc_id, copy), read from the payload files that the index names.

    doc_id, copy, start (ids of all documents before it in the folder), n_tokens, ids (binary,
    little-endian, 4 bytes wide). Ranges that lie within `gap` bytes of each other are read at once, up to `span` bytes.
    """
    manifest = {r["shard"]: r for r in spark.read.parquet(f"{folder}/manifest").collect()}  # MOST_SHARDS rows at most
    starts = {s: r["start"] for s, r in manifest.items()}
    width = max((r["width"] for r in manifest.values()), default=4)

    def ranges(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
        lo = 0
        for i in range(1, len(begin) + 1):
            if i == len(begin) or begin[i] - end[i - 1] > gap or end[i] - begin[lo] > span:
                yield lo, i
                lo = i

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = _opened(folder)
        now, f = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            begin = batch.column("start").to_numpy() * width
            end = begin + batch.column("count").to_numpy() * width
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != now:
                    now = int(shards[a])
                    f = at.open_input_file(f"{path}/{shard_file(now)}")
                for lo, hi in ranges(begin[a:b], end[a:b]):
                    lo, hi = lo + a, hi + a
                    f.seek(int(begin[lo]))
                    top = int(end[lo:hi].max())
                    raw = f.read(top - int(begin[lo]))
                    if len(raw) < top - begin[lo]:
                        raise ValueError(f"{shard_file(now)} is shorter than its index says")
                    data = [np.frombuffer(raw, f"<u{width}", int(e - s) // width, int(s - begin[lo])).astype("<u4").tobytes()
                            for s, e in zip(begin[lo:hi], end[lo:hi], strict=True)]
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("copy"), pc.add(part.column("start"), pa.scalar(starts[now], pa.int64())), part.column("count"),
                         pa.array(data, pa.binary())], names=["doc_id", "copy", "start", "n_tokens", "ids"])

    found = look_up(spark, folder, keys).repartitionById(max(starts, default=0) + 1, F.col("shard")).sortWithinPartitions("shard", "start")
    return found.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids binary")


class TokenReader:
    """Keyed access without Spark: a few reads per key, whatever the size of the folder."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        self.at, self.path = _opened(folder)
        rows = pq.read_table(f"{self.path}/manifest", filesystem=self.at, columns=["shard", "width"]).to_pylist()
        self.width = rows[0]["width"] if rows else 4
        index = pq.read_table(f"{self.path}/index", filesystem=self.at, columns=["part", "parts"]).to_pylist()
        self.parts, self.there = max((r["parts"] for r in index), default=1), {r["part"] for r in index}
        self.open: dict[int, tuple] = {}

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """Ids of a document; None if the folder does not hold it."""
        h, mark = key_hashes(np.array([doc_id or 0], np.int64), np.array([doc_id is None]), np.array([copy], np.int64))
        part = int(h[0] % np.uint64(self.parts))
        if part not in self.there:
            return None
        if part not in self.open:
            f = self.at.open_input_file(f"{self.path}/{index_file(part)}")
            top = PerfectHash.size_of(head := f.read(32))
            sizes = f.read(top - 32)
            words = f.read(int(np.frombuffer(sizes, "<u8").sum()) // 8)
            self.open[part] = (f, *PerfectHash.from_bytes(head + sizes + words))
        f, function, end = self.open[part]
        at = int(function.find(h)[0])
        if at < 0:
            return None
        f.seek(end + at * ENTRY.itemsize)
        entry = np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]
        if entry["print"] != mark[0]:
            return None
        with self.at.open_input_file(f"{self.path}/{shard_file(int(entry['shard']))}") as ids:
            ids.seek(int(entry["offset"]) * self.width)
            return np.frombuffer(ids.read(int(entry["count"]) * self.width), f"<u{self.width}")


def keys_of(docs: DataFrame, run: int = 4096) -> DataFrame:
    """The keys (doc_id, copy) of documents: ids that repeat have copies 0, 1, ...

    Counts are made per id before anything moves; runs of copies are dealt out before they are unfolded.
    """
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    runs = counts.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))).alias("lo"))
    return runs.select("doc_id", F.explode(F.sequence("lo", F.least(F.col("lo") + (run - 1), F.col("n") - 1))).alias("copy"))


def op13_token_files(spark, sf_dir):
    """Write the ids of all documents and read them back by key."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = fresh_path(spark, "tokens")
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder, keys_of(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
