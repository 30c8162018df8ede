"""What the operators share: the words of a text, stored steps, the learning split."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what separates words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a folder of its own; any other session fails,
    since its executors could not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    global _OWN
    if _OWN is None:
        import tempfile

        _OWN = tempfile.mkdtemp(prefix="docmetrics-llm-")
    return _OWN


_OWN: str | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: they outlive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_arg(name: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def with_text(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """The given columns as c0, c1, ... for a step of Python, and the name of the one with the text.

    A text that is among the columns goes along once; otherwise it is added as utf8, the last.
    """
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    if "text" in columns and ("text", "string") in docs.dtypes:
        return docs.select(*carried), f"c{columns.index('text')}"
    return docs.select(*carried, text_arg().alias("utf8")), "utf8"


def utf8_of(texts: pa.Array) -> list[bytes]:
    """Texts of an Arrow column (strings or bytes) as UTF-8; null counts as empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return ~F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, budget: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about budget bytes of the binary column each."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n + 64
    if start < batch.num_rows:
        yield start, batch.num_rows


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_PLACE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        inverse = pow(_PLACE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _TABLES[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
                          for x in (_PLACE, inverse)]
    return _TABLES[0], _TABLES[1]


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
#: A number for each byte; the second counts A-Z as a-z.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
LOWERED = BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


def word_hashes(texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and how many words each text has.

    letters: a number for each byte; bytes with 0 don't count. A word's hash is a polynomial of its
    letters, taken from running sums over all texts at once, so that no word becomes an object.
    """
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    begin, stop = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    letter = letters[raw]
    with np.errstate(over="ignore"):
        place = np.concatenate([[0], np.cumsum(letter != 0)])  # letters before each byte
        up, down = powers(len(raw) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[place[:-1]])])
        hashed = mix((total[stop] - total[begin]) * down[place[begin]])
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashed, np.diff(np.searchsorted(begin, edge))
