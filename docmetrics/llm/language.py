"""Language identification by compression with per-language dictionaries.

A text is cut into pieces of a fixed size (all of it is read) and each piece is compressed with
the raw-content dictionary of each language. The language whose dictionary leaves the fewest
bytes in all is chosen; if the runner-up is nearly as small, the row is marked as rejected.
Letters are folded to lower case and everything else to spaces first, so that shouting,
symbols and numbers do not weigh in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import learnable, slices, table, text_arg

PIECE = 4096
LEVEL = 6
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def dictionaries(docs: DataFrame, per_language: int = 160, piece: int = 600) -> dict[str, bytes]:
    """A raw-content dictionary for each language from a bounded sample of labelled rows.

    At most per_language rows of a language, and piece bytes of each, are taken: the bound on
    what the driver holds is languages * per_language * piece.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(learnable(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    h = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_language / n))).otherwise(share)
    picked = rows.select("lang", "doc_id", h.alias("h"), "text").where(F.col("h") < share * (1 << 30))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.select("lang", "h", F.substring("text", 1, 2 * piece).alias("text")).toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], folded(r["text"].encode())))
    out = {}
    for lang, got in sorted(found.items()):
        got.sort()
        texts = [t[:piece] for _, t in got[:per_language]]
        out[lang] = b" ".join(x for x in texts if x) or b" " * 8
    return out


def identify(docs: DataFrame, dicts: dict[str, bytes], narrow: float = 0.005) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    docs needs doc_id and text; other columns are not read. lang_pred is the language of the
    smallest compressed size (ties: the first by code point), or und for texts that are null
    or have no letter, and where no language was learned. score is 1 - 2 ** -(bytes between
    the two smallest sizes), 0 for und. rejected marks und, and rows whose margin is under
    `narrow` of the smallest size. Rows are independent, so repeated ids are too. Texts are
    read whole. Empty table: no rows.
    """
    names = sorted(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dicts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False))
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                preds, scores, rejected = [], [], []
                for raw in part.column("text").to_pylist():
                    if not names or not has_letter(raw.decode("utf-8", "replace")):
                        preds.append("und")
                        scores.append(0.0)
                        rejected.append(True)
                        continue
                    text = folded(raw) or raw
                    pieces = [text[i: i + PIECE] for i in range(0, len(text), PIECE)]
                    sizes = np.array([sum(len(p.compress(x)) for x in pieces) for p in packers])
                    best = int(sizes.argmin())
                    margin = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else len(text)
                    preds.append(names[best])
                    scores.append(1.0 - 2.0 ** -min(margin, 50))
                    rejected.append(bool(margin < narrow * sizes[best]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", text_arg()).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language(spark, sf_dir):
    """Language of all documents, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, dictionaries(docs))
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
