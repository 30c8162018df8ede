"""Rows that a small set of keys may touch, told from the rest without moving either.

The keys are marked in a bitmap of fixed size, which goes along with the plan as a literal: a
row whose bit is not set is certainly not among the keys and needs no shuffle. Of other rows, one in
BITS / keys is there by chance; the join that follows decides. With many more keys than bits
every row takes the join, as it would without the bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB
SLOT = 1 << 15  # positions of one bitmap of bitmap_construct_agg


def _place(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def key_bitmap(keys: DataFrame, names: list[str]) -> bytes:
    """BITS / 8 bytes, whatever the number of keys."""
    place = keys.select(_place([F.col(n) for n in names]).alias("place"))
    rows = place.groupBy(F.floor(F.col("place") / SLOT).cast("int").alias("slot")).agg(
        F.bitmap_construct_agg(F.col("place") % SLOT).alias("bits")).collect()  # BITS / SLOT rows at most
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["slot"] * SLOT // 8: (r["slot"] + 1) * SLOT // 8] = r["bits"]
    return bytes(out)


def may_hold(bitmap: bytes, columns: list[Column]) -> Column:
    """False if the values of the columns are surely not among the keys."""
    place = _place(columns)
    byte = F.substring(F.lit(bitmap), F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    bits = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("getbit", bits, (place % 8).cast("int")) == 1


def split_by_keys(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the keys, rows that are not). Keys and rows share the named columns and their types."""
    hit = may_hold(key_bitmap(keys, names), [F.col(n) for n in names])
    return rows.where(hit), rows.where(~hit)
