"""Page lines: the common form of everything that is written as text.

A page of a large project is far too long for one row, so a page is a table of lines with
a sort key: project, page_kind, page_key, section, k1, k2, line_no, text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """Lines a row adds to one section, placed by k1 and k2; a null text drops out."""

    section: int
    texts: Sequence[Column | str]
    k1: Column | None = None
    k2: Column | None = None
    when: Column | None = None


def emit(df: DataFrame, kind: str, *parts: Part, key: str = "") -> DataFrame:
    """All parts of a page that come from the same rows, in one pass over them."""

    def block(p: Part) -> Column:
        texts = [F.lit(t) if isinstance(t, str) else t for t in p.texts]
        made = F.struct(
            F.lit(p.section).alias("section"),
            (F.lit("") if p.k1 is None else p.k1).cast("string").alias("k1"),
            (F.lit(0) if p.k2 is None else p.k2).cast("bigint").alias("k2"),
            F.array_compact(F.array(*texts)).alias("texts"),
        )
        return made if p.when is None else F.when(p.when, made)

    blocks = df.select("project", F.explode(F.array_compact(F.array(*[block(p) for p in parts]))).alias("b"))
    return blocks.select(
        "project", F.lit(kind).alias("page_kind"), F.lit(key).alias("page_key"),
        "b.section", "b.k1", "b.k2", F.posexplode("b.texts").alias("line_no", "text"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
