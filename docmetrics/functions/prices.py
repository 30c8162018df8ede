"""Token prices and costs.

The price list is configuration: a handful of rows, given as Python data and compiled
into column expressions, so pricing a usage table needs no join and no shuffle. Money is
decimal throughout; a list price in USD per million tokens is the price of one token in
millionths of a dollar, so a cost in whole millionths is exact before it is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Price(NamedTuple):
    model: str
    input: str
    output: str


# USD per million tokens, in list order (the order decides name matches).
PRICE_LIST = [
    Price("gpt-4.1", "2.00", "8.00"),
    Price("gpt-4.1-mini", "0.40", "1.60"),
    Price("gpt-4.1-nano", "0.10", "0.40"),
    Price("gpt-4.1-nano-2025-04-14", "0.10", "0.40"),
    Price("gpt-4o", "2.50", "10.00"),
    Price("gpt-4o-mini", "0.15", "0.60"),
    Price("o3", "2.00", "8.00"),
    Price("o4-mini", "1.10", "4.40"),
    Price("default", "1.00", "3.00"),
]
DEFAULT = "default"
MAX_PRICES = 500


def price_table(spark: SparkSession, prices: Sequence[Price] = PRICE_LIST) -> DataFrame:
    rows = [(p.model, float(p.input), float(p.output), i + 1) for i, p in enumerate(prices)]
    return spark.createDataFrame(
        rows, "model string, input_per_million double, output_per_million double, list_rank int"
    )


def _checked(prices: Sequence[Price]) -> Sequence[Price]:
    if len(prices) > MAX_PRICES:
        raise ValueError(f"a price list of {len(prices)} rows is joined, not compiled: see usage.price_requests_by_table")
    if DEFAULT not in [p.model for p in prices]:
        raise ValueError("the price list has no default row")
    return prices


def price_key(
    model: Column, prices: Sequence[Price] = PRICE_LIST, match: str = "first"
) -> Column:
    """The price row a model name uses.

    An equal name wins. Otherwise, with `first`, the first list entry where either name
    contains the other, with `longest` the longest such entry, with `exact` none; then
    the default row.
    """
    known = _checked(prices)
    low = F.lower(model)
    exact = F.when(low.isin([p.model for p in known]), low)
    if match == "exact":
        return F.coalesce(exact, F.lit(DEFAULT))
    ordered = list(known)
    if match == "longest":
        ordered.sort(key=lambda p: -len(p.model))
    elif match != "first":
        raise ValueError(f"unknown match {match!r}")
    similar = F.lit(None).cast("string")
    for p in reversed(ordered):
        hit = F.contains(low, F.lit(p.model)) | F.contains(F.lit(p.model), low)
        similar = F.when(hit, F.lit(p.model)).otherwise(similar)
    return F.coalesce(exact, similar, F.lit(DEFAULT))


def _list_price(key: Column, side: str, prices: Sequence[Price]) -> Column:
    pairs = [(F.lit(p.model), F.lit(Decimal(getattr(p, side))).cast("decimal(10,4)")) for p in prices]
    return F.element_at(F.create_map(*[x for pair in pairs for x in pair]), key)


def token_cost(
    key: Column, prompt: Column, completion: Column, prices: Sequence[Price] = PRICE_LIST
) -> Column:
    """USD to 6 digits as decimal(20,6)."""
    micro = prompt.cast("decimal(15,0)") * _list_price(key, "input", prices) + completion.cast(
        "decimal(15,0)"
    ) * _list_price(key, "output", prices)
    return in_dollars(micro)


def in_dollars(micro: Column) -> Column:
    """Exact millionths of a dollar as dollars, rounded half up to whole millionths."""
    return (F.round(micro, 0).cast("decimal(26,0)") / F.lit(Decimal(1000000))).cast("decimal(20,6)")


def request_cost(
    model: Column,
    prompt: Column,
    completion: Column,
    prices: Sequence[Price] = PRICE_LIST,
    match: str = "first",
) -> Column:
    return token_cost(price_key(model, prices, match), prompt, completion, prices)


def estimate_cost(model: Column, tokens: Column, prices: Sequence[Price] = PRICE_LIST) -> Column:
    """Cost of a token total taken as 70% input and 30% output; no similar-name match."""
    return token_cost(
        price_key(model, prices, "exact"),
        F.floor(tokens.cast("double") * F.lit(0.7)),
        F.floor(tokens.cast("double") * F.lit(0.3)),
        prices,
    )


def price_label(model: Column, prices: Sequence[Price] = PRICE_LIST) -> Column:
    """Price per token as `$input/$output`, five digits each."""
    labels = [
        x
        for p in prices
        for x in (F.lit(p.model), F.lit(f"${float(p.input) / 1e6:.5f}/${float(p.output) / 1e6:.5f}"))
    ]
    return F.element_at(F.create_map(*labels), price_key(model, prices, "exact"))


def format_cost(cost: Column) -> Column:
    """`$` text, with more digits the smaller the cost."""
    value = cost.cast("double")
    return (
        F.when(value < 0.001, F.format_string("$%.6f", value))
        .when(value < 0.01, F.format_string("$%.5f", value))
        .when(value < 1.0, F.format_string("$%.4f", value))
        .otherwise(F.format_string("$%.2f", value))
    )
