"""Whole event logs to columns: layouts of indexed and plain fields, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from calibra.sources.readers import word, word_address, word_number


@dataclass(frozen=True)
class Field:
    """``kind``: address, bytes32, bool, uint256 or int256 (decimal text, 78 digits fit no decimal), amount (decimal of 38 digits)."""

    name: str
    kind: str
    indexed: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    topic0: str | None
    fields: tuple[Field, ...]


# The layouts of public contracts' events, and the topic of the one that is known by it.
ORDER_FILLED = Layout(
    "OrderFilled",
    "0xd0a08e8c493f9c94f29311604c9de1b4e8c8d4c06bd0c789af57f2d65bfec0f6",
    (
        Field("order_hash", "bytes32", True), Field("maker", "address", True), Field("taker", "address", True), Field("maker_asset_id", "uint256"), Field("taker_asset_id", "uint256"),
        Field("maker_amount", "amount"), Field("taker_amount", "amount"), Field("fee", "amount"),
    ),
)
FPMM_BUY = Layout("FPMMBuy", None, (Field("trader", "address", True), Field("amount", "amount"), Field("fee_amount", "amount"), Field("outcome_index", "amount", True), Field("outcome_tokens", "amount")))
FPMM_SELL = Layout("FPMMSell", None, (Field("trader", "address", True), Field("amount", "amount"), Field("fee_amount", "amount"), Field("outcome_index", "amount", True), Field("outcome_tokens", "amount")))


@F.pandas_udf(StringType())
def unsigned(words: pd.Series) -> pd.Series:
    return words.map(lambda b: None if b is None else str(int.from_bytes(b, "big")))


@F.pandas_udf(StringType())
def signed(words: pd.Series) -> pd.Series:
    return words.map(lambda b: None if b is None else str(int.from_bytes(b, "big", signed=True)))


def value(data: str, k: int, kind: str) -> Column:
    """Word k of the binary column ``data`` as a value; null where it is no value of the kind."""
    raw, text = F.substring(data, 32 * k + 1, 32), word(data, k)
    if kind == "address":
        return F.when(F.substring(text, 1, 24) == "0" * 24, word_address(data, k))
    if kind == "bytes32":
        return F.concat(F.lit("0x"), F.lower(text))
    if kind == "bool":
        return F.when(text == "0" * 64, False).when(text == "0" * 63 + "1", True)
    if kind == "amount":
        return word_number(data, k)
    if kind in ("uint256", "int256"):
        return (unsigned if kind == "uint256" else signed)(raw)
    raise ValueError(f"no such kind: {kind}")


def decode(logs: DataFrame, layout: Layout, topics: str = "topics", data: str = "data") -> DataFrame:
    """logs (topics array<string>, data binary, ...) of the layout's event with a column for each field.

    Logs with another first topic aren't of the event. One whose number of topics or bytes isn't the layout's, or whose
    topics are no words, is malformed: all its fields are null. Numbers past their column are null by themselves.
    """
    indexed, plain = [f for f in layout.fields if f.indexed], [f for f in layout.fields if not f.indexed]
    own = logs if layout.topic0 is None else logs.where(F.lower(F.get(topics, F.lit(0))) == layout.topic0)
    packed = F.unhex(F.concat(F.lit(""), *[F.regexp_extract(F.lower(F.get(topics, F.lit(k + 1))), "^0x([0-9a-f]{64})$", 1) for k in range(len(indexed))]))
    sound = (F.size(topics) == len(indexed) + 1) & (F.length(data) == 32 * len(plain)) & (F.length("__topics") == 32 * len(indexed))
    ready = own.withColumn("__topics", packed).withColumn("__sound", F.coalesce(sound, F.lit(False)))
    ready = ready.withColumns({"__topics": F.when(F.col("__sound"), F.col("__topics")), "__data": F.when(F.col("__sound"), F.col(data))})
    places = {f.name: ("__topics", indexed.index(f)) if f.indexed else ("__data", plain.index(f)) for f in layout.fields}
    out = ready.withColumns({f.name: value(*places[f.name], f.kind) for f in layout.fields})
    return out.drop("__topics", "__data", "__sound")
