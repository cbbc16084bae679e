"""Merging what files declare into one table of symbols, and looking symbols up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_longest(declared: DataFrame, key: list[str], length: str, tie: str) -> DataFrame:
    """Of the declarations of one name the longest, ties by the least ``tie``: one aggregation with partial sums."""
    rest = [c for c in declared.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(length), -F.col(tie) if declared.schema[tie].dataType.typeName() in ("long", "integer") else F.col(tie)))
    return declared.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def last_writer(rows: DataFrame, key: list[str], value: Column, arrival: Column, name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, arrival).alias(name))


def lookup(uses: DataFrame, symbols: DataFrame, use: str, symbol: str, how: str = "inner") -> DataFrame:
    """Case-insensitive join of uses to symbols."""
    return uses.join(symbols, F.lower(use) == F.lower(symbol), how)


def with_fallback(uses: DataFrame, symbols: DataFrame, full: str, root: str, symbol: str, payload: str) -> DataFrame:
    """Two-stage lookup: the full name, else the name in the root namespace."""
    first = symbols.select(F.lower(symbol).alias("_f"), F.col(payload).alias("_p1"))
    second = symbols.select(F.lower(symbol).alias("_r"), F.col(payload).alias("_p2"))
    return (
        uses.join(first, F.lower(full) == F.col("_f"), "left")
        .join(second, F.lower(root) == F.col("_r"), "left")
        .withColumn(payload, F.coalesce("_p1", "_p2"))
        .drop("_f", "_p1", "_r", "_p2")
    )


def undefined(uses: DataFrame, symbols: DataFrame, use: str, symbol: str) -> DataFrame:
    """Uses of names that nothing declares."""
    return uses.join(symbols, F.lower(use) == F.lower(symbol), "left_anti")
