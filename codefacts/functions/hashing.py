"""Hashes that Spark has no expression for."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & MASK
    return h


@F.pandas_udf(DecimalType(20, 0))
def report_hash(joined: pd.Series) -> pd.Series:
    """FNV-1a of a report's fields, joined by ``#``."""
    return joined.map(lambda s: None if s is None else Decimal(fnv1a(s.encode())))
