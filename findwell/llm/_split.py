"""Held-out splits by crc32 of the id as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int) -> Column:
    """crc32(id as text) mod `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod
