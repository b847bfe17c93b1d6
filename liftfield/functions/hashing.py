"""Reproducible draws: a 32-bit integer from the md5 of joined keys replaces a random generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """0 … 2^32-1 from ``a|b|c``; the same on every engine and after every task retry."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
