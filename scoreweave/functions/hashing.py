"""Seeded, engine-independent ordering of rows.

Samples, splits and folds order rows by the md5 text of ``seed:key``. The hex
text sorts like the number it spells, so a prefix of it is a range bucket of
known, even depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    # A digest that cannot be null spares the optimizer a null check that computes it twice.
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def prefix(digest: Column, digits: int) -> Column:
    return F.substring(digest, 1, digits)


def fold_of(key: Column, seed: int, folds: int) -> Column:
    """Fold number from the first 8 hex digits of the seeded digest."""
    return F.pmod(F.conv(prefix(seeded(key, seed), 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")
