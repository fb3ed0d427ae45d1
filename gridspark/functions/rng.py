"""Keyed random numbers: the same wherever and in whatever order a row is computed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | int | str) -> Column:
    """In [0, 1), from the first 32 bits of the md5 of the key's parts."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(mean: float, deviation: float, *key: Column | int | str) -> Column:
    """By Box-Muller from two draws of the key."""
    a, b = uniform(*key, 1) + 2.0**-33, uniform(*key, 2)
    return mean + deviation * F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)
