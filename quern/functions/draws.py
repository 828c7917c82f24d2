"""Random numbers by hash of a seed and keys: the same for any partitioning and in any engine that has MD5."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed:key:key:..."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def gaussian(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, "r", *keys))) * F.cos(2 * pi * uniform(seed, "a", *keys))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same in SQL; keys are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def gaussian_sql(seed: int, *keys: str) -> str:
    quoted = [uniform_sql(seed, f"'{kind}'", *keys) for kind in "ra"]
    return f"(sqrt(-2 * ln({quoted[0]})) * cos({2 * pi!r}::DOUBLE * {quoted[1]}))"
