"""Hash columns that other engines can compute, too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def md5_60(text: Column) -> Column:
    """The first 60 bits of MD5 as a BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded(seed: int | str, item: Column) -> Column:
    """A keyed 60-bit hash; items are compared by their text, so 1 and '1' are the same."""
    return md5_60(F.concat(F.lit(f"{seed}:"), item.cast("string")))


def affine_family(n: int, seed: int) -> list[tuple[int, int]]:
    """n pairs (a, b) for x -> (a * x + b) mod PRIME, drawn by a linear congruential generator from the seed."""
    out, state = [], seed & 0xFFFFFFFF
    for _ in range(n):
        pair = []
        for low in (1, 0):
            state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
            pair.append(low + (state >> 33) % (PRIME - low))
        out.append(tuple(pair))
    return out


def trailing_zeros(x: Column, width: int) -> Column:
    """Zeros below the lowest set bit; `width` for zero."""
    return F.when(x == 0, F.lit(width)).otherwise(F.bit_count((x.bitwiseAND(-x)) - 1)).cast("int")
