"""Integer helpers and radix partition expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lg_floor(n: int) -> int:
    if n < 1:
        raise ValueError("lg_floor needs n >= 1")
    return n.bit_length() - 1


def lg_ceil(n: int) -> int:
    if n < 1:
        raise ValueError("lg_ceil needs n >= 1")
    return (n - 1).bit_length()


def div_ceil(a: int, b: int) -> int:
    return -(-a // b)


def fanout(radix: int) -> int:
    """Partitions of a radix of so many bits."""
    return 1 << radix


def mask(radix: int) -> int:
    return fanout(radix) - 1


def low_radix(key: Column, radix: int) -> Column:
    """The key's lowest bits."""
    return key.bitwiseAND(F.lit(mask(radix)))


def shifted_radix(key: Column, radix: int, shift: int) -> Column:
    """`radix` bits of the key from bit `shift` up."""
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(mask(radix)))


def stripe_shift(rows: int, radix: int) -> int:
    """Shift at which each partition is two contiguous stripes of the keys 1 to rows."""
    return max(0, lg_ceil(rows) - radix - 1)
