"""Seeded draws that depend on a row's key only, never on partitions, order or attempts.

A draw is the first 32 bits of an MD5 over seed, purpose and key, so any engine with MD5 repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = float(1 << 32)


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """The number that some hex digits of a digest write, the first of them at ``start`` (from 1)."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def is_under(digest: Column, share: float) -> Column:
    """Whether the draw of a digest, its first 32 bits, lies below this share of its range. Digits of one width are in the
    order of their numbers, so the digest is compared as it is."""
    least = math.ceil(share * TOP)
    return F.lit(least > 0) if least <= 0 or least >= TOP else digest < F.lit(f"{least:08x}")


def draw(seed: int, purpose: str, *key: Column) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    return hex_number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *parts)), 1, 8)


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """A number from 0 to under 1."""
    return draw(seed, purpose, *key) / F.lit(TOP)


def below(n: Column | int, seed: int, purpose: str, *key: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(draw(seed, purpose, *key), F.lit(n) if isinstance(n, int) else n)
