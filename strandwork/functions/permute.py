"""Keyed permutations of row numbers: a new order for each epoch, without a sort.

The numbers 0 to n - 1 are pairs of digits to two bases, a and b, with a * b just over n. Each round adds a draw from one
digit to the other, which can be undone, so the rounds are a bijection of all pairs; a result of n or more is sent through
again until it lies below (cycle walking), which keeps it a bijection of the numbers below n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions.draws import below

ROUNDS = 4
#: Results of n or more are sent through again so often at most; with a share of less than n^-0.5 of them, none is left.
WALKS = 64


def bases(n: int) -> tuple[int, int]:
    a = max(math.isqrt(max(n, 1) - 1) + 1, 1)
    return a, max(-(-n // a), 1)


def _step(x: Column, n: int, seed: int, epoch: Column, back: bool) -> Column:
    a, b = bases(n)
    low = F.pmod(x, F.lit(b).cast("bigint"))
    high = ((x - low) / F.lit(b)).cast("bigint")
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        of, base = (low, a) if r % 2 == 0 else (high, b)
        drawn = below(base, seed, "permute", epoch, F.lit(r), of)
        moved = F.pmod((high if r % 2 == 0 else low) + (-drawn if back else drawn), F.lit(base))
        high, low = (moved, low) if r % 2 == 0 else (high, moved)
    return high.cast("bigint") * b + low


def _walked(x: Column, n: int, seed: int, epoch: Column | int, back: bool) -> Column:
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    a, b = bases(n)
    first = _step(x.cast("bigint"), n, seed, epoch, back)
    if a * b == n:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(a * b - n, WALKS))), first, lambda y, _: F.when(y < n, y).otherwise(_step(y, n, seed, epoch, back)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place below n was found")).cast("bigint"))


def position_of(row: Column, n: int, seed: int, epoch: Column | int) -> Column:
    """The place, from 0 to n - 1, of a row number in the order of an epoch."""
    return _walked(row, n, seed, epoch, False)


def row_at(position: Column, n: int, seed: int, epoch: Column | int) -> Column:
    """The row number at a place: what ``position_of`` undoes."""
    return _walked(position, n, seed, epoch, True)
