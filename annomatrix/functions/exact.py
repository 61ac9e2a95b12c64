"""Sums and variances that no order and no partitioning of the rows changes, from integers.

A value belongs to a bucket of 24 binary exponents, the first from 1/256 up to 65536. In its bucket it is an integer of a fixed
unit, and so is its square, which is the sum of three exact products of the value's halves. Either integer is cut into
lanes of 29 bits, which add up as longs: exactly, in any order, for 2^34 values of one group, and with an overflow error
beyond. The lanes of a group are put together once: for a sum as doubles, from the largest to the smallest; for a variance as
one fraction of whole numbers, rounded once. NaN and infinities are kept apart; they add up the same in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import INF, NAN

LANE, WIDTH = 29, 24
#: Binary exponent of the least value of bucket 0, and minus that of its unit: 53 digits of a double and 1 to spare lower.
LOWEST, UNIT = -8, 62
SUM_LANES, SQUARE_LANES = 3, 6
HALVES = 2.0**27 + 1


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != INF)


def bucket(v: Column) -> Column:
    """The bucket of a double; 0 for zero and what is not finite."""
    exponent = F.floor(F.log2(F.when(is_finite(v) & (v != 0), F.abs(v))))
    return F.coalesce(F.floor((exponent - LOWEST) / F.lit(WIDTH)), F.lit(0)).cast("int")


def not_finite(v: Column) -> Column:
    """Sum of NaN and infinities, null if there are none."""
    return F.sum(F.when(~is_finite(v), v))


def _lane(y: Column, k: int, top: int) -> Column:
    here = F.rint(y * 2.0 ** (-LANE * k))
    return here if k == top else here - F.rint(y * 2.0 ** (-LANE * (k + 1))) * 2.0**LANE


def scaled(v: Column, b: Column) -> Column:
    """A finite value of bucket b, moved to bucket 0; 0 for others. In two steps, as one factor may be out of range."""
    half = F.pow(F.lit(2.0), -F.lit(WIDTH // 2) * b)
    return F.when(is_finite(v), v * half * half).otherwise(0.0)


def sum_lanes(a: Column) -> list[Column]:
    """Aggregates s0, s1, ... of scaled values."""
    y, top = a * 2.0**UNIT, SUM_LANES - 1
    return [F.sum(_lane(y, k, top).cast("long")).alias(f"s{k}") for k in range(SUM_LANES)]


def square_lanes(a: Column) -> list[Column]:
    """Aggregates q0, q1, ... of the squares of scaled values."""
    high = a * HALVES - (a * HALVES - a)
    low = a - high
    unit, top = 2.0 ** (2 * UNIT), SQUARE_LANES - 1
    ys = [high * high * unit, high * low * (2 * unit), low * low * unit]
    return [F.sum(sum((_lane(y, k, top) for y in ys[1:]), _lane(ys[0], k, top)).cast("long")).alias(f"q{k}") for k in range(SQUARE_LANES)]


def lane_names(squares: bool) -> list[str]:
    return [f"s{k}" for k in range(SUM_LANES)] + [f"q{k}" for k in range(SQUARE_LANES)] * squares


def total(parts: Column, special: Column) -> Column:
    """The sum, from an array of structs (b, s0, s1, ...), one of each bucket, and what is not finite."""
    of_part = lambda p: F.transform(F.array(*[F.lit(k) for k in reversed(range(SUM_LANES))]), lambda k: F.pow(F.lit(2.0), F.lit(WIDTH) * p["b"] - UNIT + LANE * k))
    lanes = lambda p: F.array(*[p[f"s{k}"].cast("double") for k in reversed(range(SUM_LANES))])
    value = lambda p: F.aggregate(F.zip_with(lanes(p), of_part(p), lambda n, u: F.when(n == 0, 0.0).otherwise(n * u)), F.lit(0.0), lambda x, y: x + y)
    return F.coalesce(special, F.aggregate(F.reverse(F.array_sort(parts)), F.lit(0.0), lambda x, p: x + value(p)))


def _quotient(up: int, down: int, shift: int) -> float:
    """up / down * 2^shift, rounded once."""
    try:
        return (up << shift) / down if shift >= 0 else up / (down << -shift)
    except OverflowError:
        return INF


def _variances(n: pa.Array, parts: pa.Array) -> pa.Array:
    """(n * sum of squares - square of the sum) / n^2 of each group, in whole numbers of Python."""
    lists = parts.offsets.to_numpy()
    fields = parts.values.slice(lists[0], lists[-1] - lists[0])
    of = lambda c: fields.field(c).to_numpy().astype(object)
    begin, b = lists[:-1] - lists[0], fields.field("b").to_numpy()
    if not len(begin):
        return pa.array([], pa.float64())
    least = np.minimum.reduceat(b, begin)
    above = (WIDTH * (b - np.repeat(least, np.diff(lists)))).astype(object)
    whole = lambda c, many: sum((of(f"{c}{k}") << (LANE * k) for k in range(1, many)), of(f"{c}0"))
    s = np.add.reduceat(whole("s", SUM_LANES) << above, begin)
    q = np.add.reduceat(whole("q", SQUARE_LANES) << (2 * above), begin)
    n = n.to_numpy().astype(object)
    shifts = (2 * (WIDTH * least.astype(np.int64) - UNIT)).tolist()
    return pa.array(list(map(_quotient, n * q - s * s, n * n, shifts)), pa.float64())


def variance(n: Column, parts: Column, plain: Column) -> Column:
    """Population variance, from the number of values and an array of structs (b, s0, ..., q0, ...) of each group, and
    whether all values are finite; NaN if not."""
    return F.when(plain, F.arrow_udf(_variances, T.DoubleType())(n, parts)).otherwise(NAN)
