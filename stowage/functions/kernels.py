"""Array kernels as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block categories and their costs in bytes.
ZERO, SPARSE, SMALL, MEDIUM, RAW = range(5)


def residual(a: Column, b: Column) -> Column:
    """(a - b) mod 256, element by element."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(256)))


def restore(residual_: Column, b: Column) -> Column:
    return F.zip_with(residual_, b, lambda r, y: F.pmod(r + y, F.lit(256)))


def signed(r: Column) -> Column:
    """Residuals as -128..127."""
    return F.transform(r, lambda x: F.when(x > 127, x - 256).otherwise(x))


def blocks(a: Column, size: int) -> Column:
    """Consecutive blocks of `size`; the last may be shorter."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(size)))


def block_costs(b: Column) -> Column:
    """Cost of each category, null where it can't hold the block."""
    nonzero = F.size(F.filter(b, lambda x: x != 0))
    low, high = F.array_min(b), F.array_max(b)
    return F.array(
        F.when(nonzero == 0, 1), F.lit(3) + 3 * nonzero, F.when((low >= -7) & (high <= 7), 193), F.when((low >= -31) & (high <= 31), 289), F.lit(385),
    )


def block_category(b: Column) -> Column:
    """The cheapest category, ties to the lowest code."""
    costs = block_costs(b)
    return F.array_position(costs, F.array_min(costs)).cast("int") - 1


def pack4(a: Column) -> Column:
    """Pairs of values -8..7 as bytes 0..255; an odd end is padded with 0."""
    nib = F.transform(a, lambda x: F.pmod(x, F.lit(16)))
    return F.transform(blocks(nib, 2), lambda p: F.shiftleft(p[0], 4).bitwiseOR(F.coalesce(F.get(p, 1), F.lit(0))))


def unpack4(packed: Column, n: Column) -> Column:
    out = F.flatten(F.transform(packed, lambda x: F.array(F.shiftright(x, 4), x.bitwiseAND(15))))
    return F.slice(F.transform(out, lambda x: F.when(x > 7, x - 16).otherwise(x)), F.lit(1), n)


def pack6(a: Column) -> Column:
    """Groups of four values -32..31 as numbers of 24 bits."""
    six = F.transform(a, lambda x: F.pmod(x, F.lit(64)))
    part = lambda p, i: F.coalesce(F.get(p, i), F.lit(0))
    return F.transform(blocks(six, 4), lambda p: F.shiftleft(part(p, 0), 18).bitwiseOR(F.shiftleft(part(p, 1), 12)).bitwiseOR(F.shiftleft(part(p, 2), 6)).bitwiseOR(part(p, 3)))


def unpack6(packed: Column, n: Column) -> Column:
    out = F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftright(x, s).bitwiseAND(63) for s in (18, 12, 6, 0)])))
    return F.slice(F.transform(out, lambda x: F.when(x > 31, x - 64).otherwise(x)), F.lit(1), n)
