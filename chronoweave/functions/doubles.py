"""Doubles taken apart: their order-preserving bits, and an accumulator that adds and subtracts them without loss.

Everything is arithmetic that is exact in doubles (powers of two, remainders, differences of neighbours) or in longs, so it
stays inside generated code and gives the same bits wherever and in whatever order rows are worked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -1074  #: 2^LEAST is the smallest positive double
WIDTH = 32  #: bits of an accumulator's bin; its long leaves room for 2^31 summands in force at once
MASK = (1 << WIDTH) - 1
FRACTION = 52
SMALLEST_NORMAL = 2.0**-1022
INFINITE = 0x7FF << FRACTION


def power(e: Column) -> Column:
    """2^e for -1022 <= e <= 1023, from a shift and a table of every 62nd power."""
    table = F.array(*[F.lit(2.0 ** (62 * q)) for q in range(-17, 17)])
    step = F.floor(e / F.lit(62)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (e - step * 62).cast("int"))
    return one.cast("double") * F.get(table, step + 17)


def ordered_bits(v: Column) -> Column:
    """A long that orders as the double does; both zeros give 0, NaN comes last."""
    size = F.abs(v)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int")
    base = power(guess)
    e = guess + F.when(size >= base * 2, 1).when(size < base, -1).otherwise(0)
    normal = (e + 1023).cast("long") * (1 << FRACTION) + ((size / power(e) - 1) * 2.0**FRACTION).cast("long")
    bits = (
        F.when(F.isnan(v), F.lit(INFINITE + (1 << FRACTION - 1)))
        .when(size == float("inf"), F.lit(INFINITE))
        .when(size < SMALLEST_NORMAL, (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise(normal)
    )
    return F.when(v.isNull(), None).when((v < 0) & ~F.isnan(v), -bits - 1).otherwise(bits)


def from_ordered_bits(b: Column) -> Column:
    """The double that `ordered_bits` came from."""
    size = F.when(b < 0, -b - 1).otherwise(b)
    e, rest = F.shiftright(size, FRACTION), size.bitwiseAND(F.lit((1 << FRACTION) - 1))
    value = (
        F.when(e == 0, rest.cast("double") * 2.0**LEAST)
        .when(e < 2047, (rest.cast("double") * 2.0**-FRACTION + 1.0) * power((e - 1023).cast("int")))
        .when(rest == 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(b < 0, -value).otherwise(value)


def bins_between(least: float | None, most: float | None) -> range:
    """The accumulator's bins that finite values of absolute size `least` (not zero) to `most` can touch."""
    if not most:
        return range(0)
    lowest = max(math.frexp(least)[1] - 53, LEAST)
    return range((lowest - LEAST) // WIDTH, (math.frexp(most)[1] - 1 - LEAST) // WIDTH + 1)


def part_in_bin(v: Column, b: int) -> Column:
    """The bits of a finite double that lie in bin `b`, as a long with the double's sign.

    Summed over the bins, each times 2^(LEAST + WIDTH * b), the parts are the double itself.
    """
    low = LEAST + WIDTH * b
    part = v % F.lit(2.0 ** (low + WIDTH)) if low + WIDTH <= 1023 else v
    if -low > 1023:
        part = part * F.lit(2.0**1023) * F.lit(2.0 ** (-low - 1023))
    else:
        part = part * F.lit(2.0**-low)
    return part.cast("long")


def with_totals(df: DataFrame, sums: dict[str, tuple[list[str], int]]) -> DataFrame:
    """Add, per name, the double nearest to the sum held in bin columns (lowest bin first, and that bin's number).

    Bins may be negative or hold more than their width. The sign comes first, then carries, then the three highest bins
    that aren't zero, with one bit for all below them, make a whole number of 55 to 63 bits, which is rounded once.
    """
    if not sums:
        return df
    zero = F.lit(0).cast("long")
    kept, signs, picks, totals = df.columns, {}, {}, {}
    for name, (columns, _) in sums.items():
        carry = zero
        for c in columns:
            carry = F.shiftright(F.coalesce(F.col(c), zero) + carry, WIDTH)
        signs[f"_sign_{name}"] = F.when(carry < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    df = df.withColumns(signs)
    # one projection per bin: nested carries would grow with the square of the bins
    for j in range(max(len(columns) for columns, _ in sums.values()) + 1):
        level = {}
        for name, (columns, _) in sums.items():
            if j > len(columns):
                continue
            carry = F.shiftright(f"_whole_{name}_{j - 1}", WIDTH) if j else zero
            own = F.coalesce(F.col(columns[j]), zero) * F.col(f"_sign_{name}") if j < len(columns) else zero
            level[f"_whole_{name}_{j}"] = own + carry
            if j:
                seen = F.col(f"_whole_{name}_{j - 1}").bitwiseAND(F.lit(MASK))
                level[f"_digit_{name}_{j - 1}"] = seen
                level[f"_below_{name}_{j - 1}"] = F.col(f"_below_{name}_{j - 2}").bitwiseOR(seen) if j > 1 else seen
        df = df.withColumns(level)
    for name, (columns, first) in sums.items():
        n, sign = len(columns), f"_sign_{name}"
        digit = [F.col(f"_digit_{name}_{j}") for j in range(n)] + [F.col(f"_whole_{name}_{n}")]
        below = [F.col(f"_below_{name}_{j}") for j in range(n)]
        top = F
        for j in reversed(range(len(digit))):
            top = top.when(digit[j] != 0, F.lit(j))
        picks[f"_top_{name}"] = top
        for back, part in enumerate("abc"):
            taken = [digit[h - back] if h >= back else zero for h in range(len(digit))]
            picks[f"_{part}_{name}"] = F.coalesce(*[F.when(digit[h] != 0, taken[h]) for h in reversed(range(len(digit)))])
        under = [below[h - 3] if h >= 3 else zero for h in range(len(digit))]
        picks[f"_rest_{name}"] = F.coalesce(*[F.when(digit[h] != 0, under[h]) for h in reversed(range(len(digit)))])
        a, b, c, rest = (F.col(f"_{p}_{name}") for p in ("a", "b", "c", "rest"))

        def joined(shift: int) -> tuple[Column, Column]:
            """a, b and c from `shift` bits below a's last one on, and what is cut off."""
            high = F.shiftleft(a, shift)
            if shift <= WIDTH:
                return high.bitwiseOR(F.shiftright(b, WIDTH - shift)), b.bitwiseAND(F.lit((1 << WIDTH - shift) - 1)).bitwiseOR(c)
            cut = 2 * WIDTH - shift
            return (
                high.bitwiseOR(F.shiftleft(b, shift - WIDTH)).bitwiseOR(F.shiftright(c, cut)),
                c.bitwiseAND(F.lit((1 << cut) - 1)),
            )

        whole = F
        for least, shift in ((1 << 23, 31), (1 << 15, 39), (1 << 7, 47), (0, 55)):
            number, lost = joined(shift)
            sticky = F.when(lost.bitwiseOR(rest) != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
            whole = whole.when(a >= least, number.bitwiseOR(sticky).cast("double") * F.lit(2.0**-shift))
        weight = F
        for j in range(len(digit)):
            e = LEAST + WIDTH * (first + j)
            weight = weight.when(F.col(f"_top_{name}") == j, F.lit(2.0**e if e <= 1023 else float("inf")))
        total = F.coalesce(whole * weight, F.lit(0.0))
        totals[name] = F.when(F.col(sign) < 0, -total).otherwise(total)
    return df.withColumns(picks).withColumns(totals).select(*kept, *totals)
