"""String helpers with the whitespace and rounding rules the results need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space, also beyond ASCII.
SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    """True when anything but white space occurs (stops at the first such character)."""
    return text.rlike(f"[^{SPACE_CLASS}]")


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``bround`` works on the shortest decimal text of a double, which makes ties out
    of values such as 2.675 that lie below the tie. Here value * 10^digits is kept
    as the exact sum of two doubles (high part from a float, low part the rest), so
    the comparison with the middle is exact. Values of 2^53 and more after scaling
    have no fraction to round and are returned as they are.
    """
    scale = float(10**digits)
    high = value.cast("float").cast("double")
    top, rest = high * scale, (value - high) * scale
    down = F.floor(top + rest).cast("double")
    gap = (top - (down + 0.5)) + rest
    whole = (
        F.when(gap > 0, down + 1.0)
        .when(gap < 0, down)
        .otherwise(down + F.pmod(down, F.lit(2.0)))
    )
    plain = F.isnan(value) | (F.abs(value) * scale >= float(2**53))
    return F.when(plain, value).otherwise(whole / scale)
