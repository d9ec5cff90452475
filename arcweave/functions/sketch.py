"""Flajolet-Martin counting sketches as columns: an array of 32 bitmaps of 32 bits, each a bigint.

All steps are masked to 32 bits in bigint arithmetic, so nothing overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITMAPS, MASK, MAGIC = 32, (1 << 32) - 1, 0.77351


def _masked(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


#: The mixing steps, one after another. Fixed values.
STEPS = [
    lambda x: _masked(x + 0x7ED55D16 + _masked(F.shiftleft(x, 12))),
    lambda x: x.bitwiseXOR(F.lit(0xC761C23C)).bitwiseXOR(F.shiftright(x, 19)),
    lambda x: _masked(x + 0x165667B1 + _masked(F.shiftleft(x, 5))),
    lambda x: _masked(x + 0xD3A2646C).bitwiseXOR(_masked(F.shiftleft(x, 9))),
    lambda x: _masked(x + 0xFD7046C5 + _masked(F.shiftleft(x, 3))),
    lambda x: x.bitwiseXOR(F.lit(0xB55A4F09)).bitwiseXOR(F.shiftright(x, 16)),
    lambda x: F.when(x >= 1 << 31, F.lit(MASK) - x).otherwise(x),
]


def level_hashes(ident: Column) -> Column:
    """The 32 hashes of an id's low 32 bits, one a level: the value rotated left by 11 bits a level, then mixed."""
    code = _masked(ident.cast("bigint"))

    def rotated(level: Column) -> Column:
        by = (level * 11).bitwiseAND(F.lit(31))
        return F.call_function("shiftleft", code, by).bitwiseAND(F.lit(MASK)).bitwiseOR(F.call_function("shiftright", code, (32 - by).bitwiseAND(F.lit(31))))

    hashes = F.transform(F.sequence(F.lit(0), F.lit(BITMAPS - 1)), rotated)
    # A rotation by 0 is the value itself (an OR of it with itself).
    for step in STEPS:
        hashes = F.transform(hashes, step)
    return hashes


def singleton(ident: Column) -> Column:
    """The sketch of one id: in each bitmap the bit of the hash's trailing zeros (bit 0 for a hash of 0)."""
    return F.transform(level_hashes(ident), lambda h: F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h.bitwiseAND(-h)))


def merged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def merge_agg(sketch: str) -> Column:
    """Aggregate: the union of sketches. 32 bit_or buffers, so it combines before the shuffle."""
    return F.array(*(F.bit_or(F.col(sketch)[k]) for k in range(BITMAPS)))


def estimate(sketch: Column) -> Column:
    """Distinct ids that a sketch has seen, from the mean of the middle 16 runs of trailing ones."""
    runs = F.array_sort(F.transform(sketch, lambda b: F.bit_count(b.bitwiseXOR(b + 1)) - 1))
    total = F.aggregate(F.slice(runs, BITMAPS // 4 + 1, BITMAPS // 2), F.lit(0), lambda acc, r: acc + r)
    return (F.pow(F.lit(2.0), total / (BITMAPS // 2)) / MAGIC).cast("bigint")
