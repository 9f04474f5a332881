"""Scalar expressions on direction codes: 0 inactive, 1 east, 2 south, 3 west, 4 north; row 0 on top."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: code -> (row step, column step)
STEPS = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}

#: Order in which neighbours are tried (north, south, west, east) and the code that leads back from there.
NEIGHBOURS = ((-1, 0, 2), (1, 0, 4), (0, -1, 1), (0, 1, 3))


def row_step(code: Column) -> Column:
    return F.when(code == 2, 1).when(code == 4, -1).otherwise(0)


def col_step(code: Column) -> Column:
    return F.when(code == 1, 1).when(code == 3, -1).otherwise(0)


def axis_code(dr: Column, dc: Column) -> Column:
    """Code of a pure axis step; anything else gives 0."""
    return F.when((dc > 0) & (dr == 0), 1).when((dr > 0) & (dc == 0), 2).when((dc < 0) & (dr == 0), 3).when((dr < 0) & (dc == 0), 4).otherwise(0)


def dominant_code(dr: Column, dc: Column) -> Column:
    """Code of the larger component; the horizontal one wins ties; no step gives 0."""
    across = F.abs(dc) >= F.abs(dr)
    return F.when((dr == 0) & (dc == 0), 0).when(across & (dc > 0), 1).when(across, 3).when(dr > 0, 2).otherwise(4)


def opposite(code: Column) -> Column:
    return F.when(code == 0, 0).otherwise((code + 1) % 4 + 1)


def object_code(dr: Column, dc: Column, own: Column) -> Column:
    """Dominant code of a step, replaced by the object's own code where the two oppose each other."""
    code = dominant_code(dr, dc)
    return F.when((own > 0) & (code == opposite(own)), own).otherwise(code)


def axis_dominant(dx: Column, dy: Column, ratio: float = 1.8) -> Column:
    low, high = F.least(F.abs(dx), F.abs(dy)), F.greatest(F.abs(dx), F.abs(dy))
    return high >= ratio * F.greatest(low, F.lit(1e-6))


def neighbours() -> Column:
    """Array of (dr, dc, back, k) to explode, in the order of NEIGHBOURS."""
    return F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(b).alias("back"), F.lit(k).alias("k")) for k, (dr, dc, b) in enumerate(NEIGHBOURS)])


def checked_code(value: Column) -> Column:
    """A finite whole code 0..4 as int; everything else raises, before any narrowing cast."""
    number = value.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number)) & number.between(0, 4)
    return F.when(good, number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("direction code outside 0..4: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int"))
