"""Sizes of products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import uniform

#: Shape -> least and largest size in metres: fixed values.
SHAPE_RANGES = {
    "box": (0.10, 0.35),
    "box_rounded": (0.12, 0.30),
    "can": (0.06, 0.20),
    "can_jar": (0.08, 0.25),
    "bottle": (0.12, 0.35),
    "bag": (0.08, 0.40),
}
#: Where the shape is not known: fixed values.
FALLBACK_RANGE = (0.08, 0.35)
STACKABLE = ("box",)
#: Bounds differ on purpose, what is written is narrower than what is read: fixed values.
WRITE_BOUNDS = (0.03, 1.20)
READ_BOUNDS = (0.03, 1.5)
#: Placement mode -> scale of the drop zone, and the zone where none is given: fixed values.
ZONE_SCALE = {"scatter": 6.0, "cluster_mid": 4.0, "cluster_tight": 0.6, "stacking": 1.0}
DROP_BOUNDS = (-0.12, 0.12, -0.12, 0.12)


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a small literal table, the default where the key is unknown or null."""
    items = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*items), F.coalesce(key, F.lit(""))), F.lit(default))


def size_range(shape: Column, ranges: dict = SHAPE_RANGES, fallback: tuple = FALLBACK_RANGE) -> tuple[Column, Column]:
    lo = lookup(shape, {k: v[0] for k, v in ranges.items()}, fallback[0])
    hi = lookup(shape, {k: v[1] for k, v in ranges.items()}, fallback[1])
    return lo, hi


def random_size(shape: Column, u: Column, ranges: dict = SHAPE_RANGES, fallback: tuple = FALLBACK_RANGE) -> Column:
    return uniform(*size_range(shape, ranges, fallback), u)


def product_size(estimate: Column, shape: Column, jitter: Column, u: Column, ranges: dict = SHAPE_RANGES) -> Column:
    """The estimate within its bounds, varied by 5 % either way; else a random size of the shape."""
    return F.when(estimate.between(*READ_BOUNDS), estimate * uniform(0.95, 1.05, jitter)).otherwise(random_size(shape, u, ranges))


def writable(size_m: Column) -> Column:
    """Within bounds; false for NaN and null."""
    return F.coalesce(size_m.between(*WRITE_BOUNDS), F.lit(False))


def is_stackable(shape: Column) -> Column:
    """Null shapes are not."""
    return F.coalesce(shape.isin(*STACKABLE), F.lit(False))


def round3(x: Column) -> Column:
    """To 3 places, ties up; the same in every SQL engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def python_round3(x: Column) -> Column:
    """To 3 places as Python's round does: the nearest of the number's exact value, an exact tie to the even digit.

    The product with 1000 is taken exactly, as its rounded value and the rest (both factors' halves multiply without
    rounding), and both are compared with the half way. For magnitudes below 2 ** 42; others have no third place to round
    and stay, as do NaN and infinities.
    """

    def exact(a: Column) -> Column:
        p, c = a * 1000.0, a * 134217729.0  # 2 ** 27 + 1 cuts a double in halves
        high = c - (c - a)
        rest = (high * 1000.0 - p) + (a - high) * 1000.0
        whole = F.floor(p).cast("double")
        over = (p - whole - 0.5) + rest
        odd = F.pmod(whole, F.lit(2.0)) == 1.0
        up = (over > 0) | ((over == 0) & odd)
        return (whole + F.when(up, 1.0).otherwise(0.0)) / 1000.0

    return F.when(F.abs(x) < 2.0**42, F.signum(x) * exact(F.abs(x))).otherwise(x)


def zone(bounds: Column | None, mode: Column) -> Column:
    """The drop zone scaled by the mode; the default zone, not scaled, where no bounds are given."""
    default = F.array(*map(F.lit, DROP_BOUNDS))
    if bounds is None:
        return default
    scale = lookup(mode, ZONE_SCALE, 1.0)
    return F.when(bounds.isNull(), default).otherwise(F.transform(bounds, lambda b: b * scale))
