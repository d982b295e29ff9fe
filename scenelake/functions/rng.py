"""Counter-based random draws: a draw is a function of seed and keys, so results do not depend on partitioning.

A sequential generator cannot be reproduced in parallel; here every draw is named by the seed, the entity and a label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int, keys: tuple) -> Column:
    # a null key is a key of its own: concat_ws would leave it out
    cols = [F.lit(str(seed)), *[(F.coalesce(k.cast("string"), F.lit("\x00null")) if isinstance(k, Column) else F.lit(str(k))) for k in keys]]
    return F.md5(F.concat_ws("|", *cols))


def draw(seed: int, *keys: Column | str | int) -> Column:
    """Uniform in [0, 1): 52 bits of the MD5 of seed and keys. Keys are columns or labels."""
    return F.conv(F.substring(_key(seed, keys), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def order_key(seed: int, *keys: Column | str | int) -> Column:
    """A random order: sort by it and take the first k for a sample without replacement."""
    return _key(seed, keys)


def uniform(lo, hi, u: Column) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return lo + (hi - lo) * u


def randint(lo: int, hi: int, u: Column) -> Column:
    """Integer in [lo, hi], both included."""
    return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("long")


def choice_index(n: Column, u: Column) -> Column:
    """0-based index into n things."""
    return F.floor(n * u).cast("long")


def sample_indices(n: Column, k: Column | int, most: int, seed: int, *keys: Column | str | int) -> Column:
    """k indices below n as an array: distinct ones where n >= k (Floyd's algorithm), else drawn with replacement.

    ``most`` bounds k. The work is k steps per sample, whatever n is; no pool row is touched.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    k, n = k.cast("long"), n.cast("long")
    empty = F.expr("cast(array() as array<bigint>)")

    def step(i: int, chosen: Column) -> Column:
        j = n - k + i
        t = F.floor((j + 1) * draw(seed, *keys, "pick", i)).cast("long")
        distinct = F.array_append(chosen, F.when(F.array_contains(chosen, t), j).otherwise(t))
        again = F.array_append(chosen, F.floor(n * draw(seed, *keys, "pick", i)).cast("long"))
        return F.when((F.lit(i) >= k) | (n == 0), chosen).when(n >= k, distinct).otherwise(again)

    # bound once per step: a transform over a one-element array is a let
    let = lambda value, fn: F.get(F.transform(F.array(value), fn), 0)
    out = empty
    for i in range(most):
        out = let(out, _taking(step, i))
    return out


def _taking(step, i: int):
    """step with its number bound: Spark reads a lambda's signature, so a default argument would count as an index."""
    return lambda chosen: step(i, chosen)
