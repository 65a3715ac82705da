"""Counter-based noise: a value depends only on its key, never on partitioning, retries or lost executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _digest(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _word(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 of the parts, as a LONG."""
    return _word(_digest(*parts), 0)


def uniform(*parts: Column | str | int) -> Column:
    """Uniform on [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def uniform_int(n: Column | int, *parts: Column | str | int) -> Column:
    """Uniform integer on 0 .. n-1."""
    return F.floor(uniform(*parts) * n).cast("int")


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal from two words of one digest (Box-Muller)."""
    h = _digest(*parts)
    u = (_word(h, 0) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(_word(h, 1) * F.lit(2 * math.pi / 4294967296.0))
