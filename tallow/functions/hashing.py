"""Seeded order and uniform draws from md5: the library's only source of randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(*parts) -> Column:
    """md5 of the parts joined by colons; a part is a column or a literal."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts) -> Column:
    """A number in [0, 1): the first 15 hexadecimal digits of the md5."""
    return F.conv(F.substring(seeded(*parts), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))
