"""Where a value stands among sorted bounds, as a column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(value: Column, bounds: Sequence[Any], inclusive: bool = False) -> Column:
    """How many of the sorted bounds are smaller than a value, or not larger with ``inclusive``.

    Two steps, among the first bounds of groups and then in one group: a value is compared with twice the root of the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    before = (lambda b: b <= value) if inclusive else (lambda b: b < value)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda some: F.size(F.filter(some, before))
    heads = count(F.array(*[F.lit(g[0]) for g in groups]))
    inside = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(heads, F.lit(1)))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + count(inside)).cast("int")
