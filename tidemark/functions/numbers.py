"""Plans of sizes: parts of an upload, space for temporary files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col

# Fixed values of the storage protocol and of the space guard.
PART, PARTS, OBJECT = 8 << 20, 10_000, 5 << 40
RESERVE_SHARE, RESERVE_LEAST = 10, 64 << 20
LARGEST = (1 << 63) - 1


def part_size(size: Column | str) -> Column:
    """Bytes of a part: 8 MiB, or more where that would take more than 10,000 parts; null beyond 5 TiB."""
    size = col(size)
    return F.when((size < 0) | (size > OBJECT), F.lit(None)).when(F.floor(size / PART) >= PARTS, F.floor(size / PARTS) + 1).otherwise(F.lit(PART)).cast("bigint")


def parts(size: Column | str) -> Column:
    each = part_size(size)
    return F.greatest(F.lit(1), F.floor((col(size) + each - 1) / each)).cast("bigint")


def space_needed(size: Column | str) -> Column:
    """The size and a reserve of a tenth, 64 MiB at least; without a known size no guard (null); never beyond a long."""
    size = col(size)
    reserve = F.greatest(F.floor(size / RESERVE_SHARE), F.lit(RESERVE_LEAST))
    return F.when(size <= 0, F.lit(None)).when(size > LARGEST - reserve, F.lit(LARGEST)).otherwise(size + reserve).cast("bigint")


def estimate(total: Column | str) -> Column:
    """A sum of sizes; -1 stands for unknown."""
    return F.when(F.coalesce(col(total), F.lit(0)) <= 0, F.lit(-1)).otherwise(col(total)).cast("bigint")
