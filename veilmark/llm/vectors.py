"""What the operators on vectors share: which vectors count, integers from floats, matrices from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries saturate here, so that sums of a few fit in 64 bits.
MOST = 2.0**62


def whole(vec: str) -> Column:
    """Whether the vector is there and all its entries are finite numbers."""
    inside = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col(vec).isNotNull() & inside, F.lit(False))


def floors(vec: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry, as bigint."""
    kept = lambda c: F.greatest(F.least(c.cast("double") * float(scale), F.lit(MOST)), F.lit(-MOST))
    return F.transform(vec, lambda c: F.floor(kept(c)) + F.lit(offset).cast("bigint"))


def dimension(df: DataFrame, vec: str) -> int:
    """The most frequent length of a vector, the larger one in a tie; 0 if there is none."""
    lengths = df.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d"))
    first = lengths.first()
    return first["d"] if first else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, each list of length d, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
