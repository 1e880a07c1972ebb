"""Integer vectors that several vector operators share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Component x becomes floor(SCALE * x).
SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))


def longest(df: DataFrame, vector: str) -> int:
    """The number of components of the longest vector, 0 where there is none."""
    return df.agg(F.max(F.size(vector)).alias("n")).first().n or 0


def largest_component(dim: int) -> int:
    """The bound of components that keeps a squared distance of two vectors, and their inner product, within 62 bits."""
    return 1 << (30 - math.ceil(math.log2(max(dim, 1)) / 2))


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of each component as int64, a row a vector; shorter vectors are followed by zeros.

    Components beyond largest_component are set to it, so that no sum of products overflows; floats below 2^13 are never there
    with up to 10^5 components.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    vectors = vectors.cast(pa.large_list(pa.float64()))
    most = float(largest_component(dim))
    flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE), -most, most).astype(np.int64)
    off = vectors.offsets.to_numpy()
    off = off - off[0]
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - off[row]] = flat
    return out


def rows_a_block(dim: int, values: int) -> int:
    """How many rows of dim components a block of `values` components takes, one at least."""
    return max(1, values // max(dim, 1))
