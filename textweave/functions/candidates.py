"""Which patterns a sentence may match, found for whole batches at once: an exact expression then looks at those sentences alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def near_words(pattern: str) -> str:
    """The pattern without an ASCII word character on either side: wider than the same with those of all scripts."""
    return rf"(?:^|[^0-9A-Za-z_])(?:{pattern})(?:$|[^0-9A-Za-z_])"


def candidates(sentences: Column, patterns: Sequence[str]) -> Column:
    """array<bigint>: for each sentence of a non-null array of strings the sum of 2^k over the RE2 patterns k that it matches.

    Patterns must be no narrower than the expressions that they stand before.
    """

    @F.arrow_udf("array<bigint>")
    def masks(s: pa.Array) -> pa.Array:
        flat, offsets = s.flatten(), s.offsets.to_numpy()
        found = np.zeros(len(flat), np.int64)
        for k, p in enumerate(patterns):
            found |= pc.match_substring_regex(flat, p).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(found))

    return masks(sentences)


def may(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << k).cast("long")) != 0
