"""Keeps a caller's own columns out of the way of an operator's."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Columns that stages read and write under their own names.
SHARED = ("doc_id", "text", "n_chars", "lang", "source")


def columns_apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose DataFrame of documents may have further columns of any name: they pass through under names of no other use.

    The stage gets and gives back the columns in their order; the result has the caller's names again.
    """

    @functools.wraps(stage)
    def run(*args, **kwargs) -> DataFrame:
        at = next(k for k, a in enumerate(args) if isinstance(a, DataFrame))
        names = args[at].columns
        hidden = [n if n in SHARED else f"__kept_{k}" for k, n in enumerate(names)]
        done = stage(*args[:at], args[at].toDF(*hidden), *args[at + 1 :], **kwargs)
        return done.select(*hidden).toDF(*names)

    return run
