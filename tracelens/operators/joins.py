"""Join helpers that only broadcast what has been measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes a broadcast side may hold, well under the memory of a driver or executor.
BROADCAST_BYTES = 64 << 20


def row_bytes(columns: Sequence[str]) -> Column:
    """About the bytes that a row with these columns takes: those of its JSON."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("bigint") + 16


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df``, in one aggregate; bytes are those of its rows as JSON."""
    rows, total = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df.columns))).first()
    return rows, total or 0


def broadcast_if(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within the limit."""
    return F.broadcast(df) if n_bytes <= limit else df


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join, broadcasting ``small`` only after measuring it in bytes.

    Over the limit the join stays a shuffle join, where AQE's skew-join split
    handles hot keys on the big side.
    """
    return big.join(broadcast_if(small, measured(small)[1], limit), on, how)


def barrier(df: DataFrame) -> DataFrame:
    """Stop Catalyst from pushing later filters into the expressions above.

    A filter on a derived column is otherwise pushed below the projection and
    evaluates the (heavy) expression twice; a generator between them keeps the
    columns computed once.
    """
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*cols))))
