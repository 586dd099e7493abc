"""Folding status changes into the state of an order, by event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The statuses an order may have, in order.
STATUSES = ("created", "paid", "shipped", "delivered", "cancelled", "returned")
REACHED = STATUSES[1:]


def first_reached(status: str = "status", at: str = "event_ts", statuses: Sequence[str] = REACHED) -> list[Column]:
    """One aggregate for each status: when it was first reached."""
    return [F.min(F.when(F.col(status) == s, F.col(at))).alias(f"{s}_at") for s in statuses]


def fold(changes: DataFrame, key: str = "order_id", status: str = "status", at: str = "event_ts") -> DataFrame:
    """(key, status, status_ts, *_at): the latest status (the greater one of a tie) and when each was first reached. One shuffle."""
    latest = F.max(F.struct(F.col(at).alias("t"), F.col(status).alias("s"))).alias("_last")
    return changes.groupBy(key).agg(latest, *first_reached(status, at)).select(key, F.col("_last.s").alias("status"), F.col("_last.t").alias("status_ts"), *[f"{s}_at" for s in REACHED])


def status_as_of(changes: DataFrame, instant: Column, key: str = "order_id", status: str = "status", at: str = "event_ts") -> DataFrame:
    """The status each order had at an instant: changes up to and including it count."""
    return changes.where(F.col(at) <= instant).groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias("status"))
