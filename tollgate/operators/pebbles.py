"""State-transition logs with proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.functions.canonical import proof
from tollgate.operators.ordered import over_order


def verify(pebbles: DataFrame) -> DataFrame:
    """``verified``: the proof fits the state and the breadcrumb. Works on streams."""
    return pebbles.withColumn(
        "verified", F.coalesce(proof(F.col("state"), F.col("breadcrumb")) == F.col("proof"), F.lit(False))
    )


def transitions(pebbles: DataFrame, key: str = "use_case", order: tuple[str, ...] = ("ts", "log_id"), **limits) -> DataFrame:
    """Each state with the one before it."""
    status = pebbles.withColumn("status", F.get_json_object("state", "$.status"))

    def previous(rows, window):
        return rows.withColumn("previous_status", F.lag("status").over(window))

    return over_order(status, [key], list(order), previous, before=1, **limits).withColumn(
        "changed", ~F.col("status").eqNullSafe(F.col("previous_status"))
    )
