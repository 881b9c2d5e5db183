"""Ordered row operations per key that stay exact when one key holds most rows.

``Window.partitionBy(key)`` puts all rows of a key into one task. Every function
here first looks at the size of the largest group (one aggregate with map-side
combine). Groups below ``max_group_rows`` use the plain window. Beyond it the
rows are range-partitioned on ``(key, order)`` so a hot key spreads over many
tasks, and what a row needs from outside its piece is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tollgate.session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
BLOCK_ROWS = 250_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in range order with the piece number ``_piece``.

    ``order`` must be unique within a key. The checkpoint fixes the range
    borders, which Spark samples anew whenever the plan runs again.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(pieces, *keys, *order)
    return cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))


def _positions(pieces: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_pos``: the row's number within its key, counted from 0 over all pieces."""
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        pieces.groupBy(*keys, "_piece")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
        .alias("sizes")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    rows = pieces.withColumn("_no", F.row_number().over(inside) - 1).alias("rows")
    joined = rows.join(sizes, _same_keys(rows, sizes, [*keys, "_piece"]))
    return joined.select(
        *[rows[c] for c in rows.columns if c not in ("_no", "_piece")],
        (F.col("sizes._before") + F.col("rows._no")).alias("_pos"),
    )


def over_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``compute(rows, window)`` where the window frame reaches at most
    ``before`` rows back and ``after`` rows forward.

    Hot keys are cut into blocks of consecutive rows; rows near a border are
    also copied into the neighbouring block, so every frame is complete.
    """
    if largest_group(df, keys) <= max_group_rows:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    size = max(block_rows, before, after, 1)
    rows = _positions(_range_pieces(df, keys, order), keys, order)
    home = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") % size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1) if before else F.lit(None),
            F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None),
        )
    )
    blocks = rows.withColumn("_home", home).withColumn("_block", F.explode(copies))
    out = compute(blocks, Window.partitionBy(*keys, "_block").orderBy(*order))
    return out.filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_pos")


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Row number per key, from 1."""
    if largest_group(df, keys) <= max_group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = _positions(_range_pieces(df, keys, order), keys, order)
    return rows.withColumn(name, F.col("_pos") + 1).drop("_pos")


def carried_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Replace each null in ``values`` by the last non-null one at or before the row."""
    if largest_group(df, keys) <= max_group_rows:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values})
    pieces = _range_pieces(df, keys, order)
    upto = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values}).alias("rows")
    position = F.struct(*order)
    ends = pieces.groupBy(*keys, "_piece").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), position)).alias(v) for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({v: F.last(v, ignorenulls=True).over(earlier) for v in values}).alias("ends")
    joined = rows.join(ends, _same_keys(rows, ends, [*keys, "_piece"]))
    return joined.select(
        *[
            F.coalesce(rows[c], ends[c]).alias(c) if c in values else rows[c]
            for c in df.columns
        ]
    )
