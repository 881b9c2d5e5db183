"""Baselines, deviations and thresholds of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.ordered import MAX_GROUP_ROWS, numbered, over_order
from tollgate.session import cut_lineage, small_side, small_table

#: Accuracy of the sketch that proposes cuts, and the number of cells of a further pass.
SKETCH = 10_000
GRID = 100


def baseline(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread")
    )


def deviations(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Current means against the stored baseline, in spreads."""
    known = small_table(stored.select(*keys, F.col("mean").alias("base_mean"), F.col("spread").alias("base_spread")))
    score = F.when(F.col("base_spread") > 0, (F.col("mean") - F.col("base_mean")) / F.col("base_spread"))
    return current.join(known, keys).withColumn("deviation", score)


def rolling(metrics: DataFrame, keys: list[str], order: list[str], rows: int, **limits) -> DataFrame:
    """Mean and spread of the ``rows`` entries before each one."""

    def recent(df, window):
        frame = window.rowsBetween(-rows, -1)
        return df.withColumns(
            {
                "recent": F.count("value").over(frame),
                "recent_mean": F.avg("value").over(frame),
                "recent_spread": F.stddev_samp("value").over(frame),
            }
        )

    return over_order(metrics, keys, order, recent, before=rows, **limits)


def exact_quantiles(
    metrics: DataFrame, key: str, quantile: float, tie: str, name: str = "quantile", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Interpolated quantile of ``value`` per key, by selection instead of a sort.

    A sketch gives two cuts around the wanted rank, an exact count per cell between and on the cuts says
    which cells hold the rank, and only the rows of those cells go on. When few enough are left they are numbered.
    Counts are exact, so a poor sketch costs a further pass and never a wrong value; rows equal to a cut are a cell of
    their own and are never numbered. Keys may be null, and one key may hold most rows.
    """
    rows = metrics.filter("value IS NOT NULL").select(key, F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    bounds = cut_lineage(
        sizes.select(key, (F.lit(quantile) * (F.col("_n") - 1) + 1).alias("_at"), "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside"))
    )
    step = 2 / SKETCH
    cuts = [min(1.0, max(0.0, quantile + d)) for d in (-step, step)]
    while True:
        wide = bounds.filter((F.col("_low") < F.col("_high")) & (F.col("_inside") > max_group_rows))
        if wide.isEmpty():
            break
        narrower = cut_lineage(_narrowed(_within(rows, wide, key), key, cuts))
        stuck = narrower.join(bounds.select(F.col(key).alias("_k"), F.col("_inside").alias("_was")), F.col(key).eqNullSafe(F.col("_k")))
        if not stuck.filter("_inside < _was").limit(1).count():
            break  # no cut helps any more: the rest is numbered over range-sorted pieces
        done = bounds.join(narrower.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        bounds = cut_lineage(done.unionByName(narrower))
        cuts = [i / GRID for i in range(1, GRID)]
    same = bounds.filter("_low = _high").select(key, F.col("_low").alias(name))
    open_ = bounds.filter("_low < _high")
    kept = _within(rows, open_, key).withColumn("_id", F.monotonically_increasing_id())
    placed = numbered(kept, [key], ["value", "_id"], "_no", max_group_rows=max_group_rows)
    place = F.col("_no") + F.col("_before")
    near = placed.filter((place == F.floor("_at")) | (place == F.ceil("_at")))
    low, high = F.min("value"), F.max("value")
    part = F.first("_at") - F.floor(F.first("_at"))
    return same.unionByName(near.groupBy(key).agg((low + (high - low) * part).alias(name)))


def _within(rows: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Rows between the bounds of their key, with those bounds."""
    side = small_side(bounds.withColumnRenamed(key, "_k"))
    met = rows.join(side, rows[key].eqNullSafe(F.col("_k")) & F.col("value").between(F.col("_low"), F.col("_high")))
    return met.drop("_k")


def _narrowed(rows: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    """New bounds per key: the cells between and on the cuts that hold the wanted ranks, counted exactly."""
    sketch = rows.groupBy(key).agg(F.array_distinct(F.percentile_approx("value", cuts, SKETCH)).alias("_cuts"))
    side = small_side(cut_lineage(sketch).withColumnRenamed(key, "_k"))
    met = rows.join(side, rows[key].eqNullSafe(F.col("_k"))).drop("_k")
    below = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
    cell = 2 * below + F.array_contains("_cuts", F.col("value")).cast("int")
    cells = met.groupBy(key, cell.alias("_cell")).agg(
        F.count("*").alias("_rows"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.first("_at").alias("_at"), F.first("_before").alias("_base")
    )
    # a key has at most twice as many cells as cuts
    upto = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    holds = (F.col("_before") < F.ceil("_at")) & (F.col("_before") + F.col("_rows") >= F.floor("_at"))
    return counted.filter(holds).groupBy(key).agg(
        F.first("_at").alias("_at"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_before").alias("_before"), F.sum("_rows").alias("_inside")
    )


def threshold_breaches(measured: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Metrics beyond their custom threshold: ``accuracy`` from below, latency from above.

    ``thresholds`` holds ``(key, metric, threshold)``, ``measured`` ``(key, metric, value)``.
    """
    joined = measured.join(small_table(thresholds), [key, "metric"])
    low = F.col("metric").startswith("accuracy")
    breach = F.when(low, F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return joined.withColumn("breached", breach)
