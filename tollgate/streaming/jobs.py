"""Streaming forms of the checks.

The stateless ones are the batch functions themselves. What is added here are
windows with watermarks, the single-use token state and the two-phase join.
"""

from __future__ import annotations

import contextlib
import datetime
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegerType, IntegralType, StringType, StructField, StructType

from tollgate.functions.text import duration_seconds
from tollgate.operators.config import in_force
from tollgate.operators.policies import Policies, with_policy
from tollgate.session import scratch_path


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the files of a table: a folder, or a single file."""
    folder, _, last = path.rpartition("/")
    # a character class makes the path a pattern, which may also name a single file
    pattern = f"{folder}/{last[:-1]}[{last[-1]}]"
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(pattern)


def state_partitions(spark: SparkSession, path: str, bytes_each: int = 128 << 20) -> int:
    """Partitions for the state of a stream over ``path``.

    A stream cannot merge small partitions as adaptive execution does for batches.
    So a small input gets one per core, a large one up to ``spark.sql.shuffle.partitions``.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(size / bytes_each))
    return min(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_partitions(spark: SparkSession, per_core: int = 3) -> int:
    """Partitions for a stream whose work lies in its rows, however few files and bytes they come in."""
    return per_core * spark.sparkContext.defaultParallelism


FAR = datetime.datetime(9000, 1, 1)


def _empty(kind: DataType):
    """A value of the type that is not null, for the types of log columns."""
    if isinstance(kind, StringType):
        return ""
    if isinstance(kind, FractionalType):
        return 0.0
    if isinstance(kind, BooleanType):
        return False
    return 0 if isinstance(kind, IntegralType) else None


def with_end(stream: DataFrame, *times: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream, and a call that tells it that its input is finished.

    Windows and token lives are written when the watermark passes their end, so those of
    the last minutes of an input stay open for rows that might still come. For a finished
    input, hand the call to :func:`run_available` as ``finish``: when all rows are
    processed it adds one row that is far ahead in ``times`` and empty otherwise (not null:
    the optimiser drops rows without a join key before the watermark sees them), and a
    second run from the same checkpoint writes what is left. That row's own window is
    never written; jobs that pass single rows on have no use for it.
    """
    spark, schema = stream.sparkSession, StructType([StructField(f.name, f.dataType) for f in stream.schema])
    folder = scratch_path(spark, "stream-end")
    spark.createDataFrame([], schema).write.parquet(folder)

    def finish() -> None:
        _end_row(spark, schema, times).write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(schema).parquet(folder)), finish


def _end_row(spark: SparkSession, schema: StructType, times: tuple[str, ...]) -> DataFrame:
    row = tuple(FAR if f.name in times else _empty(f.dataType) for f in schema)
    return spark.createDataFrame([row], schema)


def write_in_time_order(rows: DataFrame, ts: str = "ts", rows_each: int = 1_000_000) -> str:
    """A finished table as files in the order of its times, the end row of :func:`with_end` in the last one.

    A stream reads the folder with ``files_per_trigger=1``. Each file holds the rows of one span of time, about ``rows_each``,
    and is younger than the one before, so the watermark follows the rows and state holds two spans, not the table. In a table
    read as a whole all rows are state before the first can leave it. Rows of one time share a file; those without come first.
    """
    spark, schema = rows.sparkSession, StructType([StructField(f.name, f.dataType) for f in rows.schema])
    folder, time_of = scratch_path(spark, "in-time-order"), F.unix_micros(ts)
    number = math.ceil(rows.count() / rows_each)
    bounds = []
    if number > 1:
        shares = [n / number for n in range(1, number)]
        bounds = sorted(set(rows.select(time_of.alias("t")).approxQuantile("t", shares, min(0.01, 0.1 / number))))
    if bounds:
        span = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: time_of >= b))
        staged = scratch_path(spark, "time-spans")
        rows.withColumn("time_span", span).write.partitionBy("time_span").parquet(staged)
        parted = spark.read.schema(StructType([*schema, StructField("time_span", IntegerType())])).parquet(staged)
    for n in range(len(bounds) + 1):
        part = parted.filter(F.col("time_span") == n).drop("time_span") if bounds else rows
        # small row groups, so that a batch's one file is still read by several tasks
        part.coalesce(1).write.option("parquet.block.size", 4 << 20).mode("append").parquet(folder)
        time.sleep(1)  # some file systems keep times in seconds, and the source goes by them
    _end_row(spark, schema, (ts,)).coalesce(1).write.mode("append").parquet(folder)
    return folder


@contextlib.contextmanager
def _partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """Partitions for the state of a query that is started inside; it takes its own copy of the settings then."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(number or before))
        yield
    finally:
        spark.conf.set(setting, before)


def run_available(
    stream: DataFrame, label: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "append",
    path: str | None = None, partitions: int | None = None, finish: Callable[[], None] | None = None,
) -> str:
    """Process what is there into a file sink and stop; gives the sink's path.

    Sink and checkpoint lie in the shared folder, so a restart goes on where it stopped.
    With ``finish`` (see :func:`with_end`) the input is taken as complete.
    """
    if finish is not None:
        base = path or scratch_path(stream.sparkSession, label)
        run_available(stream, label, fmt, partition_by, mode, base, partitions)
        finish()
        return run_available(stream, label, fmt, partition_by, mode, base, partitions)
    base = path or scratch_path(stream.sparkSession, label)
    writer = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _partitions(stream.sparkSession, partitions):
        started = writer.trigger(availableNow=True).start(f"{base}/rows")
    started.awaitTermination()
    return f"{base}/rows"


def keep_running(stream: DataFrame, path: str, every: str = "5 seconds", fmt: str = "parquet", partition_by: tuple[str, ...] = ()):
    """Start the same sink with a processing-time trigger; gives the running query."""
    writer = stream.writeStream.format(fmt).option("checkpointLocation", f"{path}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(processingTime=every).start(f"{path}/rows")


# --- windows -------------------------------------------------------------------------------------


def rate_limit(
    calls: DataFrame, keys: list[str], limit: int, every: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """Windows in which one caller made more than ``limit`` calls. Counts combine before the shuffle."""
    counted = calls.withWatermark("ts", late).groupBy(F.window("ts", every), *keys).agg(F.count("*").alias("calls"))
    return counted.filter(F.col("calls") > limit).select(
        F.col("window.start").alias("window_start"), *keys, "calls"
    )


PROGRESS = "latest long, rows long, late long, untimed long, batch long"


class LateRows:
    """Counts per window and key in which rows that come too late are a result, not a loss.

    A row is late when its window had ended ``late`` before the latest time of all earlier batches. Each batch adds its
    partial counts to ``counts``, its late rows (whole, for a later correction) to ``late_rows`` and one row to ``progress``: the
    latest time, rows, late rows and rows without a time, added up from the batch's counts. All three are tables
    below ``path``, one folder per batch, so a batch that is repeated after a failure replaces what it wrote, and a
    restart from the same path goes on with the times seen so far. Partial counts are combined when read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], every: str, late: str = "10 minutes", ts: str = "ts"):
        self.spark, self.path, self.keys, self.ts = spark, path, keys, ts
        self.length = int(pd.Timedelta(every).total_seconds())
        self.late_micros = int(pd.Timedelta(late).total_seconds() * 1_000_000)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def step(self, batch: DataFrame, number: int) -> None:
        earlier = self.progress().filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        begin = F.floor(F.unix_seconds(self.ts) / self.length) * self.length
        is_late = F.lit(False) if earlier is None else F.coalesce((begin + self.length) * 1_000_000 <= earlier - self.late_micros, F.lit(False))
        placed = batch.withColumns({"window_start": F.timestamp_seconds(begin), "is_late": is_late})
        counted = placed.groupBy("window_start", "is_late", *self.keys).agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros(self.ts)).alias("latest")
        )
        self._write(counted, "counts", number)
        self._write(placed.filter("is_late").drop("is_late"), "late_rows", number)
        written = self.spark.read.schema(counted.schema).parquet(f"{self.path}/counts/batch={number}")
        # last, since the next batches go by it
        self._write(
            written.agg(
                F.max("latest").alias("latest"),
                F.sum("rows").alias("rows"),
                F.sum(F.when(F.col("is_late"), F.col("rows"))).alias("late"),
                F.sum(F.when(F.col("window_start").isNull(), F.col("rows"))).alias("untimed"),
            ).na.fill(0, ["rows", "late", "untimed"]),
            "progress",
            number,
        )

    def run_available(self, stream: DataFrame) -> None:
        """Process what is there and stop."""
        self._write(self.spark.createDataFrame([], "latest long, rows long, late long, untimed long"), "progress", -1)
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    def progress(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(f"{self.path}/progress")

    def late_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/late_rows")

    def counts(self) -> DataFrame:
        """Rows in time and late rows per window and key."""
        partial = self.spark.read.parquet(f"{self.path}/counts").filter("window_start IS NOT NULL")
        return partial.groupBy("window_start", *self.keys).agg(
            F.coalesce(F.sum(F.when(~F.col("is_late"), F.col("rows"))), F.lit(0)).alias("in_time"),
            F.coalesce(F.sum(F.when(F.col("is_late"), F.col("rows"))), F.lit(0)).alias("late"),
        )


def alerts(
    metrics: DataFrame, settings: DataFrame, every: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Windows whose mean crosses the metric's threshold.

    ``settings`` is the static side ``(metric, threshold)``.
    """
    span = F.window("ts", every, slide) if slide else F.window("ts", every)
    means = metrics.withWatermark("ts", late).groupBy(span, "metric").agg(
        F.avg("value").alias("mean"), F.count("*").alias("samples")
    )
    return means.join(settings, "metric").filter(F.col("mean") > F.col("threshold")).select(
        F.col("window.start").alias("window_start"), "metric", "mean", "samples"
    )


def alert_settings(bodies: DataFrame) -> DataFrame:
    """``(metric, threshold, window)`` of configuration bodies (JSON in ``body``): the alert heuristic of their target metric.

    Of several bodies for a metric the one that is latest by ``ts`` counts.
    """
    parsed = bodies.select("ts", F.try_parse_json("body").alias("b"))
    rows = parsed.select(
        "ts",
        F.try_variant_get("b", "$.targetMetric", "string").alias("metric"),
        F.try_variant_get("b", "$.quickAlertHeuristic.threshold", "double").alias("threshold"),
        F.try_variant_get("b", "$.quickAlertHeuristic.window", "string").alias("window"),
    )
    last = rows.filter("metric IS NOT NULL").groupBy("metric").agg(F.max_by(F.struct("threshold", "window"), "ts").alias("s"))
    return last.select("metric", "s.threshold", "s.window")


def alerts_by_setting(metrics: DataFrame, settings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Windows whose mean crosses the metric's threshold, each metric in windows of its own configured length.

    ``settings`` is the static side ``(metric, threshold, window)`` with lengths such as ``5m`` or ``1h``; an unreadable length
    raises no alert. Windows start at multiples of their length. The watermark runs on the windows' ends
    and stays behind by the longest length and ``late``, so no window closes before its last row could arrive.
    """
    known = settings.select("metric", "threshold", duration_seconds(F.col("window")).alias("_seconds"))
    longest = known.agg(F.max("_seconds").alias("s")).first()["s"] or 60
    # metrics without a setting keep their rows up to the sum, since an end row has to reach the watermark
    placed = metrics.join(F.broadcast(known), "metric", "left").withColumn("_length", F.coalesce("_seconds", F.lit(longest)))
    begin = F.floor(F.unix_seconds("ts") / F.col("_length")) * F.col("_length")
    placed = placed.withColumns({"window_start": F.timestamp_seconds(begin), "window_end": F.timestamp_seconds(begin + F.col("_length"))})
    seconds = math.ceil(longest + pd.Timedelta(late).total_seconds())
    means = (
        placed.withWatermark("window_end", f"{seconds} seconds")
        .groupBy("window_end", "window_start", "metric")
        # settings as aggregates: a filter on keys would be pushed down and take the end row before the watermark sees it
        .agg(F.avg("value").alias("mean"), F.count("*").alias("samples"), F.max("threshold").alias("threshold"), F.max("_seconds").alias("window_seconds"))
    )
    return means.filter((F.col("mean") > F.col("threshold")) & F.col("window_seconds").isNotNull()).select(
        "window_start", "window_seconds", "metric", "mean", "samples"
    )


def rate_limit_by_policy(calls: DataFrame, policies: Policies, late: str = "10 minutes") -> DataFrame:
    """Minutes in which a caller made more calls than the policy's ``rate_limiting`` allows.

    ``calls`` holds ``(ts, api_class, user_id)``. A policy without an enabled limit, or an unknown one, limits nothing.
    """
    counted = calls.withColumn("api_class", F.lower("api_class")).withWatermark("ts", late)
    counted = counted.groupBy(F.window("ts", "1 minute"), "api_class", "user_id").agg(F.count("*").alias("calls"))
    limit = F.col("_policy.rate_limit")
    return with_policy(counted, policies).filter(F.col("calls") > limit).select(
        F.col("window.start").alias("window_start"), F.col("api_class").alias("policy"), "user_id", "calls", limit.alias("allowed")
    )


def limit_versions(bodies: DataFrame) -> DataFrame:
    """``(api_class, ts, version_id, allowed)`` of policy versions ``(policy_name, ts, version_id, body)``, the body as JSON text.

    A version without an enabled limit lifts the one before it (-1); one that cannot be read changes nothing.
    """
    policy = F.try_parse_json("body")
    enabled = F.coalesce(F.try_variant_get(policy, "$.rate_limiting.enabled", "boolean"), F.lit(False))
    number = F.try_variant_get(policy, "$.rate_limiting.max_requests_per_minute", "bigint")
    allowed = F.when(F.schema_of_variant(policy).startswith("OBJECT"), F.coalesce(F.when(enabled, number), F.lit(-1).cast("bigint")))
    return bodies.select(F.lower("policy_name").alias("api_class"), "ts", "version_id", allowed.alias("allowed"))


class VersionedRateLimit:
    """Minutes in which a caller made more calls than the policy version in force when the minute began allows.

    ``read_versions`` gives the table of :func:`limit_versions`'s input. It is called for every batch, so a version that is
    added while the stream runs holds for all minutes from its ``ts`` on that are settled later; a minute is settled when the
    watermark passes its end. Each batch first writes its finished minutes below ``path``, one folder per batch, and settles them
    from there, so a batch that is repeated after a failure replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str, read_versions: Callable[[], DataFrame], late: str = "10 minutes"):
        self.spark, self.path, self.read_versions, self.late = spark, path, read_versions, late

    def step(self, minutes: DataFrame, number: int) -> None:
        stored, found = f"{self.path}/minutes/batch={number}", f"{self.path}/rows/batch={number}"
        minutes.write.mode("overwrite").parquet(stored)
        counted = self.spark.read.schema(minutes.schema).parquet(stored)
        counted = counted.withColumn("row_id", F.xxhash64("ts", "api_class", "user_id"))
        limited = in_force(counted, limit_versions(self.read_versions()), "api_class", "allowed")
        over = limited.filter((F.col("allowed") >= 0) & (F.col("calls") > F.col("allowed")))
        over.select(F.col("ts").alias("window_start"), F.col("api_class").alias("policy"), "user_id", "calls", "allowed").write.mode(
            "overwrite"
        ).parquet(found)

    def counted(self, calls: DataFrame) -> DataFrame:
        """Calls ``(ts, api_class, user_id)`` a minute; counts combine before the shuffle."""
        placed = calls.select("ts", F.lower("api_class").alias("api_class"), "user_id").withWatermark("ts", self.late)
        per_minute = placed.groupBy(F.window("ts", "1 minute"), "api_class", "user_id").agg(F.count(F.lit(1)).alias("calls"))
        return per_minute.select(F.col("window.start").alias("ts"), "api_class", "user_id", "calls")

    def run_available(self, calls: DataFrame, partitions: int | None = None, finish: Callable[[], None] | None = None) -> None:
        """Process what is there and stop; with ``finish`` (see :func:`with_end`) the input is complete."""
        writer = self.counted(calls).writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.path}/checkpoint")
        with _partitions(self.spark, partitions):
            started = writer.trigger(availableNow=True).start()
        started.awaitTermination()
        if finish is not None:
            finish()
            self.run_available(calls, partitions)

    def rows(self) -> DataFrame:
        schema = "window_start timestamp, policy string, user_id bigint, calls bigint, allowed bigint, batch long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").drop("batch")


def against_baseline(metrics: DataFrame, stored: DataFrame, every: str, late: str = "10 minutes") -> DataFrame:
    """Deviation of each window's mean from the stored baseline, in spreads."""
    means = metrics.withWatermark("ts", late).groupBy(F.window("ts", every), "metric").agg(
        F.avg("value").alias("mean"), F.count("*").alias("samples")
    )
    known = stored.select("metric", F.col("mean").alias("base_mean"), F.col("spread").alias("base_spread"))
    score = (F.col("mean") - F.col("base_mean")) / F.col("base_spread")
    return means.join(known, "metric").select(
        F.col("window.start").alias("window_start"), "metric", "samples", score.alias("deviation")
    )


# --- single-use tokens -------------------------------------------------------------------------------
#
# Uses carry the ``expiry`` of their token, which runs from its issue. A use after it is
# expired, whatever went before; of the uses within it the first passes, the others are
# replays. A token can be forgotten once no use within its life can arrive any more, that
# is when the watermark has passed its expiry: no earlier, however long it stays silent.


def _alive() -> Column:
    return F.col("ts") <= F.col("expiry")


def _until_expiry(uses: DataFrame, life: str, late: str) -> DataFrame:
    """State by expiry: the watermark stays behind the youngest token by its life and the lateness."""
    seconds = pd.Timedelta(life).total_seconds() + pd.Timedelta(late).total_seconds()
    return uses.withWatermark("expiry", f"{math.ceil(seconds)} seconds")


def token_lives(uses: DataFrame, life: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """First use, replays and expired uses of every token, written when its life is over.

    ``life`` is the longest life of a token. Uses merge inside each task before the
    shuffle, so a token replayed by most rows sends few of them. Expired uses count if
    they arrive before the life is written; later ones are late rows, and never pass.
    """
    first = F.min(F.when(_alive(), F.struct("ts", "log_id")))
    counted = _until_expiry(uses, life, late).groupBy("token", "expiry").agg(
        first.alias("first"), F.count_if(_alive()).alias("alive"), F.count_if(~_alive()).alias("expired")
    )
    replays = F.greatest(F.col("alive") - 1, F.lit(0))
    return counted.select("token", F.col("first.log_id").alias("first_use"), replays.alias("replays"), "expired")


def token_uses(uses: DataFrame, life: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``outcome`` of every use of a token: ``first``, ``replay`` or ``expired``.

    Decides each use on its own, in Python, at some milliseconds per token and
    batch; :func:`token_lives` and :func:`first_uses` stay in the JVM.
    The earliest use within its life of the first batch that shows a token passes, other
    ones are replays. Expired uses need no state. Rows pass through one at a time and only
    the best candidate is held, so memory does not grow with the number of uses.
    """
    schema = "token string, log_id bigint, ts timestamp, outcome string"

    def decide(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.exists
        over = state.get[0] if used else 0
        best: tuple | None = None

        def told(times, ids, outcome):
            return pd.DataFrame({"token": key[0], "log_id": ids, "ts": times, "outcome": outcome})

        for chunk in chunks:
            times, ids = chunk["ts"].to_numpy(), chunk["log_id"].to_numpy()
            over = max(over, int(chunk["expiry"].max().value // 1_000_000))
            replayed = np.ones(len(ids), dtype=bool)
            if not used:
                first = np.lexsort((ids, times))[0]
                candidate = (times[first], ids[first])
                if best is None or candidate < best:
                    replayed[first] = False
                    best, candidate = candidate, best
                    if candidate is not None:
                        yield told([candidate[0]], [candidate[1]], "replay")
            if replayed.any():
                yield told(times[replayed], ids[replayed], "replay")
        if best is not None:
            yield told([best[0]], [best[1]], "first")
        state.update((over,))
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    own = uses.select("token", "log_id", "ts", "expiry")
    alive = _until_expiry(own.filter(_alive()), life, late)
    decided = alive.groupBy("token").applyInPandasWithState(
        decide, schema, "over bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return decided.unionByName(own.filter(~_alive()).select("token", "log_id", "ts", F.lit("expired").alias("outcome")))


def first_uses(uses: DataFrame, life: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Only the uses that pass: the first arrival of each token within its life."""
    return _until_expiry(uses.filter(_alive()), life, late).dropDuplicatesWithinWatermark(["token"])


# --- two-phase handshake ----------------------------------------------------------------------------------


def matched_phases(authorised: DataFrame, executed: DataFrame, life: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Executions inside the life of their authorisation, by transaction id.

    Both sides have a watermark and the join a time range, so old state is dropped.
    """
    a = authorised.withWatermark("auth_ts", late).alias("a")
    e = executed.withWatermark("exec_ts", late).alias("e")
    same = (F.col("a.transaction_id") == F.col("e.transaction_id")) & (F.col("a.token") == F.col("e.token"))
    alive = (F.col("e.exec_ts") >= F.col("a.auth_ts")) & (
        F.col("e.exec_ts") <= F.col("a.auth_ts") + F.expr(f"INTERVAL {life}")
    )
    bound: Column = F.col("a.auth_hash") == F.col("e.exec_hash")
    return a.join(e, same & alive).select("a.transaction_id", bound.alias("bound"))
