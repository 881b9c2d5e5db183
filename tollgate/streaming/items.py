"""Requests with items on streams, where attached files arrive on their own."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators import items as item_ops
from tollgate.operators.policies import Policies, policy_table
from tollgate.operators.requests import settled, with_messages
from tollgate.streaming.jobs import FAR

ITEM_CHECK = "item_processing_rules"


def _has_items(rows: DataFrame) -> tuple[str, Column]:
    """The column that lists the items, and whether a row has any."""
    if "items" in rows.columns:
        return "items", F.coalesce(F.size("items") > 0, F.lit(False))
    return "input_items", item_ops.has_json_items(F.col("input_items"))


def validate_arriving(
    requests: DataFrame, policies: Policies, files: DataFrame, wait: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """One result row per request of a stream: ``request_id, ts, overall_status, violation_reasons, checks_skipped, error_message``.

    ``requests`` are those of :func:`tollgate.operators.requests.validate` with a time ``ts`` and a unique ``request_id``,
    their items in an array ``items`` or as JSON in ``input_items``. ``files`` is a stream ``(request_id, file_name, ts,
    description)``, with ``description_class`` if there is one. A file counts if its time is the request's or up to ``wait`` after it;
    of several of one name the first to arrive counts. Rows may arrive ``late``.

    A request whose policy has no item rules, or that lists no items, passes at once and takes no state. Texts
    are checked where they arrive: items carry the messages, not the texts, so state holds a few short rows
    per request until the watermark has passed its time and ``wait``. So are descriptions, unless the policies
    block too many words to look for all of them in every text, or come as a table. A request without a time cannot wait; its item check is
    named in ``checks_skipped``.
    """
    listed, has_items = _has_items(requests)
    table = policy_table(requests.sparkSession, policies)

    def judged(rows: DataFrame) -> DataFrame:
        return with_messages(rows, table, has_items=True).withColumn("_waits", F.col("_items") & has_items)

    # the end row of a finished input must not become a result; only the branch that waits has a watermark to move
    passing = judged(requests).filter(~F.coalesce(F.col("ts") >= F.lit(FAR), F.lit(False)) & (~F.col("_waits") | F.col("ts").isNull()))
    passing = passing.withColumn(
        "checks_skipped", F.when(F.col("_waits"), F.array_append("checks_skipped", F.lit(ITEM_CHECK))).otherwise(F.col("checks_skipped"))
    )
    kept = ["checks_skipped", "_before", "_after", "_known", "_items", "api_class"]
    # the test of ``ts`` keeps the filter behind the watermark, which has to see the end row
    waiting = judged(requests.withWatermark("ts", late)).filter(F.when(F.col("ts").isNotNull(), F.col("_waits") | (F.col("ts") >= F.lit(FAR))))
    verdict = waiting.select("request_id", "ts", "api_class", listed, F.struct(*kept).alias("_verdict"))
    explode = item_ops.explode_items if listed == "items" else item_ops.explode_json_items
    asked = explode(verdict, carry=("ts", "_verdict"))

    seconds = math.ceil(pd.Timedelta(wait).total_seconds())
    delay = math.ceil(seconds + pd.Timedelta(late).total_seconds())
    words = item_ops.listed_words(policies) if "description" in files.columns else None
    if words is not None:
        files = item_ops.read_descriptions(files, words)
    described = [c for c in ("description", "description_class", "described", "found_words") if c in files.columns]
    # two files that one request could take lie at most ``wait`` apart, which the state of this step covers
    arrived = (
        files.select(F.col("request_id").alias("_request"), F.col("file_name").alias("_name"), F.col("ts").alias("_file_ts"), *described)
        .withWatermark("_file_ts", f"{delay} seconds")
        .dropDuplicatesWithinWatermark(["_request", "_name"])
    )
    in_time = (F.col("_file_ts") >= F.col("ts")) & (F.col("_file_ts") <= F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    same = (F.col("request_id") == F.col("_request")) & (F.col("file_name") == F.col("_name"))
    attached = asked.join(arrived, same & in_time, "left").withColumn("has_file", F.col("_file_ts").isNotNull())
    checked = item_ops.item_messages(attached.drop("_request", "_name", "_file_ts"), table)
    # a group holds the items of one request
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "violations")))
    answered = checked.groupBy("request_id", "ts").agg(
        F.first("_verdict").alias("_verdict"), F.flatten(F.transform(ordered, lambda x: x["violations"])).alias("item_violations")
    )
    waited = answered.select("request_id", "ts", "_verdict.*", "item_violations")
    results = ["request_id", "ts", "overall_status", "violation_reasons", "checks_skipped", "error_message"]
    done = settled(waited, F.col("item_violations")).select(*results)
    return settled(passing, F.lit(None).cast("array<string>")).select(*results).unionByName(done)
