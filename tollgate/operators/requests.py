"""Policy lookup, validation status and request bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.text import no_text
from tollgate.operators.policies import Policies, with_policy
from tollgate.operators.rules import class_list_messages, joined, pair_messages, rule_messages

# Status names and error texts.
BAD_REQUEST = "ERROR_BAD_REQUEST"
INVALID_POLICY = "REJECT_INVALID_POLICY"
VIOLATION = "REJECT_POLICY_VIOLATION"
PASS = "PASS"
CLASS_REQUIRED = "'api_class' field is required in JSON payload."
POLICY_NOT_FOUND = "Policy definition for API class '%s' (normalized to '%s') not found or not loaded."


def lookup_policy(requests: DataFrame, policies: Policies) -> DataFrame:
    """Each request with the name and description of its policy; ``policy_name`` is null where none matches."""
    found = with_policy(requests, policies)
    return found.withColumns({"policy_name": F.col("_policy.policy_name"), "description": F.col("_policy.description")}).drop("_policy")


def model_messages(df: DataFrame) -> Column:
    """Messages of the pair classifier and of the class lists, from the model results that ``df`` has."""
    policy = F.col("_policy")

    def text(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    arrays = []
    if {"io_prediction", "io_probability"} <= set(df.columns):
        found = pair_messages(F.col("io_prediction"), F.col("io_probability"), text("input_text"), text("output_text"))
        arrays.append(F.when(policy["pair_check"], found).otherwise(no_text()))
    for side in ("input", "output"):
        if f"{side}_class" in df.columns:
            found = class_list_messages(side, text(f"{side}_text"), F.col(f"{side}_class"), policy[f"{side}_denied"], policy[f"{side}_allowed"])
            arrays.append(F.when(policy[f"{side}_check"], found).otherwise(no_text()))
    return joined(arrays)


def skipped_checks(df: DataFrame, has_items: bool) -> Column:
    """Checks that a policy asks for and that have no results in ``df``."""
    policy = F.col("_policy")
    absent = {
        "modernbert_io_validation": (policy["pair_check"], {"io_prediction", "io_probability"} <= set(df.columns)),
        "colbert_input_sensitivity": (policy["input_check"], "input_class" in df.columns),
        "colbert_output_sensitivity": (policy["output_check"], "output_class" in df.columns),
        "item_processing_rules": (F.size(policy["item_rules"]) > 0, has_items),
    }
    named = [F.when(asked, F.lit(name)) for name, (asked, there) in absent.items() if not there]
    return F.array_compact(F.array(*named)) if named else no_text()


def with_messages(requests: DataFrame, policies: Policies, has_items: bool) -> DataFrame:
    """Requests with the messages of all checks but those of items, which go between ``_before`` and ``_after``.

    ``_known`` tells whether the policy is there, ``_items`` whether it has item rules.
    """
    rows = requests if "_policy" in requests.columns else with_policy(requests, policies)
    policy = F.col("_policy")
    known = policy.isNotNull()
    checked = {
        "checks_skipped": F.coalesce(F.when(known, skipped_checks(requests, has_items)), no_text()),
        "_before": F.coalesce(F.when(known, model_messages(requests)), no_text()),
        "_after": F.coalesce(F.when(known, rule_messages(policy["rules"], requests)), no_text()),
        "_known": known,
        "_items": F.coalesce(F.size(policy["item_rules"]) > 0, F.lit(False)),
    }
    return rows.withColumns(checked).drop("_policy")


def settled(judged: DataFrame, item_messages: Column) -> DataFrame:
    """The status of rows of :func:`with_messages`; ``item_messages`` count where the policy has item rules."""
    told = F.coalesce(F.when(F.col("_items"), item_messages), no_text())
    judged = judged.withColumn("violation_reasons", F.concat("_before", told, "_after"))
    asked = F.coalesce(F.col("api_class"), F.lit("")) != ""
    status = (
        F.when(~asked, F.lit(BAD_REQUEST))
        .when(~F.col("_known"), F.lit(INVALID_POLICY))
        .when(F.size("violation_reasons") > 0, F.lit(VIOLATION))
        .otherwise(F.lit(PASS))
    )
    error = F.when(~asked, F.lit(CLASS_REQUIRED)).when(
        ~F.col("_known"), F.format_string(POLICY_NOT_FOUND, F.col("api_class"), F.lower(F.col("api_class")))
    )
    return judged.withColumns({"overall_status": status, "error_message": error}).drop("_before", "_after", "_known", "_items")


def validate(requests: DataFrame, policies: Policies, item_results: DataFrame | None = None) -> DataFrame:
    """One result row per request. Works on batch and streaming frames.

    ``policies`` is a dict or a table (see :func:`tollgate.operators.policies.policy_table`) of any number of
    policies: a request meets its own one in a join, and only that one's rules are worked on. Model results are
    read from the columns ``io_prediction``, ``io_probability``, ``input_class`` and ``output_class``; a check
    whose column is absent is skipped and named. Item messages come from a column ``item_violations`` or from
    ``item_results``, ``(request_id, item_violations)``. Without ``item_results`` nothing but the policies moves.
    With it, texts are checked before the join, so a plan that does not select them does not shuffle them.
    Streams whose files arrive on their own go through :mod:`tollgate.streaming.items`.
    """
    has_items = item_results is not None or "item_violations" in requests.columns
    judged = with_messages(requests, policies, has_items)
    if item_results is not None:
        judged = judged.join(item_results.select("request_id", "item_violations"), "request_id", "left")
    return settled(judged, F.col("item_violations") if has_items else no_text()).drop("item_violations")


def with_request_id(requests: DataFrame, key: str, received: Column) -> DataFrame:
    """Fill a missing ``request_id`` with ``req_<epoch>_<key>``.

    The key is a column of the data, so a repeated run gives the same id.
    """
    made = F.concat_ws("_", F.lit("req"), F.unix_timestamp(received).cast("string"), F.col(key).cast("string"))
    return requests.withColumns(
        {
            "request_id": F.coalesce(F.col("request_id").cast("string"), made),
            "timestamp_utc": F.unix_micros(received) / 1e6,
        }
    )


def summary(results: DataFrame) -> DataFrame:
    """Requests and violations by policy class and status."""
    return results.groupBy(F.lower("api_class").alias("policy"), "overall_status").agg(
        F.count("*").alias("requests"),
        F.sum(F.size("violation_reasons")).alias("violations"),
    )
