"""The policy table: one compiled row per policy, and requests joined to it."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.text import no_text
from tollgate.operators.rules import bad_patterns, compiled_rules, pattern_error
from tollgate.session import small_side

# What documentation assistance does unless a policy says otherwise.
MAX_QUERIES, PER_QUERY, TOTAL, THRESHOLD = 3, 2, 5, 0.1

ITEM_RULE = "struct<item_type string, rule_no int, required boolean, class_check boolean, denied array<string>, words array<string>>"
Policies = Mapping[str, Mapping] | DataFrame


def by_lower_name(policies: Mapping[str, Mapping]) -> dict[str, Mapping]:
    """Policies by lower-cased name; the last duplicate wins, empty policies count as absent."""
    named = {name.lower(): policy for name, policy in policies.items()}
    return {name: policy for name, policy in named.items() if policy}


def _part(policy: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(policy, f"$.{path}", kind)


def _flag(policy: Column, path: str) -> Column:
    return F.coalesce(_part(policy, path, "boolean"), F.lit(False))


def _words(policy: Column, path: str) -> Column:
    return F.array_compact(F.coalesce(_part(policy, path, "array<string>"), no_text()))


def _item_rules(policy: Column) -> Column:
    """The first rule of each item type, with its number."""
    listed = F.coalesce(_part(policy, "item_processing_rules", "array<variant>"), F.array().cast("array<variant>"))
    rules = F.transform(
        listed,
        lambda rule, number: F.struct(
            _part(rule, "item_type", "string").alias("item_type"),
            number.alias("rule_no"),
            _flag(rule, "vlm_processing.required").alias("required"),
            _flag(rule, "derived_text_checks.colbert_sensitivity").alias("class_check"),
            _words(rule, "derived_text_checks.disallowed_classes").alias("denied"),
            _words(rule, "derived_text_checks.blocked_keywords").alias("words"),
        ),
    )
    kinds = F.transform(rules, lambda r: F.coalesce(r["item_type"], F.lit("")))
    first = F.filter(rules, lambda r, i: F.array_position(kinds, F.coalesce(r["item_type"], F.lit(""))) == i + 1)
    return first.cast(f"array<{ITEM_RULE}>")


def compiled(rows: DataFrame, errors: Column) -> DataFrame:
    """``(policy_name, policy)`` rows, the policy as a variant, with all that checks need as typed columns."""
    policy = F.col("policy")
    assist = "documentation_assistance"
    columns = {
        "description": _part(policy, "description", "string"),
        "pair_check": _flag(policy, "modernbert_io_validation"),
        "input_check": _flag(policy, "colbert_input_sensitivity"),
        "output_check": _flag(policy, "colbert_output_sensitivity"),
        "input_denied": _words(policy, "disallowed_colbert_input_classes"),
        "input_allowed": _words(policy, "allowed_colbert_input_classes"),
        "output_denied": _words(policy, "disallowed_colbert_output_classes"),
        "output_allowed": _words(policy, "allowed_colbert_output_classes"),
        "strict": _flag(policy, "strict_item_type_matching"),
        "rules": compiled_rules(policy, errors),
        "item_rules": _item_rules(policy),
        "rate_limit": F.when(_flag(policy, "rate_limiting.enabled"), _part(policy, "rate_limiting.max_requests_per_minute", "bigint")),
        "help": F.struct(
            _flag(policy, f"{assist}.enabled").alias("help_enabled"),
            _part(policy, f"{assist}.index_path", "string").alias("index_path"),
            F.coalesce(_part(policy, f"{assist}.max_suggestions_per_query", "int"), F.lit(PER_QUERY)).alias("per_query"),
            F.coalesce(_part(policy, f"{assist}.max_total_suggestions", "int"), F.lit(TOTAL)).alias("total"),
            F.coalesce(_part(policy, f"{assist}.min_similarity_threshold", "double"), F.lit(THRESHOLD)).alias("threshold"),
            F.coalesce(_part(policy, f"{assist}.max_help_queries_to_use", "int"), F.lit(MAX_QUERIES)).alias("max_queries"),
        ),
    }
    return rows.select("policy_name", *[c.alias(n) for n, c in columns.items()])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _pattern_errors(patterns: pd.Series) -> pd.Series:
    """The patterns of each policy that cannot be used; runs over policies, never over requests."""
    return patterns.map(lambda listed: {p: e for p in listed if (e := pattern_error(p))})


def policy_table(spark: SparkSession, policies: Policies) -> DataFrame:
    """The compiled table of policies given as a dict, or as ``(policy_name, policy)`` rows with variants.

    A table that is compiled already comes back as it is.
    """
    if isinstance(policies, DataFrame):
        if "rules" in policies.columns:
            return policies
        listed = F.coalesce(_part(F.col("policy"), "custom_validation_rules", "array<variant>"), F.array().cast("array<variant>"))
        patterns = F.array_compact(F.transform(listed, lambda r: _part(r, "pattern", "string")))
        return compiled(policies.withColumn("_errors", _pattern_errors(patterns)), F.col("_errors"))
    named = by_lower_name(policies)
    rows = spark.createDataFrame([(name, json.dumps(p)) for name, p in named.items()], "policy_name string, text string")
    return F.broadcast(compiled(rows.select("policy_name", F.parse_json("text").alias("policy")), bad_patterns(named.values())))


def with_policy(rows: DataFrame, policies: Policies, name: str = "api_class") -> DataFrame:
    """Rows with ``_policy``, the row of the policy they name in any case; null where there is none.

    A small table is broadcast after its size was measured; a larger one is joined by
    shuffles, where adaptive execution splits a policy that most rows name.
    """
    table = policy_table(rows.sparkSession, policies)
    if isinstance(policies, DataFrame):
        table = small_side(table)
    side = table.select(F.col("policy_name").alias("_policy_name"), F.struct(*table.columns).alias("_policy"))
    joined = rows.join(side, F.lower(F.col(name)) == F.col("_policy_name"), "left")
    return joined.drop("_policy_name")
