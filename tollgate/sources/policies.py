"""Policy files and reference-example files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.policies import by_lower_name

# The example texts a classifier uses when none are given.
DEFAULT_EXAMPLES: dict[str, list[str]] = {
    "Class 1: PII": ["SSN: 123-45-6789", "Credit card: 4111-1111-1111-1111"],
    "Class 2: Confidential": ["Project codename: Phoenix", "Internal memo"],
    "Class 3: Internal": ["Meeting notes", "Draft document"],
    "Class 4: Public": ["Press release", "Public blog post"],
}

RULE_SCHEMA = (
    "struct<type string, max_length bigint, text_fields array<string>, fields array<string>,"
    " field string, pattern string>"
)
ITEM_RULE_SCHEMA = (
    "struct<item_type string, vlm_processing struct<required boolean, prompt string>,"
    " derived_text_checks struct<colbert_sensitivity boolean, disallowed_classes array<string>,"
    " blocked_keywords array<string>>>"
)
POLICY_SCHEMA = (
    "struct<description string, modernbert_io_validation boolean, colbert_input_sensitivity boolean,"
    " colbert_output_sensitivity boolean, disallowed_colbert_input_classes array<string>,"
    " allowed_colbert_input_classes array<string>, disallowed_colbert_output_classes array<string>,"
    " allowed_colbert_output_classes array<string>, strict_item_type_matching boolean,"
    f" item_processing_rules array<{ITEM_RULE_SCHEMA}>, custom_validation_rules array<{RULE_SCHEMA}>,"
    " rate_limiting struct<enabled boolean, max_requests_per_minute bigint>,"
    " documentation_assistance struct<enabled boolean, index_path string, max_suggestions_per_query int,"
    " max_total_suggestions int, min_similarity_threshold double, max_help_queries_to_use int>>"
)


def parse_policies(files: DataFrame) -> DataFrame:
    """``value`` holds one policy file per row; gives ``policy_name`` (lower case) and ``policy``."""
    parsed = files.select(F.from_json("value", f"map<string,{POLICY_SCHEMA}>").alias("policies"))
    named = parsed.select(F.explode("policies").alias("name", "policy"))
    return named.select(F.lower("name").alias("policy_name"), "policy")


def policy_rows(files: DataFrame) -> DataFrame:
    """``(policy_name, policy)`` of policy files, with the policy as a variant: no schema drops or bends what is in it.

    ``value`` holds one file per row. Of names that are equal in lower case the last one of a file counts, of several
    files the one with the largest text; an empty policy counts as absent.
    """
    parsed = files.select("value", F.from_json("value", "map<string,variant>").alias("policies"))
    named = parsed.select(F.col("value"), F.posexplode("policies").alias("place", "name", "policy"))
    text = F.to_json("policy")
    last = named.groupBy(F.lower("name").alias("policy_name")).agg(F.max_by(text, F.struct("value", "place")).alias("text"))
    filled = last.select("policy_name", F.try_parse_json("text").alias("policy"))
    return filled.where(F.schema_of_variant("policy").startswith("OBJECT") & (F.schema_of_variant("policy") != "OBJECT<>"))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return parse_policies(spark.read.text(path, wholetext=True))


def load_policy_config(spark: SparkSession, path: str) -> dict[str, Mapping]:
    """Policies as configuration for the rule compiler. One file, held by the driver."""
    text = spark.read.text(path, wholetext=True).limit(1).first()
    return by_lower_name(json.loads(text["value"])) if text else {}


def parse_examples(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``value`` holds a JSON map from class to example texts."""
    classes = files.select(*keep, F.explode(F.from_json("value", "map<string,array<string>>")).alias("class", "examples"))
    return classes.select(*keep, "class", F.posexplode("examples").alias("example_no", "example"))


def examples_table(spark: SparkSession, examples: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(class, class_no, example_no, example)`` from a dict; the built-in examples by default."""
    given = examples if examples is not None else DEFAULT_EXAMPLES
    rows = [
        (name, number, position, text)
        for number, (name, texts) in enumerate(given.items())
        for position, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, "class string, class_no int, example_no int, example string")
