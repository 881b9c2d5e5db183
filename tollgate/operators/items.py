"""Checks on the items of a request and on the files attached to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.text import NATIVE_WORDS, messages_if, no_text, words_found
from tollgate.operators.policies import Policies, policy_table, with_policy
from tollgate.operators.rules import joined

# Message texts and the item types an image model takes.
NO_RULE = "No processing rule defined for item type: '%s'."
NO_FILE_NAME = "VLM processing required for item '%s', but 'filename_in_form' is missing."
NO_FILE = "Required file '%s' for item '%s' not found in form data."
NOT_SUPPORTED = "VLM processing not supported for item type: '%s'."
DERIVED_CLASS = "VLM-derived text for item '%s' classified as disallowed sensitivity: '%s'."
DERIVED_WORDS = "VLM-derived text for item '%s' contains blocked keywords: %s."
NOT_A_LIST = "Invalid 'input_items' format: expected a list."
NOT_AN_OBJECT = "Item at index %d is not a valid object."
IMAGE_TYPES = ["image", "screenshot"]


def shape_messages(items_json: Column) -> Column:
    """Messages for an item list that is no list, or holds values that are no objects."""
    parsed = F.try_parse_json(items_json)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    elements = F.when(is_list, parsed.cast("array<variant>"))
    flagged = F.transform(
        elements,
        lambda item, index: F.when(
            ~F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False)),
            F.format_string(NOT_AN_OBJECT, index),
        ),
    )
    return (
        F.when(items_json.isNull(), no_text())
        .when(~F.coalesce(is_list, F.lit(False)), F.array(F.lit(NOT_A_LIST)))
        .otherwise(F.array_compact(flagged))
    )


def explode_items(requests: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per item with its index and the default id and type; rows without items drop out.

    ``carry`` names columns of the request that its items keep.
    """
    rows = requests.filter(F.size("items") > 0).select(
        "request_id", *carry, F.lower("api_class").alias("policy_name"), F.posexplode("items").alias("item_no", "item")
    )
    return rows.select(
        "request_id",
        *carry,
        "policy_name",
        "item_no",
        F.coalesce("item.id", F.concat(F.lit("item_"), F.col("item_no").cast("string"))).alias("item_id"),
        F.coalesce("item.type", F.lit("unknown_type")).alias("item_type"),
        F.col("item.filename_in_form").alias("file_name"),
    )


def explode_json_items(requests: DataFrame, column: str = "input_items", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same for items given as JSON text, with ``shape_error`` for what is no list or no object.

    A value that is no list gives one row of its own.
    """
    given = requests.filter(F.col(column).isNotNull()).select(
        "request_id",
        *carry,
        F.lower("api_class").alias("policy_name"),
        F.explode(F.array(F.try_parse_json(column))).alias("_json"),
    )
    is_list = F.coalesce(F.schema_of_variant("_json").startswith("ARRAY"), F.lit(False))
    elements = F.when(is_list, F.col("_json").cast("array<variant>")).otherwise(F.array(F.col("_json")))
    rows = given.select(
        "request_id", *carry, "policy_name", is_list.alias("_is_list"), F.posexplode(elements).alias("item_no", "_item")
    )
    is_object = F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False))
    error = F.when(~F.col("_is_list"), F.lit(NOT_A_LIST)).when(
        ~is_object, F.format_string(NOT_AN_OBJECT, F.col("item_no"))
    )

    def field(name: str) -> Column:
        return F.try_variant_get("_item", f"$.{name}", "string")

    return rows.select(
        "request_id",
        *carry,
        "policy_name",
        "item_no",
        F.coalesce(field("id"), F.concat(F.lit("item_"), F.col("item_no").cast("string"))).alias("item_id"),
        F.coalesce(field("type"), F.lit("unknown_type")).alias("item_type"),
        field("filename_in_form").alias("file_name"),
        error.alias("shape_error"),
    )


def has_json_items(column: Column) -> Column:
    """Whether :func:`explode_json_items` gives rows for the value: anything but null and an empty list."""
    parsed = F.try_parse_json(column)
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    return column.isNotNull() & ~(is_list & F.coalesce(F.size(parsed.cast("array<variant>")) == 0, F.lit(False)))


def rule_of(item_type: Column) -> Column:
    """The rule of the row's policy for an item type; null where it has none."""
    return F.get(F.filter(F.col("_policy.item_rules"), lambda r: r["item_type"] == item_type), F.lit(0))


def match_rules(items: DataFrame, policies: Policies) -> DataFrame:
    """Items with the number of the first rule of their type, ``rule_no``; null where the policy has none."""
    rows = with_policy(items, policies, "policy_name")
    return rows.withColumn("rule_no", rule_of(F.col("item_type"))["rule_no"]).drop("_policy")


def attach_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with the attached file's description. ``files`` is unique on request and name."""
    named = files.select("request_id", "file_name", F.lit(True).alias("has_file"), "description")
    return items.join(named, ["request_id", "file_name"], "left")


def blocked_words(text: Column, words: Column | list[str]) -> Column:
    """The listed words that occur in ``text``, in list order, any case. A list may come from the row itself."""
    if isinstance(words, list):
        return words_found(F.lower(text), words)
    low = F.lower(text)
    return F.filter(words, lambda w: F.contains(low, F.lower(w)))


def listed_words(policies: Policies) -> list[str] | None:
    """All words that the item rules of policies given as a dict block, for :func:`read_descriptions`.

    None if they are too many to look for in every text, or for a table of policies, which may hold any number.
    """
    if isinstance(policies, DataFrame):
        return None
    spark = SparkSession.active()
    rules = policy_table(spark, policies).select(F.explode("item_rules").alias("rule"))
    words = sorted(r["word"] for r in rules.select(F.explode("rule.words").alias("word")).distinct().limit(NATIVE_WORDS + 1).collect())
    return words if len(words) <= NATIVE_WORDS else None


def read_descriptions(files: DataFrame, words: list[str]) -> DataFrame:
    """Files with what :func:`item_messages` asks of a description in its place: ``described`` and ``found_words``."""
    text = F.coalesce(F.col("description"), F.lit(""))
    listed = F.array(*[F.lit(w) for w in words]) if words else no_text()
    read = {"described": text != "", "found_words": F.when(text != "", blocked_words(text, listed))}
    return files.withColumns(read).drop("description")


def _rule_messages(rule: Column, has_class: bool, is_read: bool) -> Column:
    item, name, kind = F.col("item_id"), F.col("file_name"), F.col("item_type")
    no_name = F.coalesce(name, F.lit("")) == ""
    found = F.coalesce(F.col("has_file"), F.lit(False)) & ~no_name
    given = F.col("described") if is_read else F.col("description") != ""
    has_text = found & kind.isin(IMAGE_TYPES) & F.coalesce(given, F.lit(False))
    if is_read:
        hits = F.filter(rule["words"], lambda w: F.array_contains(F.col("found_words"), w))
    else:
        hits = blocked_words(F.col("description"), rule["words"])
    arrays = [
        messages_if(no_name, F.format_string(NO_FILE_NAME, item)),
        messages_if(~no_name & ~found, F.format_string(NO_FILE, name, item)),
        messages_if(found & ~kind.isin(IMAGE_TYPES), F.format_string(NOT_SUPPORTED, kind)),
    ]
    if has_class:
        denied = rule["class_check"] & has_text & F.array_contains(rule["denied"], F.col("description_class"))
        arrays.append(messages_if(denied, F.format_string(DERIVED_CLASS, item, F.col("description_class"))))
    arrays.append(
        messages_if(has_text & (F.size(hits) > 0), F.format_string(DERIVED_WORDS, item, F.array_join(hits, ", ")))
    )
    return F.when(rule["required"], joined(arrays)).otherwise(no_text())


def item_messages(items: DataFrame, policies: Policies, strict_reported: bool = True) -> DataFrame:
    """Adds ``violations`` per item. Reads ``has_file``, ``description`` (or what :func:`read_descriptions` made of it)
    and, if there, ``description_class``.

    An item meets the rules of its policy in a join and looks up the one of its type.
    ``strict_reported=False`` reproduces services that note a missing rule but never report it.
    """
    has_class = "description_class" in items.columns
    rows = with_policy(items, policies, "policy_name").withColumn("_rule", rule_of(F.col("item_type")))
    with_rules = F.coalesce(F.size("_policy.item_rules") > 0, F.lit(False))
    chosen = F.when(F.lit(False), no_text())
    if "shape_error" in items.columns:
        # a policy without item rules only looks at the list as a whole
        reported = (F.col("shape_error") == NOT_A_LIST) | with_rules
        chosen = F.when(F.col("shape_error").isNotNull() & reported, F.array("shape_error")).when(
            F.col("shape_error").isNotNull(), no_text()
        )
    is_read = "found_words" in items.columns
    chosen = chosen.when(F.col("_rule").isNotNull(), _rule_messages(F.col("_rule"), has_class, is_read))
    if strict_reported:
        missing = F.array(F.format_string(NO_RULE, F.col("item_type")))
        chosen = chosen.when(with_rules & F.col("_policy.strict"), missing)
    if not is_read and "description" not in items.columns:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    return rows.withColumn("violations", chosen.otherwise(no_text())).select(*items.columns, "violations")


def regroup(items: DataFrame) -> DataFrame:
    """Item messages back to one array per request, in item order.

    A group holds the items of one request row, so its size is that row's array.
    """
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "violations")))
    return items.groupBy("request_id").agg(
        F.flatten(F.transform(ordered, lambda x: x["violations"])).alias("item_violations")
    )
