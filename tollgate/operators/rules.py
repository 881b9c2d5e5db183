"""Policy rules as data, and the native expressions that interpret them.

A policy's rules are compiled to an array of small structs, one per check. Requests
meet their policy's array in a join, and a higher-order function turns it into an array
of violation messages, so the generated code does not grow with the number of policies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.text import messages_if, no_text, two_decimals

# Message texts that callers match on.
TOO_LONG = "Field '%s' (length %d) exceeds maximum length of %d characters."
MISSING = "Required field '{}' is missing or empty."
BAD_FORMAT = "Field '{}' does not match required format pattern."
BAD_PATTERN = "Invalid regex pattern in 'format_validation' for field '{}': {}"
BAD_RULE = "Invalid '{}' rule config at index {}."
NOT_AN_OBJECT = "Custom rule at index {} is not a valid object."
NOT_A_LIST = "Invalid 'custom_validation_rules' format in policy."
IO_FAILED = "ModernBERT I/O validation failed (validity score: %s)."
CLASS_DENIED = "{} text classified as disallowed sensitivity: '%s'."
CLASS_NOT_ALLOWED = "{} text sensitivity class '%s' not in allowed list."


def is_falsy(col: Column, dtype: T.DataType) -> Column:
    """Null, empty text, zero, false and empty collections count as missing."""
    if isinstance(dtype, T.StringType):
        empty = col == ""
    elif isinstance(dtype, T.BooleanType):
        empty = ~col
    elif isinstance(dtype, T.NumericType):
        empty = col == 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        empty = F.size(col) == 0
    else:
        empty = F.lit(False)
    return col.isNull() | empty


def as_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("True")).otherwise(F.lit("False"))
    return col.cast("string")


def rule_errors(rule: object, index: int) -> str | None:
    """The message for a rule of the wrong shape, else None."""
    if not isinstance(rule, Mapping):
        return NOT_AN_OBJECT.format(index)
    kind = rule.get("type")
    if kind == "text_length_limit":
        shaped = isinstance(rule.get("max_length"), int) and isinstance(rule.get("text_fields", []), list)
    elif kind == "required_fields":
        shaped = isinstance(rule.get("fields", []), list)
    elif kind == "format_validation":
        shaped = bool(rule.get("field")) and bool(rule.get("pattern"))
    else:
        shaped = True
    return None if shaped else BAD_RULE.format(kind, index)


#: One entry per check of a policy; ``message`` is said as it stands by ``error`` and ``bad_format``.
RULE = "struct<kind string, field string, max_length bigint, pattern string, message string>"


def pattern_error(pattern: object) -> str | None:
    """Why a pattern cannot be used, in the words of the regular expression compiler; None if it can."""
    try:
        re.compile(pattern)
    except re.error as bad:
        return str(bad)
    return None


def _in_jvm(pattern: Column) -> Column:
    """A pattern in the JVM's spelling of named groups, their back references and the end of the text."""
    named = F.regexp_replace(F.regexp_replace(pattern, r"\(\?P<", "(?<"), r"\(\?P=([A-Za-z0-9]+)\)", r"\\k<$1>")
    return F.regexp_replace(named, r"(?<!\\)((?:\\\\)*)\\Z", r"$1\\z")


def compiled_rules(policy: Column, errors: Column) -> Column:
    """The checks of ``custom_validation_rules`` of a policy (a variant), in order, as an array of :data:`RULE`.

    ``errors`` maps patterns that cannot be used to their error. Rules of a wrong shape become their message.
    """

    def entry(kind: str, name: Column | None = None, limit: Column | None = None, pattern: Column | None = None, message: Column | None = None) -> Column:
        text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        parts = {
            "kind": F.lit(kind),
            "field": text if name is None else name,
            "max_length": number if limit is None else limit,
            "pattern": text if pattern is None else pattern,
            "message": text if message is None else message,
        }
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    def part(rule: Column, name: str, kind: str = "variant") -> Column:
        return F.try_variant_get(rule, f"$.{name}", kind)

    def names(rule: Column, key: str) -> Column:
        """The listed names; empty without the key, null if it holds no list."""
        kind = F.schema_of_variant(part(rule, key))
        listed = F.array_compact(F.coalesce(part(rule, key, "array<string>"), no_text()))
        return F.when(kind.isNull(), no_text()).when(kind.startswith("ARRAY"), listed)

    def one(rule: Column, index: Column) -> Column:
        kind = part(rule, "type", "string")
        limit, limit_kind = part(rule, "max_length", "bigint"), F.schema_of_variant(part(rule, "max_length"))
        name, pattern = part(rule, "field", "string"), part(rule, "pattern", "string")
        wrong = F.array(entry("error", message=F.format_string(BAD_RULE.replace("{}", "%s"), kind, index)))
        whole_number = F.coalesce(limit_kind.isin("BIGINT", "BOOLEAN"), F.lit(False))
        lengths = F.transform(names(rule, "text_fields"), lambda n: entry("length", n, limit))
        required = F.transform(names(rule, "fields"), lambda n: entry("required", n, message=F.format_string(MISSING.replace("{}", "%s"), n)))
        error = errors[pattern]
        shaped = F.coalesce((F.length(name) > 0) & (F.length(pattern) > 0), F.lit(False))
        checked = F.when(
            error.isNotNull(), F.array(entry("bad_format", name, message=F.format_string(BAD_PATTERN.replace("{}", "%s"), name, error)))
        ).otherwise(F.array(entry("format", name, pattern=F.concat(F.lit("\\A(?:"), _in_jvm(pattern), F.lit(")")), message=F.format_string(BAD_FORMAT.replace("{}", "%s"), name))))
        return (
            F.when(~F.coalesce(F.schema_of_variant(rule).startswith("OBJECT"), F.lit(False)), F.array(entry("error", message=F.format_string(NOT_AN_OBJECT.replace("{}", "%s"), index))))
            .when(kind == "text_length_limit", F.when(whole_number, F.coalesce(lengths, wrong)).otherwise(wrong))
            .when(kind == "required_fields", F.coalesce(required, wrong))
            .when(kind == "format_validation", F.when(shaped, checked).otherwise(wrong))
            .otherwise(F.array().cast(f"array<{RULE}>"))
        )

    kind = F.schema_of_variant(part(policy, "custom_validation_rules"))
    listed = part(policy, "custom_validation_rules", "array<variant>")
    found = (
        F.when(kind.isNull(), F.array().cast(f"array<{RULE}>"))
        .when(~kind.startswith("ARRAY"), F.array(entry("error", message=F.lit(NOT_A_LIST))))
        .otherwise(F.flatten(F.transform(listed, one)))
    )
    return found.cast(f"array<{RULE}>")


def rule_messages(rules: Column, df: DataFrame) -> Column:
    """The messages of an array of :data:`RULE` on a row of ``df``, in rule order.

    Rules are data: each looks its field up by name, once, and only that field is turned into text.
    The work of a row is that of its policy's rules, however many policies there are.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    given = [n for n in types if not n.startswith("_")]
    shape = "struct<text:string,missing:boolean,limited:boolean>"

    def value(col: Column, dtype: T.DataType) -> Column:
        limited = F.lit(isinstance(dtype, T.StringType))
        text = F.lit(None).cast("string") if isinstance(dtype, (T.StructType, T.VariantType)) else as_text(col, dtype)
        return F.struct(text.alias("text"), is_falsy(col, dtype).alias("missing"), limited.alias("limited")).cast(shape)

    extra = types.get("extra")

    def field(name: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None).cast(shape))
        for n in given:
            found = found.when(name == n, value(F.col(f"`{n}`"), types[n]))
        return found.otherwise(value(F.col("extra")[name], extra.valueType)) if isinstance(extra, T.MapType) else found

    def message(looked_up: Column) -> Column:
        rule, here = looked_up["rule"], looked_up["here"]
        too_long = here["limited"] & (F.length(here["text"]) > rule["max_length"])
        return (
            F.when(rule["kind"] == "error", rule["message"])
            .when((rule["kind"] == "length") & too_long, F.format_string(TOO_LONG, rule["field"], F.length(here["text"]), rule["max_length"]))
            .when((rule["kind"] == "required") & F.coalesce(here["missing"], F.lit(True)), rule["message"])
            .when((rule["kind"] == "format") & ~F.rlike(here["text"], rule["pattern"]), rule["message"])
            .when((rule["kind"] == "bad_format") & here["text"].isNotNull(), rule["message"])
        )

    # a step of its own: an expression that stands in several places of a lambda is worked out in each
    looked_up = F.transform(rules, lambda r: F.struct(r.alias("rule"), field(r["field"]).alias("here")))
    return F.array_compact(F.transform(looked_up, message))


def bad_patterns(policies: Iterable[Mapping]) -> Column:
    """Patterns of policies held by the driver that cannot be used, with their errors."""
    found = {}
    for policy in policies:
        rules = policy.get("custom_validation_rules")
        for rule in rules if isinstance(rules, list) else []:
            pattern = rule.get("pattern") if isinstance(rule, Mapping) else None
            if isinstance(pattern, str) and pattern_error(pattern):
                found[pattern] = pattern_error(pattern)
    if not found:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in found.items() for x in pair])


def custom_rule_messages(policy: Mapping, df: DataFrame) -> Column:
    """Messages of the ``custom_validation_rules`` of one policy on each row, in rule order."""
    return rule_messages(compiled_rules(F.parse_json(F.lit(json.dumps(policy))), bad_patterns([policy])), df)


def joined(arrays: list[Column]) -> Column:
    if not arrays:
        return no_text()
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def class_list_messages(side: str, text: Column, predicted: Column, denied: Column, allowed: Column) -> Column:
    """Deny-list and allow-list (arrays; empty lists say nothing) of predicted classes; both may report."""
    title = side.capitalize()
    ran = F.coalesce(text, F.lit("")) != ""
    return F.concat(
        messages_if(ran & F.array_contains(denied, predicted), F.format_string(CLASS_DENIED.format(title), predicted)),
        messages_if(
            ran & (F.size(allowed) > 0) & ~F.array_contains(allowed, predicted),
            F.format_string(CLASS_NOT_ALLOWED.format(title), predicted),
        ),
    )


def pair_messages(prediction: Column, probability: Column, input_text: Column, output_text: Column) -> Column:
    """Prediction 0 of the pair classifier, only where one of the texts is given."""
    given = (F.coalesce(input_text, F.lit("")) != "") | (F.coalesce(output_text, F.lit("")) != "")
    return messages_if(given & (prediction == 0), F.format_string(IO_FAILED, two_decimals(probability)))
