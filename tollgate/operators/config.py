"""Configuration changes: authorisation, validation, schema evolution, history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.text import no_text
from tollgate.operators.ordered import carried_forward, numbered
from tollgate.session import cut_lineage, fits, small_side, small_table

# The base schemas, the role and the author prefix of each schema type.
STAMPS = ["author", "timestamp"]
BASE_SCHEMAS: dict[str, dict] = {
    "enterprise": {
        "required": ["name", "targetMetric", "dataClassification", "quickAlertHeuristic", "reason"],
        "properties": {
            "name": {"type": "string"},
            "targetMetric": {"type": "string"},
            "dataClassification": {"type": "string", "enum": ["Public", "Internal", "Confidential", "Restricted"]},
            "quickAlertHeuristic": {
                "type": "object",
                "required": ["threshold", "window"],
                "properties": {"threshold": {"type": "number"}, "window": {"type": "string"}},
            },
            "reason": {"type": "string"},
        },
    },
    "runtime": {
        "required": ["modelVersion", "validationParameters", "reason"],
        "properties": {
            "modelVersion": {"type": "string"},
            "validationParameters": {"type": "object"},
            "reason": {"type": "string"},
        },
    },
    "integration": {
        "required": ["customThresholds", "businessMetric", "reason"],
        "properties": {
            "customThresholds": {"type": "object", "values": "number"},
            "businessMetric": {"type": "string"},
            "reason": {"type": "string"},
        },
    },
}
ROLES = {"enterprise": "enterprise", "runtime": "lob-it", "integration": "app-team"}
AUTHOR_PREFIX = {"enterprise": "enterprise", "runtime": "lob", "integration": "app"}
DENIED = {
    "enterprise": "Enterprise access required",
    "runtime": "LOB IT access required",
    "integration": "App team access required",
}
INVALID_TOKEN = "Invalid token"
# Type names of parsed JSON; all other types are numbers.
JSON_NAMES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _per_type(values: Mapping[str, str]) -> Column:
    chosen = None
    for schema_type, value in values.items():
        here = F.col("schema_type") == schema_type
        chosen = F.when(here, value) if chosen is None else chosen.when(here, value)
    return chosen


def authorise(changes: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds ``role``, ``author``, ``status_code`` (200, 401, 403) and ``detail``.

    ``roles`` holds ``(token, role)`` and comes from the caller.
    """
    known = changes.join(small_side(roles), "token", "left")
    status = (
        F.when(F.col("role").isNull(), 401).when(F.col("role") != _per_type(ROLES), 403).otherwise(200)
    )
    detail = F.when(F.col("role").isNull(), F.lit(INVALID_TOKEN)).when(
        F.col("role") != _per_type(ROLES), _per_type(DENIED)
    )
    return known.withColumns(
        {
            "status_code": status,
            "detail": detail,
            "author": F.concat_ws("-", _per_type(AUTHOR_PREFIX), F.col("role")),
        }
    )


def json_type(value: Column) -> Column:
    """JSON type name of a variant; null for an absent one."""
    first = F.regexp_extract(F.schema_of_variant(value), "^\\w+", 0)
    names = F.create_map(*[F.lit(x) for pair in JSON_NAMES.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(names[first], F.lit("number")))


def _missing(path: str) -> str:
    return f"Required field '{path}' missing"


def _wrong_type(path: str, expected: str) -> str:
    return f"Field '{path}' is not of type '{expected}'"


def _paths(schema: Mapping, prefix: str = "") -> list[str]:
    """Dotted paths of all fields a schema names."""
    found = []
    for name in dict.fromkeys([*schema.get("required", []), *schema.get("properties", {})]):
        rule = schema.get("properties", {}).get(name, {})
        found.append(prefix + name)
        found.extend(_paths(rule, f"{prefix}{name}."))
    return found


def _errors_at(schema: Mapping, kinds: Mapping[str, Column], prefix: str = "") -> list[Column]:
    """One nullable message column per check; ``kinds`` gives the JSON type found at a path."""
    messages = [
        F.when(kinds[prefix + name].isNull(), F.lit(_missing(prefix + name))) for name in schema.get("required", [])
    ]
    for name, rule in schema.get("properties", {}).items():
        path = prefix + name
        kind = kinds[path]
        messages.append(F.when(kind != rule["type"], F.lit(_wrong_type(path, rule["type"]))))
        if "enum" in rule:
            text = F.try_variant_get("_body", f"$.{path}", "string")
            wrong = (kind == "string") & ~text.isin(rule["enum"])
            messages.append(F.when(wrong, F.lit(f"Field '{path}' is not one of the allowed values")))
        inner = _errors_at(rule, kinds, f"{path}.")
        messages.extend(F.when(kind == "object", m) for m in inner)
    return messages


def _map_value_errors(schema: Mapping, kinds: Mapping[str, Column]) -> list[Column]:
    """An array of messages per field that is a map with values of one type."""
    arrays = []
    for name, rule in schema.get("properties", {}).items():
        if "values" not in rule:
            continue
        given = F.when(kinds[name] == "object", F.try_variant_get("_body", f"$.{name}", "variant"))
        entries = F.map_entries(given.cast("map<string,variant>"))
        wrong = F.filter(entries, lambda e: json_type(e["value"]) != rule["values"])
        told = F.transform(wrong, lambda e: F.format_string(_wrong_type(f"{name}.%s", rule["values"]), e["key"]))
        arrays.append(F.coalesce(told, no_text()))
    return arrays


def validate_bodies(changes: DataFrame, schemas: Mapping[str, Mapping] = BASE_SCHEMAS) -> DataFrame:
    """Adds ``errors`` for the base schema of each change's type. Works on streams.

    The body is parsed once, the type at each path is looked up once, and the
    checks compare those types.
    """
    paths = list(dict.fromkeys(p for schema in schemas.values() for p in _paths(schema)))
    # As generator output the parsed values stay where they are: a filter on
    # ``errors`` would otherwise be pushed down with a copy of the parse per check.
    parsed = changes.select(*changes.columns, F.explode(F.array(F.try_parse_json("body"))).alias("_body"))
    looked_up = [json_type(F.col("_body")).alias("_kind")] + [
        json_type(F.try_variant_get("_body", f"$.{path}", "variant")).alias(f"_kind_{n}") for n, path in enumerate(paths)
    ]
    typed = parsed.select(*changes.columns, "_body", F.inline(F.array(F.struct(*looked_up))))
    kinds = {path: F.col(f"_kind_{n}") for n, path in enumerate(paths)}
    chosen = F.when(
        ~F.coalesce(F.col("_kind") == "object", F.lit(False)), F.array(F.lit("Body is not a JSON object"))
    )
    for schema_type, schema in schemas.items():
        found = F.concat(
            F.array_compact(F.array(*_errors_at(schema, kinds))), *_map_value_errors(schema, kinds)
        )
        chosen = chosen.when(F.col("schema_type") == schema_type, found)
    errors = chosen.otherwise(F.array(F.lit("Unknown schema type")))
    return typed.select(*changes.columns, errors.alias("errors"))


def body_fields(changes: DataFrame) -> DataFrame:
    """One row per top-level field of a valid body: ``field``, ``value`` (JSON text), ``json_type``."""
    entries = F.map_entries(F.try_parse_json("body").cast("map<string,variant>"))
    rows = changes.select(*[c for c in changes.columns if c != "body"], F.explode(entries).alias("_entry"))
    return rows.withColumns(
        {
            "field": F.col("_entry.key"),
            "value": F.to_json(F.col("_entry.value")),
            "json_type": json_type(F.col("_entry.value")),
        }
    ).drop("_entry")


def _is_new_field(schemas: Mapping[str, Mapping]) -> Column:
    known = F.lit(False)
    for schema_type, schema in schemas.items():
        names = [*schema["properties"], *STAMPS]
        known = known | ((F.col("schema_type") == schema_type) & F.col("field").isin(names))
    return ~known


def _settled_types(rows: DataFrame) -> DataFrame:
    """Type, time and change that first recorded each added field.

    A field is recorded by the first change that is not refused, and a change is refused
    if any of its fields has another type than the recorded one: as if the changes came
    one by one. Only fields that occur with several types can refuse a change, so only those
    are settled in order; what is left of the changes then settles all other fields in one aggregate.
    """
    key, change = ["schema_type", "field"], ["schema_type", "ts", "change_id"]
    kinds = rows.groupBy(*key).agg(F.min("json_type").alias("one"), F.max("json_type").alias("other"))
    disputed = cut_lineage(kinds.filter("one <> other").select(*key))
    if disputed.isEmpty():
        return _first_of(rows)
    few = small_side(disputed)
    settled, refused = _settled_in_order(rows.join(few, key, "left_semi").select(*change, "field", "json_type"))
    clear = rows.join(few, key, "left_anti").join(small_side(refused), change, "left_anti")
    return settled.unionByName(_first_of(clear))


def _first_of(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("schema_type", "field").agg(F.min(F.struct("ts", "change_id", "json_type")).alias("first"))
    return first.select("schema_type", "field", F.col("first.json_type").alias("recorded_type"), F.col("first.ts").alias("first_ts"), F.col("first.change_id").alias("first_change"))


def _settled_in_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The recorded types of disputed fields, and the changes that they refuse.

    A round refuses what contradicts the recorded types, then accepts every open change
    that is the earliest open one for all its unrecorded fields. The earliest open change
    always is, so each round records a field, and fields that no change ties together are recorded in the same round.
    """
    key, change = ["schema_type", "field"], ["schema_type", "ts", "change_id"]
    settled = _first_of(rows.limit(0))
    open_rows = rows
    while True:
        known = open_rows.join(settled, key, "left")
        refused = known.filter(F.col("recorded_type") != F.col("json_type")).select(*change).distinct()
        left = cut_lineage(known.filter("recorded_type IS NULL").join(refused, change, "left_anti").select(*change, "field", "json_type"))
        earliest = left.groupBy(*key).agg(F.min(F.struct("ts", "change_id")).alias("first"))
        marked = left.join(earliest, key).withColumn("is_first", F.struct("ts", "change_id") == F.col("first"))
        ready = marked.groupBy(*change).agg(F.bool_and("is_first").alias("ready")).filter("ready").drop("ready")
        new = left.join(ready, change).select(
            *key, F.col("json_type").alias("recorded_type"), F.col("ts").alias("first_ts"), F.col("change_id").alias("first_change")
        )
        new = cut_lineage(new.dropDuplicates(key))
        if new.isEmpty():
            against = rows.join(settled, key).filter(F.col("recorded_type") != F.col("json_type"))
            return settled, cut_lineage(against.select(*change).distinct())
        settled, open_rows = settled.unionByName(new), left


def _added(valid_changes: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    return cut_lineage(body_fields(valid_changes).filter(_is_new_field(schemas)))


def new_fields(valid_changes: DataFrame, schemas: Mapping[str, Mapping] = BASE_SCHEMAS) -> DataFrame:
    """Fields that changes added to their schema, with the type and the change that recorded them."""
    return _settled_types(_added(valid_changes, schemas)).select(
        "schema_type", "field", F.col("recorded_type").alias("json_type"), "first_change"
    )


def type_conflicts(valid_changes: DataFrame, schemas: Mapping[str, Mapping] = BASE_SCHEMAS) -> DataFrame:
    """Fields given with another type than the one recorded for them before."""
    rows = _added(valid_changes, schemas)
    later = F.struct("ts", "change_id") > F.struct("first_ts", "first_change")
    return rows.join(_settled_types(rows), ["schema_type", "field"]).filter(
        later & (F.col("json_type") != F.col("recorded_type"))
    )


def apply_changes(changes: DataFrame, roles: DataFrame, schemas: Mapping[str, Mapping] = BASE_SCHEMAS) -> DataFrame:
    """The decision on every change: ``status_code`` 200, 400, 401 or 403 and its ``detail``.

    The first change that names a new field and is not refused fixes that field's type.
    """
    checked = validate_bodies(authorise(changes, roles), schemas)
    status = F.when(F.col("status_code") != 200, F.col("status_code")).when(F.size("errors") > 0, 400).otherwise(200)
    detail = F.coalesce("detail", F.when(F.size("errors") > 0, F.array_join("errors", "; ")))
    # Several jobs below read the checked changes; parse and check them once.
    judged = cut_lineage(checked.withColumns({"status_code": status, "detail": detail}))
    clashes = (
        type_conflicts(judged.filter("status_code = 200"), schemas)
        .groupBy("change_id")
        .agg(F.min(F.concat(F.lit("Field '"), "field", F.lit("' is not of type '"), "recorded_type", F.lit("'"))).alias("clash"))
    )
    joined = judged.join(clashes, "change_id", "left")
    return joined.withColumns(
        {
            "status_code": F.when(F.col("clash").isNotNull(), 400).otherwise(F.col("status_code")),
            "detail": F.coalesce("detail", "clash"),
        }
    ).drop("clash")


def history(accepted: DataFrame, **limits) -> DataFrame:
    """Version number of every accepted value of a field, from 1."""
    rows = body_fields(accepted)
    return numbered(rows, ["schema_type", "field"], ["ts", "change_id"], "version", **limits)


def latest(accepted: DataFrame) -> DataFrame:
    """Current value of every field."""
    last = F.max(F.struct("ts", "change_id", "value"))
    return (
        body_fields(accepted)
        .groupBy("schema_type", "field")
        .agg(last.alias("last"))
        .select("schema_type", "field", F.col("last.value").alias("value"), F.col("last.change_id").alias("change_id"))
    )


def incompatible_history(accepted: DataFrame) -> DataFrame:
    """Earlier changes the newest schema would refuse: fields whose newest type differs."""
    rows = body_fields(accepted)
    newest = (
        rows.groupBy("schema_type", "field")
        .agg(F.max(F.struct("ts", "change_id", "json_type")).alias("last"))
        .select("schema_type", "field", F.col("last.json_type").alias("newest_type"))
    )
    return rows.join(small_table(newest), ["schema_type", "field"]).filter(F.col("json_type") != F.col("newest_type"))


def in_force(metrics: DataFrame, versions: DataFrame, key: str, value: str, max_versions: int = 200_000, **limits) -> DataFrame:
    """Each metric row with the configuration value in force at its time.

    ``metrics`` holds ``(key, ts, row_id, ...)``, ``versions`` ``(key, ts, version_id, value)``. A version counts from
    its own instant on; a version without a value changes nothing. Up to ``max_versions`` versions (measured, and
    64 MB) are broadcast as one sorted array per key and searched by bisection in the metric's row, which
    is not shuffled. More of them are put in time order with the metrics, in pieces that split a hot key.
    """
    known = versions.filter(F.col(value).isNotNull()).select(key, "ts", "version_id", value)
    if fits(known, max_versions):
        return _in_force_by_bisection(metrics, known, key, value)
    m = metrics.select(
        *metrics.columns, F.lit(1).alias("_side"), F.col("row_id").alias("_tie"), F.lit(None).cast(dict(versions.dtypes)[value]).alias(value)
    )
    v = known.select(key, "ts", F.lit(0).alias("_side"), F.col("version_id").alias("_tie"), value)
    both = m.unionByName(v, allowMissingColumns=True)
    filled = carried_forward(both, [key], ["ts", "_side", "_tie"], [value], **limits)
    return filled.filter("_side = 1").drop("_side", "_tie")


def _in_force_by_bisection(metrics: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "version_id", F.col(value).alias("value"))))
    # a group holds versions of one key, of a table that was measured to be small
    listed = known.groupBy(F.col(key).alias("_key")).agg(F.transform(ordered, lambda v: v["ts"]).alias("_from"), F.transform(ordered, lambda v: v["value"]).alias("_values"))
    met = metrics.join(F.broadcast(listed), metrics[key].eqNullSafe(F.col("_key")), "left")

    def halve(state: Column, _: Column) -> Column:
        """Versions before ``low`` have begun, those from ``high`` on have not."""
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        begun = F.coalesce(F.get("_from", middle) <= F.col("ts"), F.get("_from", middle).isNull())
        searched = state["low"] >= state["high"]
        return F.struct(
            F.when(~searched & begun, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(~searched & ~begun, middle).otherwise(state["high"]).alias("high"),
        )

    size = F.coalesce(F.size("_from"), F.lit(0))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])
    place = F.when(size > 0, found - 1)
    return met.select(*metrics.columns, F.get("_values", place).alias(value))
