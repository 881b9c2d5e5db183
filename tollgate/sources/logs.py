"""Invocation logs, use-case registries, audit and action logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVOCATION_SCHEMA = (
    "struct<log_entry_id string, system_breadcrumb_id string, mcp_handshake_schema string,"
    " transaction struct<id string, timestamp timestamp, user struct<id string, roles array<string>>>,"
    " tool struct<name string, version string, sensitivity string, parameters_hash string,"
    "  target_api struct<name string, operation string>>,"
    " authentication struct<session_token string, ephemeral_token string, expiry timestamp,"
    "  token_state struct<consumed boolean, consumption_timestamp timestamp>>,"
    " validation struct<status string, timestamp timestamp, checks_performed array<string>,"
    "  tier_level string, reason string>,"
    " audit struct<request_ip string, client_id string, integration_id string,"
    "  receipt struct<transaction_proof string, timestamp timestamp>>,"
    " error_handling struct<status_code int, error_type string, message string, retry_allowed boolean>>"
)

REGISTRY_SCHEMA = (
    "struct<use_case_id string, use_case_name string, overall_mcp_data_classification string,"
    " tools_and_actions array<struct<tool_system_id string, tool_system_name string, actions array<struct<"
    " action_name string, data_elements_processed array<string>, mcp_classification_attested_by_user string,"
    " mcp_classification_verified string, mcp_handshake_extensions_required array<string>>>>>>"
)


def parse_invocations(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines (JSON text) to the nested columns of an invocation; works on streams."""
    return lines.select(F.from_json(column, INVOCATION_SCHEMA).alias("entry")).select("entry.*")


def tool_and_action(name: Column) -> tuple[Column, Column]:
    """The parts of a logged name ``tool/action``; the action is null without a slash."""
    cut = F.locate("/", name)
    action = F.when(cut > 0, F.substr(name, cut + 1))
    return F.when(cut > 0, F.substr(name, F.lit(1), cut - 1)).otherwise(name), action


def read_invocations(spark: SparkSession, path: str) -> DataFrame:
    return parse_invocations(spark.read.text(path))


def parse_registry(documents: DataFrame, column: str = "value") -> DataFrame:
    """Registry documents (JSON text), one row per use case."""
    return documents.select(F.from_json(column, REGISTRY_SCHEMA).alias("entry")).select("entry.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path, wholetext=True))


def registry_actions(registry: DataFrame) -> DataFrame:
    """One row per registered action."""
    tools = registry.select(
        F.col("use_case_id").alias("use_case"), "overall_mcp_data_classification", F.inline("tools_and_actions")
    )
    return tools.select(
        "use_case",
        F.col("tool_system_id").alias("tool"),
        F.inline("actions"),
    ).select(
        "use_case",
        "tool",
        F.col("action_name").alias("action"),
        F.col("mcp_classification_attested_by_user").alias("attested"),
        F.col("mcp_classification_verified").alias("verified"),
        F.col("mcp_handshake_extensions_required").alias("required"),
    )


# --- audit log ----------------------------------------------------------------------------


def audit_entries(changes: DataFrame) -> DataFrame:
    """Entries for accepted changes: ``(timestamp, schema_type, author, change)``, the change as JSON text."""
    return changes.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "schema_type",
        "author",
        F.col("body").alias("change"),
    )


def append_audit(entries: DataFrame, path: str) -> None:
    """JSON lines in one folder per schema type."""
    entries.write.mode("append").partitionBy("schema_type").json(path)


def read_audit(spark: SparkSession, path: str, schema_type: str | None = None) -> DataFrame:
    """The audit log, for one schema type if given; empty when nothing was written yet."""
    schema = "timestamp string, author string, change string, schema_type string"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    if not exists:
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).json(path)
    return log if schema_type is None else log.filter(F.col("schema_type") == schema_type)


# --- action log -----------------------------------------------------------------------------


def action_log_view(log: DataFrame) -> DataFrame:
    """Newest first, with the time as text."""
    return log.orderBy(F.desc("timestamp")).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    )
