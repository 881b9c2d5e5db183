"""Second-line checks of invocation logs against the use-case registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.text import words_found
from tollgate.operators.ordered import over_order
from tollgate.session import small_table

# Class names by number, tools with a known class, and what a class requires.
CLASS_NAMES = {
    1: "Class1_PII",
    2: "Class2_SensitivePersonalData",
    3: "Class3_ConfidentialPersonalData",
    4: "Class4_InternalData",
    5: "Class5_PublicData",
}
TOOL_CLASSES = {
    "create_payment_method": 1,
    "update_customer_payment": 1,
    "send_money": 2,
    "refund_transaction": 2,
    "create_invoice": 3,
    "process_payment": 3,
    "list_transactions": 4,
    "get_account_balance": 4,
    "get_exchange_rate": 5,
}
EXTENSIONS = {
    1: ["TransactionBoundTokens", "AtomicTokenConsumption", "DualAgentValidation"],
    2: ["TransactionBoundTokens", "AtomicTokenConsumption", "DualAgentValidation"],
    3: ["TransactionBoundTokens", "AtomicTokenConsumption"],
    4: [],
    5: [],
}


def class_name(number: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    return names[number.cast("int")]


def class_number(name: Column) -> Column:
    """The number inside a full class label."""
    return F.regexp_extract(name, "^Class\\s?(\\d)", 1).cast("int")


def required_extensions(number: Column) -> Column:
    chosen = None
    for cls, names in EXTENSIONS.items():
        listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        chosen = F.when(number == cls, listed) if chosen is None else chosen.when(number == cls, listed)
    return chosen


def tier_columns(number: Column, performed: Column) -> dict[str, Column]:
    """Flow and missing checks for a class."""
    return {
        "two_phase": number <= 3,
        "confirmation": number <= 2,
        "missing": F.array_except(required_extensions(number), performed),
    }


def tool_class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOOL_CLASSES.items()), "tool_name string, class_no int")


def lookup_tool_class(calls: DataFrame, spark: SparkSession) -> DataFrame:
    """Calls with their tool's class and its extensions; the table is a fixed list."""
    known = tool_class_table(spark).withColumn("required", required_extensions(F.col("class_no")))
    return calls.join(F.broadcast(known), "tool_name", "left")


def missing_breadcrumbs(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Invocations whose breadcrumb no use case has."""
    return log.join(small_table(registered.select("breadcrumb").distinct()), "breadcrumb", "left_anti")


def wrong_breadcrumbs(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Invocations whose breadcrumb is not the one registered for their use case."""
    known = small_table(registered.select("use_case", F.col("breadcrumb").alias("registered_breadcrumb")))
    return log.join(known, "use_case").filter(
        F.col("breadcrumb").isNotNull() & (F.col("breadcrumb") != F.col("registered_breadcrumb"))
    )


def breadcrumb_findings(log: DataFrame, registered: DataFrame) -> DataFrame:
    """``finding`` per invocation: missing, mismatch or ok. Static side joined to a batch or a stream."""
    known = registered.select("use_case", F.col("breadcrumb").alias("registered_breadcrumb"))
    finding = (
        F.when(F.col("breadcrumb").isNull(), "missing")
        .when(F.col("registered_breadcrumb").isNull(), "unregistered")
        .when(F.col("breadcrumb") != F.col("registered_breadcrumb"), "mismatch")
        .otherwise("ok")
    )
    return log.join(known, "use_case", "left").withColumn("finding", finding)


def sensitivity_drift(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Invocations of unregistered actions or with another class than the verified one.

    An action is known by use case, tool and name: actions of one tool differ in class.
    """
    known = small_table(actions.select("use_case", "tool", "action", F.col("class_no").alias("verified_class")))
    finding = F.when(F.col("verified_class").isNull(), "unregistered action").when(
        F.col("verified_class") != F.col("class_no"), "sensitivity drift"
    )
    return log.join(known, ["use_case", "tool", "action"], "left").withColumn("finding", finding).filter("finding IS NOT NULL")


def missing_extensions(log: DataFrame, performed: str = "performed") -> DataFrame:
    """One row per required extension that was not performed."""
    left = F.array_except(required_extensions(F.col("class_no")), F.col(performed))
    return log.withColumn("extension", F.explode(left))


def overall_class(actions: DataFrame) -> DataFrame:
    """Most sensitive verified class per use case."""
    return actions.groupBy("use_case").agg(
        F.min("class_no").alias("class_no"), F.min_by("verified", "class_no").alias("label")
    )


def attestation_gap(actions: DataFrame) -> DataFrame:
    different = F.count_if(F.col("attested") != F.col("verified"))
    return actions.groupBy("use_case").agg(
        F.count("*").alias("actions"), different.alias("different"), (different / F.count("*")).alias("gap")
    )


def high_risk(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("class_no") <= 2)


def log_gaps(log: DataFrame, key: str, order: list[str], limit_seconds: int, **limits) -> DataFrame:
    """Silences longer than the limit between two entries of one deployment."""

    def previous(rows, window):
        return rows.withColumn("previous_ts", F.lag("ts").over(window))

    seconds = (F.unix_micros("ts") - F.unix_micros("previous_ts")) / 1e6
    return (
        over_order(log, [key], order, previous, before=1, **limits)
        .withColumn("gap_seconds", seconds)
        .filter(F.col("gap_seconds") > limit_seconds)
    )


def hash_sample(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """A reproducible sample: the same ids on every run and every cluster."""
    number = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return df.filter(number % one_in == 0)


def matched_patterns(df: DataFrame, text: str, patterns: list[str], name: str = "pattern") -> DataFrame:
    """One row per known pattern (any case) that occurs in the whole text.

    Patterns are configuration: a native expression, or for long lists one automaton; there is no join.
    """
    return df.withColumn(name, F.explode(words_found(F.lower(F.col(text)), patterns)))
