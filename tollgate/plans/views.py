"""Tables derived from the given ones, in Spark and (same names) for the check SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.ordered import over_order
from tollgate.plans.catalog import view
from tollgate.session import spread
from tollgate.sources.policies import policy_rows as read_policy_rows


def read_as_utc(spark: SparkSession) -> None:
    """The given timestamps carry no zone; all queries read them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read_as_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant; the session zone is UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: whole texts, so work per row is heavy."""
    return spread(table(spark, sf_dir, "documents"))


# --- requests -------------------------------------------------------------------------

view(
    "io_pairs",
    """SELECT conv_id, turn, text AS input_text,
         CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS output_text
       FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
             FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       WHERE role = 'user'""",
)


def pair_turns(conversations: DataFrame, **limits) -> DataFrame:
    """Each user turn with the answer that follows it directly, else ''."""

    def next_turn(rows, window):
        return rows.withColumns({"next_role": F.lead("role").over(window), "next_text": F.lead("text").over(window)})

    paired = over_order(conversations, ["conv_id"], ["turn"], next_turn, after=1, **limits)
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise(F.lit(""))
    return paired.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("input_text"), answer.alias("output_text")
    )


def io_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_turns(table(spark, sf_dir, "conversations"))


view(
    "requests",
    """SELECT conv_id * 1000 + turn AS request_id, conv_id, turn,
         CASE conv_id % 5 WHEN 0 THEN 'BasicGate' WHEN 1 THEN 'STRICTGATE' WHEN 2 THEN 'MediaGate'
                          WHEN 3 THEN 'NoSuchGate' END AS api_class,
         CASE conv_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'u' || conv_id END AS user_id,
         CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not-an-email'
                          ELSE 'u' || conv_id || '@example.org' END AS user_email,
         input_text, output_text
       FROM io_pairs""",
    "io_pairs",
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(io_pairs(spark, sf_dir))


def as_requests(pairs: DataFrame, *carry: str) -> DataFrame:
    """Requests made of pairs of turns, batch or stream."""
    conv = F.col("conv_id")
    api_class = (
        F.when(conv % 5 == 0, "BasicGate")
        .when(conv % 5 == 1, "STRICTGATE")
        .when(conv % 5 == 2, "MediaGate")
        .when(conv % 5 == 3, "NoSuchGate")
    )
    user = F.concat(F.lit("u"), conv.cast("string"))
    return pairs.select(
        *carry,
        (conv * 1000 + F.col("turn")).alias("request_id"),
        "conv_id",
        "turn",
        api_class.alias("api_class"),
        F.when(conv % 7 == 0, F.lit(None)).when(conv % 7 == 1, "").otherwise(user).alias("user_id"),
        F.when(conv % 4 == 0, F.lit(None))
        .when(conv % 4 == 1, "not-an-email")
        .otherwise(F.concat(user, F.lit("@example.org")))
        .alias("user_email"),
        "input_text",
        "output_text",
    )


EMAIL_PATTERN = r"^[^@ ]+@[^@ ]+[.][a-z]{2,9}$"
IMAGE_WORDS = ["THE", "ouen", "ieren"]

# Sample policies for the queries below.
POLICIES: dict[str, dict] = {
    "BasicGate": {
        "description": "Length limits on both texts of a request.",
        "custom_validation_rules": [
            {"type": "text_length_limit", "max_length": 300, "text_fields": ["input_text", "output_text"]}
        ],
    },
    "StrictGate": {
        "description": "Caller identity and class lists on both texts.",
        "modernbert_io_validation": True,
        "colbert_input_sensitivity": True,
        "colbert_output_sensitivity": True,
        "disallowed_colbert_input_classes": ["Class 1: PII"],
        "allowed_colbert_input_classes": ["Class 3: Internal", "Class 4: Public"],
        "disallowed_colbert_output_classes": ["Class 1: PII", "Class 2: Confidential"],
        "custom_validation_rules": [
            {"type": "required_fields", "fields": ["input_text", "user_id"]},
            {"type": "format_validation", "field": "user_email", "pattern": EMAIL_PATTERN},
        ],
    },
    "MediaGate": {
        "description": "Attached images, their derived text, lengths and identity.",
        "strict_item_type_matching": True,
        "item_processing_rules": [
            {
                "item_type": "image",
                "vlm_processing": {"required": True, "prompt": "Describe sensitive content."},
                "derived_text_checks": {
                    "colbert_sensitivity": True,
                    "disallowed_classes": ["Class 1: PII", "Class 2: Confidential"],
                    "blocked_keywords": IMAGE_WORDS,
                },
            },
            {"item_type": "document", "vlm_processing": {"required": True}},
        ],
        "custom_validation_rules": [
            {"type": "text_length_limit", "max_length": 300, "text_fields": ["input_text", "output_text"]},
            {"type": "required_fields", "fields": ["input_text", "user_id"]},
            {"type": "format_validation", "field": "user_email", "pattern": EMAIL_PATTERN},
        ],
        "documentation_assistance": {
            "enabled": True,
            "index_path": "docs",
            "max_suggestions_per_query": 2,
            "max_total_suggestions": 4,
            "min_similarity_threshold": 0.15,
            "max_help_queries_to_use": 4,
        },
    },
}


def policy_rows(spark: SparkSession) -> DataFrame:
    """The sample policies as a table, read from the text of a policy file."""
    return read_policy_rows(spark.createDataFrame([(json.dumps(POLICIES),)], "value string"))


# --- model results given as data ----------------------------------------------------

view(
    "scored_requests",
    """SELECT *, CASE WHEN length(output_text) = 0 THEN 0.0
                ELSE length(output_text) * 1.0 / (length(input_text) + length(output_text) + 0.37) END AS io_probability,
         CASE (request_id * 7) % 5 WHEN 0 THEN 'Class 1: PII' WHEN 1 THEN 'Class 2: Confidential'
              WHEN 2 THEN 'Class 3: Internal' WHEN 3 THEN 'Class 4: Public' ELSE 'Class 5: Unknown' END AS input_class,
         CASE (length(output_text)) % 5 WHEN 0 THEN 'Class 1: PII' WHEN 1 THEN 'Class 2: Confidential'
              WHEN 2 THEN 'Class 3: Internal' WHEN 3 THEN 'Class 4: Public' ELSE 'Class 5: Unknown' END AS output_class
       FROM requests""",
    "requests",
)

CLASS_LABELS = ["Class 1: PII", "Class 2: Confidential", "Class 3: Internal", "Class 4: Public", "Class 5: Unknown"]


def class_of(number):
    """Label number 0..4 as its text."""
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_LABELS]), (number + 1).cast("int"))


def scored_requests(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    n_in, n_out = F.length("input_text"), F.length("output_text")
    probability = F.when(n_out == 0, 0.0).otherwise(n_out * 1.0 / (n_in + n_out + 0.37))
    return (
        (base or requests(spark, sf_dir))
        .withColumns(
            {
                "io_probability": probability,
                "input_class": class_of((F.col("request_id") * 7) % 5),
                "output_class": class_of(n_out % 5),
            }
        )
        .withColumn("io_prediction", (F.col("io_probability") >= 0.45).cast("int"))
    )


# --- items and files ------------------------------------------------------------------

view(
    "items",
    """SELECT request_id, lower(api_class) AS policy_name, item_no,
         'i' || item_no AS item_id,
         CASE (request_id + item_no) % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' ELSE 'image' END AS item_type,
         CASE WHEN (conv_id + item_no) % 4 = 0 THEN NULL ELSE 'f' || item_no || '.png' END AS file_name
       FROM requests, (VALUES (0), (1)) v(item_no)""",
    "requests",
)


def requests_with_items(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Two items in the array of each request."""

    def item(number: int):
        kind = (F.col("request_id") + number) % 4
        return F.struct(
            F.lit(f"i{number}").alias("id"),
            F.when(kind == 1, "audio").when(kind == 2, "document").otherwise("image").alias("type"),
            F.when((F.col("conv_id") + number) % 4 != 0, F.lit(f"f{number}.png")).alias("filename_in_form"),
        )

    return scored_requests(spark, sf_dir, base).withColumn("items", F.array(item(0), item(1)))


view(
    "files",
    """SELECT r.request_id, 'f' || v.item_no || '.png' AS file_name, r.output_text AS description,
         CASE (r.request_id + v.item_no) % 5 WHEN 0 THEN 'Class 1: PII' WHEN 1 THEN 'Class 2: Confidential'
              WHEN 2 THEN 'Class 3: Internal' WHEN 3 THEN 'Class 4: Public' ELSE 'Class 5: Unknown' END AS description_class
       FROM requests r, (VALUES (0), (1)) v(item_no)
       WHERE NOT (v.item_no = 1 AND r.output_text = '')""",
    "requests",
)


def files(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Attached files with the description an image model gave; no second file for unanswered turns."""
    rows = (base or requests(spark, sf_dir)).withColumn("item_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.filter(~((F.col("item_no") == 1) & (F.col("output_text") == ""))).select(
        "request_id",
        F.concat(F.lit("f"), F.col("item_no").cast("string"), F.lit(".png")).alias("file_name"),
        F.col("output_text").alias("description"),
        class_of((F.col("request_id") + F.col("item_no")) % 5).alias("description_class"),
        *carry,
    )


# --- invocation log ---------------------------------------------------------------------

view(
    "invocations",
    """SELECT event_id AS log_id, ts, user_id, event_type AS tool, CASE WHEN event_id % 4 = 3 THEN 'peek-' ELSE 'run-' END || event_type AS action,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS class_no,
         'uc-' || user_id % 5 AS use_case,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'bad' ELSE sha256('uc-' || user_id % 5) END AS breadcrumb,
         sha256(user_id || '|' || event_type || '|' || event_id % 50) AS token, props AS params, value,
         sha256(props) AS auth_hash, props || CASE WHEN event_id % 11 = 0 THEN 'x' ELSE '' END AS exec_params,
         ts AS auth_ts, ts + to_minutes(event_id % 7) AS exec_ts, ts + to_minutes(5) AS expiry,
         CASE event_id % 3 WHEN 0 THEN ['TransactionBoundTokens', 'AtomicTokenConsumption', 'DualAgentValidation']
              WHEN 1 THEN ['TransactionBoundTokens', 'AtomicTokenConsumption'] ELSE ['TransactionBoundTokens'] END AS performed
       FROM events""",
)


def as_invocations(rows: DataFrame) -> DataFrame:
    """Events (batch or stream) as invocation log entries."""
    eid, kind = F.col("event_id"), F.col("event_type")
    use_case = F.concat(F.lit("uc-"), (F.col("user_id") % 5).cast("string"))
    number = (
        F.when(kind == "signup", 1).when(kind == "purchase", 2).when(kind == "error", 3).when(kind == "click", 4).otherwise(5)
    )
    token_text = F.concat_ws("|", F.col("user_id").cast("string"), kind, (eid % 50).cast("string"))
    checks = ["TransactionBoundTokens", "AtomicTokenConsumption", "DualAgentValidation"]

    def first(n):
        return F.array(*[F.lit(c) for c in checks[:n]])

    return rows.select(
        eid.alias("log_id"),
        "ts",
        "user_id",
        kind.alias("tool"),
        F.concat(F.when(eid % 4 == 3, "peek-").otherwise("run-"), kind).alias("action"),
        number.alias("class_no"),
        use_case.alias("use_case"),
        F.when(eid % 13 == 0, F.lit(None))
        .when(eid % 17 == 0, F.lit("bad"))
        .otherwise(F.sha2(use_case, 256))
        .alias("breadcrumb"),
        F.sha2(token_text, 256).alias("token"),
        F.col("props").alias("params"),
        "value",
        F.sha2("props", 256).alias("auth_hash"),
        F.concat("props", F.when(eid % 11 == 0, "x").otherwise("")).alias("exec_params"),
        F.col("ts").alias("auth_ts"),
        (F.col("ts") + F.make_dt_interval(mins=(eid % 7).cast("int"))).alias("exec_ts"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("expiry"),
        F.when(eid % 3 == 0, first(3)).when(eid % 3 == 1, first(2)).otherwise(first(1)).alias("performed"),
    )


view(
    "token_uses",
    """SELECT event_id AS log_id, ts, sha256(event_type || '|' || user_id % 7 || '|' || CAST(date_trunc('day', ts) AS DATE)) AS token,
         date_trunc('day', ts) + INTERVAL 12 HOUR AS expiry FROM events""",
)


def as_token_uses(rows: DataFrame) -> DataFrame:
    """Events (batch or stream) as uses of tokens issued at midnight for twelve hours."""
    day = F.date_trunc("day", "ts")
    text = F.concat_ws("|", "event_type", (F.col("user_id") % 7).cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return rows.select(
        F.col("event_id").alias("log_id"), "ts", F.sha2(text, 256).alias("token"), (day + F.expr("INTERVAL 12 HOURS")).alias("expiry")
    )


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_invocations(events(spark, sf_dir))


# Registered actions: two for every observed (use case, tool) but purchases of uc-4. The class
# of run-click in uc-3 was verified as 3, views were attested one class higher than verified,
# and the other action of a tool is one class less sensitive.
view(
    "registry",
    """SELECT use_case, tool, 'run-' || tool AS action, class_no, CASE WHEN tool = 'view' THEN 4 ELSE class_no END AS attested_no FROM registered_tools
       UNION ALL
       SELECT use_case, tool, 'peek-' || tool, least(class_no + 1, 5), least(class_no + 1, 5) FROM registered_tools""",
    "registered_tools",
)
view(
    "registered_tools",
    """SELECT use_case, tool, CASE WHEN use_case = 'uc-3' AND tool = 'click' THEN 3 ELSE min(class_no) END AS class_no
       FROM invocations WHERE NOT (use_case = 'uc-4' AND tool = 'purchase') GROUP BY use_case, tool""",
    "invocations",
)
view(
    "class_names",
    """SELECT * FROM (VALUES (1, 'Class1_PII'), (2, 'Class2_SensitivePersonalData'), (3, 'Class3_ConfidentialPersonalData'),
         (4, 'Class4_InternalData'), (5, 'Class5_PublicData')) v(class_no, label)""",
)


def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry document (JSON text) per use case, from the observed tools."""
    from tollgate.operators.audit import class_name, required_extensions

    seen = invocations(spark, sf_dir).filter(~((F.col("use_case") == "uc-4") & (F.col("tool") == "purchase")))
    tools = seen.groupBy("use_case", "tool").agg(F.min("class_no").alias("n"))
    raised = (F.col("use_case") == "uc-3") & (F.col("tool") == "click")
    verified = F.when(raised, 3).otherwise(F.col("n"))
    attested = F.when(F.col("tool") == "view", 4).otherwise(verified)
    less = F.least(verified + 1, F.lit(5))

    def action(prefix, attested_class, verified_class):
        return F.struct(
            F.concat(F.lit(prefix), F.col("tool")).alias("action_name"),
            class_name(attested_class).alias("mcp_classification_attested_by_user"),
            class_name(verified_class).alias("mcp_classification_verified"),
            required_extensions(verified_class).alias("mcp_handshake_extensions_required"),
        )

    actions = F.array(action("run-", attested, verified), action("peek-", less, less))
    per_tool = tools.select("use_case", F.struct(F.col("tool").alias("tool_system_id"), actions.alias("actions")).alias("t"))
    # a registry document lists the tools of one use case, at most one per event type
    documents = per_tool.groupBy("use_case").agg(F.array_sort(F.collect_list("t")).alias("tools_and_actions"))
    return documents.select(
        F.to_json(F.struct(F.col("use_case").alias("use_case_id"), "tools_and_actions")).alias("value")
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.operators.audit import class_number
    from tollgate.sources.logs import parse_registry, registry_actions

    actions = registry_actions(parse_registry(registry_documents(spark, sf_dir)))
    return actions.withColumns({"class_no": class_number(F.col("verified")), "attested_no": class_number(F.col("attested"))})


def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = invocations(spark, sf_dir).select("use_case").distinct()
    return used.withColumn("breadcrumb", F.sha2("use_case", 256))


view(
    "pebbles",
    """SELECT event_id AS log_id, ts, 'uc-' || user_id % 5 AS use_case, event_type AS status,
         CASE WHEN event_id % 19 = 0 THEN 'bad' ELSE sha256('{"status": "' || event_type || '"}' || sha256('uc-' || user_id % 5)) END AS proof
       FROM events""",
)


def as_pebbles(rows: DataFrame) -> DataFrame:
    use_case = F.concat(F.lit("uc-"), (F.col("user_id") % 5).cast("string"))
    state = F.concat(F.lit('{"status": "'), F.col("event_type"), F.lit('"}'))
    secret = F.sha2(use_case, 256)
    return rows.select(
        F.col("event_id").alias("log_id"),
        "ts",
        use_case.alias("use_case"),
        state.alias("state"),
        secret.alias("breadcrumb"),
        F.when(F.col("event_id") % 19 == 0, "bad").otherwise(F.sha2(F.concat(state, secret), 256)).alias("proof"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("metric"), "ts", "value", "event_id", "user_id")


# --- configuration changes ----------------------------------------------------------------

view(
    "config_changes",
    """SELECT event_id AS change_id, ts,
         CASE event_id % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'runtime' ELSE 'integration' END AS schema_type,
         CASE WHEN user_id % 11 = 0 THEN 'tok-unknown' WHEN user_id % 13 = 0 THEN 'tok-c'
              ELSE CASE event_id % 3 WHEN 0 THEN 'tok-a' WHEN 1 THEN 'tok-b' ELSE 'tok-c' END END AS token,
         CASE WHEN event_id % 97 = 0 THEN 'no json' ELSE '{' ||
           CASE event_id % 3
             WHEN 0 THEN '"name":"gate-' || user_id || '","targetMetric":' || CASE WHEN event_id % 25 = 0 THEN '5' ELSE '"' || event_type || '"' END
               || ',"dataClassification":"' || CASE user_id % 5 WHEN 0 THEN 'Public' WHEN 1 THEN 'Internal' WHEN 2 THEN 'Confidential' WHEN 3 THEN 'Restricted' ELSE 'Secret' END
               || '","quickAlertHeuristic":{"threshold":' || (user_id + 1) || '.5' || CASE WHEN event_id % 35 = 0 THEN '' ELSE ',"window":"5m"' END || '}'
               || CASE WHEN event_id % 40 = 0 THEN ',"gpu_config":{"type":"A100"}' || CASE WHEN event_id % 9 = 0 THEN ',"audit_note":7' ELSE '' END
                       WHEN event_id % 55 = 0 THEN ',"gpu_config":"A100","audit_note":"x"' ELSE '' END
             WHEN 1 THEN '"modelVersion":"v' || user_id || '","validationParameters":' || CASE WHEN event_id % 25 = 1 THEN '"none"' ELSE '{"minBatchSize":32}' END
               || CASE event_id % 40 WHEN 1 THEN ',"operational_metric":"throughput"' WHEN 13 THEN ',"operational_metric":7' ELSE '' END
             ELSE '"customThresholds":{"accuracy":' || CASE WHEN event_id % 25 = 2 THEN '"high"' ELSE '0.95' END || ',"latency_p99":' || user_id || '},"businessMetric":"revenue"'
               || CASE WHEN event_id % 40 = 2 THEN ',"callbackUrl":"https://cb.example.org"' ELSE '' END
           END || CASE WHEN event_id % 30 = 0 THEN '' ELSE ',"reason":"r' || user_id || '"' END || '}' END AS body
       FROM events""",
)


def as_config_changes(rows: DataFrame) -> DataFrame:
    """Events (batch or stream) as configuration changes, some of them wrong on purpose."""
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = eid % 3

    def some(condition, text):
        return F.when(condition, F.lit(text)).otherwise(F.lit(""))

    level = F.element_at(
        F.array(*[F.lit(x) for x in ("Public", "Internal", "Confidential", "Restricted", "Secret")]),
        (F.col("user_id") % 5 + 1).cast("int"),
    )
    enterprise = F.concat(
        F.lit('"name":"gate-'), user, F.lit('","targetMetric":'),
        F.when(eid % 25 == 0, F.lit("5")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))),
        F.lit(',"dataClassification":"'), level,
        F.lit('","quickAlertHeuristic":{"threshold":'), (F.col("user_id") + 1).cast("string"), F.lit(".5"),
        some(eid % 35 != 0, ',"window":"5m"'), F.lit("}"),
        F.when((eid % 40 == 0) & (eid % 9 == 0), ',"gpu_config":{"type":"A100"},"audit_note":7')
        .when(eid % 40 == 0, ',"gpu_config":{"type":"A100"}')
        .when(eid % 55 == 0, ',"gpu_config":"A100","audit_note":"x"')
        .otherwise(""),
    )
    runtime = F.concat(
        F.lit('"modelVersion":"v'), user, F.lit('","validationParameters":'),
        F.when(eid % 25 == 1, '"none"').otherwise('{"minBatchSize":32}'),
        F.when(eid % 40 == 1, ',"operational_metric":"throughput"').when(eid % 40 == 13, ',"operational_metric":7').otherwise(""),
    )
    integration = F.concat(
        F.lit('"customThresholds":{"accuracy":'), F.when(eid % 25 == 2, '"high"').otherwise("0.95"),
        F.lit(',"latency_p99":'), user, F.lit('},"businessMetric":"revenue"'),
        some(eid % 40 == 2, ',"callbackUrl":"https://cb.example.org"'),
    )
    reason = F.when(eid % 30 == 0, F.lit("")).otherwise(F.concat(F.lit(',"reason":"r'), user, F.lit('"')))
    body = F.concat(F.lit("{"), F.when(kind == 0, enterprise).when(kind == 1, runtime).otherwise(integration), reason, F.lit("}"))
    return rows.select(
        eid.alias("change_id"),
        "ts",
        F.when(kind == 0, "enterprise").when(kind == 1, "runtime").otherwise("integration").alias("schema_type"),
        F.when(F.col("user_id") % 11 == 0, "tok-unknown")
        .when(F.col("user_id") % 13 == 0, "tok-c")
        .when(kind == 0, "tok-a")
        .when(kind == 1, "tok-b")
        .otherwise("tok-c")
        .alias("token"),
        F.when(eid % 97 == 0, "no json").otherwise(body).alias("body"),
    )


def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_config_changes(spread(events(spark, sf_dir)))


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("tok-a", "enterprise"), ("tok-b", "lob-it"), ("tok-c", "app-team")], "token string, role string"
    )


# --- Markdown documents -----------------------------------------------------------------------

view(
    "md_docs",
    r"""SELECT doc_id, 'docs/' || doc_id AS source, chr(10) || chr(10) || '# Source Document: docs/' || doc_id || chr(10) || chr(10)
         || regexp_replace(text, '(^|\n)([ABC])', '\1## \2', 'g')
         || CASE WHEN n_chars % 3 = 0 THEN repeat(chr(10), 2) || '## Setup' || chr(10) || '```' || chr(10) || 'git status' || chr(10) || '```' || chr(10)
                 WHEN n_chars % 5 = 0 THEN repeat(chr(10), 2) || '# Notes' || chr(10) || 'One `word`.' ELSE '' END AS md
       FROM documents""",
)


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a source header, headings at lines that start with A, B or C, and a closing section."""
    from tollgate.operators.chunking import with_source_header

    source = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    text = F.regexp_replace("text", "(^|\\n)([ABC])", "$1## $2")
    tail = (
        F.when(F.col("n_chars") % 3 == 0, "\n\n## Setup\n```\ngit status\n```\n")
        .when(F.col("n_chars") % 5 == 0, "\n\n# Notes\nOne `word`.")
        .otherwise("")
    )
    return documents(spark, sf_dir).select(
        "doc_id", source.alias("source"), F.concat(with_source_header(source, text), tail).alias("md")
    )
