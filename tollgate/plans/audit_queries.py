"""Registry, breadcrumb, handshake, pebble and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions.canonical import breadcrumb
from tollgate.operators import audit, handshake, monitoring, pebbles
from tollgate.plans import views
from tollgate.plans.catalog import query, view
from tollgate.sources.logs import parse_invocations, tool_and_action


@query(
    "invocation_scan",
    """SELECT event_id::VARCHAR AS log_entry_id, event_type AS tool, 'run-' || event_type AS action, user_id::VARCHAR AS user_id, sha256(props) AS parameters_hash,
         epoch_us(ts) // 1000 AS ts_millis, 1 + event_id % 2 AS checks FROM events""",
)
def invocation_scan(spark, sf_dir):
    """Nested log lines, parsed with the fixed schema."""
    ev = views.events(spark, sf_dir)
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("log_entry_id"),
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
                F.struct(F.col("user_id").cast("string").alias("id")).alias("user"),
            ).alias("transaction"),
            F.struct(F.concat("event_type", F.lit("/run-"), "event_type").alias("name"), F.sha2("props", 256).alias("parameters_hash")).alias("tool"),
            F.struct(
                F.when(F.col("event_id") % 2 == 0, F.array(F.lit("pattern")))
                .otherwise(F.array(F.lit("pattern"), F.lit("schema")))
                .alias("checks_performed")
            ).alias("validation"),
        )
    )
    tool, action = tool_and_action(F.col("tool.name"))
    return parse_invocations(ev.select(line.alias("value"))).select(
        "log_entry_id",
        tool.alias("tool"),
        action.alias("action"),
        F.col("transaction.user.id").alias("user_id"),
        F.col("tool.parameters_hash").alias("parameters_hash"),
        F.unix_millis("transaction.timestamp").alias("ts_millis"),
        F.size("validation.checks_performed").cast("long").alias("checks"),
    )


@query(
    "registry_actions",
    """SELECT use_case, tool, action, v.label AS verified, a.label AS attested, CASE WHEN r.class_no <= 2 THEN 3 WHEN r.class_no = 3 THEN 2 ELSE 0 END AS required
       FROM registry r JOIN class_names v ON v.class_no = r.class_no JOIN class_names a ON a.class_no = r.attested_no""",
    "registry class_names",
)
def registry_actions(spark, sf_dir):
    return views.registry(spark, sf_dir).select(
        "use_case", "tool", "action", "verified", "attested", F.size("required").alias("required")
    )


@query(
    "high_risk_actions",
    "SELECT use_case, tool, class_no FROM registry WHERE class_no <= 2",
    "registry",
)
def high_risk_actions(spark, sf_dir):
    return audit.high_risk(views.registry(spark, sf_dir)).select("use_case", "tool", "class_no")


@query(
    "usecase_overall_class",
    """SELECT use_case, m AS class_no, label FROM (SELECT use_case, min(class_no) AS m FROM registry GROUP BY 1) r JOIN class_names c ON c.class_no = r.m""",
    "registry class_names",
)
def usecase_overall_class(spark, sf_dir):
    return audit.overall_class(views.registry(spark, sf_dir))


@query(
    "attestation_gap",
    """SELECT use_case, count(*) AS actions, count(*) FILTER (class_no <> attested_no) AS different,
         round(count(*) FILTER (class_no <> attested_no) / count(*), 6) AS gap FROM registry GROUP BY 1""",
    "registry",
)
def attestation_gap(spark, sf_dir):
    return audit.attestation_gap(views.registry(spark, sf_dir)).withColumn("gap", F.round("gap", 6))


@query(
    "breadcrumb_missing",
    """SELECT log_id, use_case, coalesce(breadcrumb, '') AS breadcrumb FROM invocations i
       WHERE NOT EXISTS (SELECT 1 FROM invocations r WHERE sha256(r.use_case) = i.breadcrumb)""",
    "invocations",
)
def breadcrumb_missing(spark, sf_dir):
    found = audit.missing_breadcrumbs(views.invocations(spark, sf_dir), views.breadcrumbs(spark, sf_dir))
    return found.select("log_id", "use_case", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"))


@query(
    "breadcrumb_mismatch",
    "SELECT log_id, use_case, breadcrumb FROM invocations WHERE breadcrumb <> sha256(use_case)",
    "invocations",
)
def breadcrumb_mismatch(spark, sf_dir):
    found = audit.wrong_breadcrumbs(views.invocations(spark, sf_dir), views.breadcrumbs(spark, sf_dir))
    return found.select("log_id", "use_case", "breadcrumb")


@query(
    "sensitivity_drift",
    """SELECT log_id, i.use_case, i.tool, i.action, CASE WHEN r.tool IS NULL THEN 'unregistered action' ELSE 'sensitivity drift' END AS finding
       FROM invocations i LEFT JOIN registry r ON r.use_case = i.use_case AND r.tool = i.tool AND r.action = i.action
       WHERE r.tool IS NULL OR r.class_no <> i.class_no""",
    "invocations registry",
)
def sensitivity_drift(spark, sf_dir):
    found = audit.sensitivity_drift(views.invocations(spark, sf_dir), views.registry(spark, sf_dir))
    return found.select("log_id", "use_case", "tool", "action", "finding")


@query(
    "tool_class_lookup",
    """SELECT event_id, tool_name, coalesce(class_no, -1) AS class_no, coalesce(extensions, '') AS extensions FROM
         (SELECT event_id, CASE event_type WHEN 'signup' THEN 'create_payment_method' WHEN 'purchase' THEN 'send_money'
            WHEN 'click' THEN 'create_invoice' WHEN 'view' THEN 'get_exchange_rate' ELSE 'no_such_tool' END AS tool_name FROM events)
       LEFT JOIN (VALUES ('create_payment_method', 1, 'TransactionBoundTokens|AtomicTokenConsumption|DualAgentValidation'),
         ('send_money', 2, 'TransactionBoundTokens|AtomicTokenConsumption|DualAgentValidation'),
         ('create_invoice', 3, 'TransactionBoundTokens|AtomicTokenConsumption'), ('get_exchange_rate', 5, '')) t(tool_name, class_no, extensions)
       USING (tool_name)""",
)
def tool_class_lookup(spark, sf_dir):
    kind = F.col("event_type")
    name = (
        F.when(kind == "signup", "create_payment_method")
        .when(kind == "purchase", "send_money")
        .when(kind == "click", "create_invoice")
        .when(kind == "view", "get_exchange_rate")
        .otherwise("no_such_tool")
    )
    calls = views.events(spark, sf_dir).select("event_id", name.alias("tool_name"))
    return audit.lookup_tool_class(calls, spark).select(
        "event_id",
        "tool_name",
        F.coalesce("class_no", F.lit(-1)).alias("class_no"),
        F.coalesce(F.array_join("required", "|"), F.lit("")).alias("extensions"),
    )


@query(
    "tier_requirements",
    """SELECT log_id, class_no <= 3 AS two_phase, class_no <= 2 AS confirmation, array_to_string(list_filter(CASE WHEN class_no <= 2
           THEN ['TransactionBoundTokens', 'AtomicTokenConsumption', 'DualAgentValidation'] WHEN class_no = 3
           THEN ['TransactionBoundTokens', 'AtomicTokenConsumption'] ELSE []::VARCHAR[] END, lambda x: NOT list_contains(performed, x)), '|') AS missing
       FROM invocations""",
    "invocations",
)
def tier_requirements(spark, sf_dir):
    log = views.invocations(spark, sf_dir)
    return log.withColumns(audit.tier_columns(F.col("class_no"), F.col("performed"))).select(
        "log_id", "two_phase", "confirmation", F.array_join("missing", "|").alias("missing")
    )


@query(
    "missing_extensions",
    """SELECT log_id, x AS extension FROM invocations, unnest(CASE WHEN class_no <= 2
           THEN ['TransactionBoundTokens', 'AtomicTokenConsumption', 'DualAgentValidation'] WHEN class_no = 3
           THEN ['TransactionBoundTokens', 'AtomicTokenConsumption'] ELSE []::VARCHAR[] END) t(x) WHERE NOT list_contains(performed, x)""",
    "invocations",
)
def missing_extensions(spark, sf_dir):
    return audit.missing_extensions(views.invocations(spark, sf_dir)).select("log_id", "extension")


@query(
    "invocation_counts",
    "SELECT tool, use_case, user_id, count(*) AS invocations FROM invocations GROUP BY ALL",
    "invocations",
)
def invocation_counts(spark, sf_dir):
    log = views.invocations(spark, sf_dir)
    return log.groupBy("tool", "use_case", "user_id").agg(F.count("*").alias("invocations"))


@query(
    "log_gaps",
    """SELECT use_case, log_id, round(gap, 3) AS gap_seconds FROM (SELECT use_case, log_id,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY use_case ORDER BY ts, log_id)) / 1e6 AS gap FROM invocations) WHERE gap > 3600""",
    "invocations",
)
def log_gaps(spark, sf_dir):
    found = audit.log_gaps(views.invocations(spark, sf_dir).select("use_case", "ts", "log_id"), "use_case", ["ts", "log_id"], 3600)
    return found.select("use_case", "log_id", F.round("gap_seconds", 3).alias("gap_seconds"))


@query(
    "audit_sample",
    "SELECT log_id, tool FROM invocations WHERE ('0x' || substr(sha256(log_id::VARCHAR), 1, 8))::BIGINT % 10 = 0",
    "invocations",
)
def audit_sample(spark, sf_dir):
    return audit.hash_sample(views.invocations(spark, sf_dir), "log_id", 10).select("log_id", "tool")


@query(
    "attack_patterns",
    """SELECT doc_id, p AS pattern FROM documents, (VALUES ('ignore'), ('The '), ('password'), ('eaux'), ('@')) v(p)
       WHERE contains(lower(text), lower(p))""",
)
def attack_patterns(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return audit.matched_patterns(docs, "text", ["ignore", "The ", "password", "eaux", "@"]).select("doc_id", "pattern")


# A long list made by a rule: all threes of common letters.
_LETTERS = "etaoinshrdlu"


@query(
    "pattern_counts",
    f"""WITH letter AS (SELECT unnest(string_split('{_LETTERS}', '')) AS c),
       pattern AS (SELECT a.c || b.c || d.c AS pattern FROM letter a, letter b, letter d)
       SELECT pattern, count(*) AS docs FROM documents, pattern WHERE contains(lower(text), pattern) GROUP BY pattern""",
)
def pattern_counts(spark, sf_dir):
    """Documents per pattern of a list of 1,728."""
    patterns = [a + b + c for a in _LETTERS for b in _LETTERS for c in _LETTERS]
    return audit.matched_patterns(views.documents(spark, sf_dir), "text", patterns).groupBy("pattern").agg(F.count("*").alias("docs"))


# --- handshake --------------------------------------------------------------------------------


@query(
    "handshake_binding",
    "SELECT log_id, sha256(exec_params) = auth_hash AS bound FROM invocations",
    "invocations",
)
def handshake_binding(spark, sf_dir):
    log = views.invocations(spark, sf_dir)
    return log.select("log_id", handshake.parameters_bound(F.col("exec_params"), F.col("auth_hash")).alias("bound"))


@query("handshake_expiry", "SELECT log_id, exec_ts <= expiry AS alive FROM invocations", "invocations")
def handshake_expiry(spark, sf_dir):
    log = views.invocations(spark, sf_dir)
    return log.select("log_id", handshake.in_time(F.col("exec_ts"), F.col("expiry")).alias("alive"))


def phases(spark, sf_dir):
    """Authorisations and executions: views need no authorisation, errors were never executed."""
    log = views.invocations(spark, sf_dir).withColumn("transaction_id", F.col("log_id"))
    authorised = log.filter("tool <> 'view'").select("transaction_id", "token", "auth_ts", "expiry", "auth_hash")
    executed = log.filter("tool <> 'error'").select(
        "transaction_id", "token", "exec_ts", F.sha2("exec_params", 256).alias("exec_hash")
    )
    return authorised, executed


@query(
    "handshake_match",
    """SELECT log_id AS transaction_id, sha256(exec_params) = auth_hash AS bound FROM invocations
       WHERE tool NOT IN ('view', 'error') AND exec_ts BETWEEN auth_ts AND expiry""",
    "invocations",
)
def handshake_match(spark, sf_dir):
    found = handshake.match(*phases(spark, sf_dir))
    return found.select("transaction_id", (F.col("auth_hash") == F.col("exec_hash")).alias("bound"))


@query(
    "handshake_orphans",
    """SELECT log_id AS transaction_id, CASE tool WHEN 'error' THEN 'not executed' ELSE 'not authorised' END AS finding
       FROM invocations WHERE tool IN ('view', 'error')""",
    "invocations",
)
def handshake_orphans(spark, sf_dir):
    return handshake.orphans(*phases(spark, sf_dir))


@query(
    "handshake_metrics",
    """SELECT tool, count(*) AS calls, count(*) FILTER (NOT bound) AS unbound, count(*) FILTER (NOT alive) AS expired,
         round(count(*) FILTER (NOT bound OR NOT alive) / count(*), 6) AS error_rate
       FROM (SELECT tool, sha256(exec_params) = auth_hash AS bound, exec_ts <= expiry AS alive FROM invocations) GROUP BY 1""",
    "invocations",
)
def handshake_metrics(spark, sf_dir):
    log = views.invocations(spark, sf_dir).withColumns(
        {
            "bound": handshake.parameters_bound(F.col("exec_params"), F.col("auth_hash")),
            "alive": handshake.in_time(F.col("exec_ts"), F.col("expiry")),
        }
    )
    return handshake.metrics(log, ["tool"]).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "token_replay",
    """SELECT token, log_id, CASE WHEN ts > expiry THEN 'expired' WHEN EXISTS (SELECT 1 FROM token_uses e
           WHERE e.token = u.token AND e.ts <= e.expiry AND (e.ts, e.log_id) < (u.ts, u.log_id)) THEN 'replay' ELSE 'first' END AS outcome
       FROM token_uses u""",
    "token_uses",
)
def token_replay(spark, sf_dir):
    return handshake.outcomes(views.as_token_uses(views.events(spark, sf_dir))).select("token", "log_id", "outcome")


# --- pebbles ------------------------------------------------------------------------------------


@query("pebble_verify", "SELECT log_id, proof <> 'bad' AS verified FROM pebbles", "pebbles")
def pebble_verify(spark, sf_dir):
    return pebbles.verify(views.as_pebbles(views.events(spark, sf_dir))).select("log_id", "verified")


@query(
    "pebble_transitions",
    """SELECT log_id, use_case, status, coalesce(previous, '') AS previous_status, status IS DISTINCT FROM previous AS changed
       FROM (SELECT *, lag(status) OVER (PARTITION BY use_case ORDER BY ts, log_id) AS previous FROM pebbles)""",
    "pebbles",
)
def pebble_transitions(spark, sf_dir):
    rows = pebbles.transitions(views.as_pebbles(views.events(spark, sf_dir)))
    return rows.select(
        "log_id", "use_case", "status", F.coalesce("previous_status", F.lit("")).alias("previous_status"), "changed"
    )


@query(
    "breadcrumb_hash",
    """SELECT event_id, sha256('{"props": ' || props || ', "type": "' || event_type || '", "user": "\\u00e9' || user_id || '"}') AS breadcrumb FROM events""",
)
def breadcrumb_hash(spark, sf_dir):
    """Registry text with unsorted keys and no blanks; hashed in canonical form."""
    text = F.concat(
        F.lit('{"user":"é'), F.col("user_id").cast("string"), F.lit('","type":"'), F.col("event_type"),
        F.lit('","props":'), F.col("props"), F.lit("}"),
    )
    return views.events(spark, sf_dir).select("event_id", breadcrumb(text).alias("breadcrumb"))


# --- monitoring -----------------------------------------------------------------------------------


@query(
    "baseline_build",
    """SELECT event_type AS metric, count(*) AS samples, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread,
         round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1""",
)
def baseline_build(spark, sf_dir):
    rows = views.metrics(spark, sf_dir)
    base = monitoring.baseline(rows, ["metric"])
    middle = monitoring.exact_quantiles(rows, "metric", 0.5, "event_id", "median")
    return base.join(middle, "metric").select(
        "metric", "samples", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), F.round("median", 6).alias("median")
    )


@query(
    "baseline_deviation",
    """SELECT d.metric, d.day, d.samples, round((d.mean - b.mean) / b.spread, 6) AS deviation FROM
         (SELECT event_type AS metric, strftime(ts, '%Y-%m-%d') AS day, count(*) AS samples, avg(value) AS mean FROM events GROUP BY 1, 2) d
         JOIN (SELECT event_type AS metric, avg(value) AS mean, stddev_samp(value) AS spread FROM events GROUP BY 1) b ON b.metric = d.metric""",
)
def baseline_deviation(spark, sf_dir):
    rows = views.metrics(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = monitoring.baseline(rows, ["metric", "day"])
    found = monitoring.deviations(daily, monitoring.baseline(rows, ["metric"]), ["metric"])
    return found.select("metric", "day", "samples", F.round("deviation", 6).alias("deviation"))


@query(
    "rolling_deviation",
    """SELECT event_id, metric, recent, round(recent_mean, 6) AS recent_mean, round(recent_spread, 6) AS recent_spread,
         abs(value - recent_mean) > 3 * recent_spread AS deviates FROM
         (SELECT event_id, event_type AS metric, value, count(value) OVER w AS recent, avg(value) OVER w AS recent_mean, stddev_samp(value) OVER w AS recent_spread
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE recent >= 2""",
)
def rolling_deviation(spark, sf_dir):
    rows = monitoring.rolling(views.metrics(spark, sf_dir), ["metric"], ["ts", "event_id"], 20)
    return rows.filter("recent >= 2").select(
        "event_id",
        "metric",
        "recent",
        F.round("recent_mean", 6).alias("recent_mean"),
        F.round("recent_spread", 6).alias("recent_spread"),
        (F.abs(F.col("value") - F.col("recent_mean")) > 3 * F.col("recent_spread")).alias("deviates"),
    )


view(
    "measured",
    """SELECT 'uc-' || user_id % 5 AS use_case, count(*) FILTER (event_type <> 'error') / count(*) AS accuracy,
         quantile_cont(value, 0.99) AS latency_p99 FROM events GROUP BY 1""",
)


@query(
    "threshold_check",
    """SELECT use_case, 'accuracy' AS metric, round(accuracy, 6) AS value, accuracy < 0.9 AS breached FROM measured
       UNION ALL SELECT use_case, 'latency_p99', round(latency_p99, 6), latency_p99 > CASE use_case WHEN 'uc-0' THEN 40.0 ELSE 100.0 END FROM measured""",
    "measured",
)
def threshold_check(spark, sf_dir):
    """Accuracy and p99 latency per integration against its thresholds."""
    rows = views.metrics(spark, sf_dir).withColumn("use_case", F.concat(F.lit("uc-"), (F.col("user_id") % 5).cast("string")))
    accuracy = rows.groupBy("use_case").agg((F.count_if(F.col("metric") != "error") / F.count("*")).alias("value"))
    latency = monitoring.exact_quantiles(rows, "use_case", 0.99, "event_id", "value")
    measured = accuracy.withColumn("metric", F.lit("accuracy")).unionByName(latency.withColumn("metric", F.lit("latency_p99")))
    limit = F.when(F.col("metric") == "accuracy", 0.9).when(F.col("use_case") == "uc-0", 40.0).otherwise(100.0)
    thresholds = measured.select("use_case", "metric", limit.alias("threshold"))
    found = monitoring.threshold_breaches(measured, thresholds, "use_case")
    return found.select("use_case", "metric", F.round("value", 6).alias("value"), "breached")
