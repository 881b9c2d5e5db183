"""Streaming queries, run over the files of a table until all is read.

Each gives its sink back as a table, which must hold the rows of the batch form.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tollgate.operators import agent, audit, config, monitoring, pebbles, requests
from tollgate.operators import items as item_ops
from tollgate.plans import views
from tollgate.plans.agent_queries import as_results
from tollgate.plans.catalog import query
from tollgate.plans.request_queries import _STATUS, checked_items
from tollgate.session import cut_lineage, scratch_path, small_table
from tollgate.sources.logs import action_log_view, audit_entries, read_audit
from tollgate.streaming import jobs
from tollgate.streaming.items import validate_arriving


def event_stream(spark, sf_dir):
    views.read_as_utc(spark)
    path = f"{sf_dir}/events.parquet"
    rows = jobs.read_files(spark, path, spark.read.parquet(path).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def ended_stream(spark, sf_dir):
    """The events as an input that is complete, and the call that says so."""
    return jobs.with_end(event_stream(spark, sf_dir), "ts")


def _sink(spark, path, schema, fmt="parquet"):
    return spark.read.schema(schema).format(fmt).load(path)


def _run(stream, label, sf_dir, **options):
    partitions = jobs.state_partitions(stream.sparkSession, f"{sf_dir}/events.parquet")
    path = jobs.run_available(stream, label, partitions=partitions, **options)
    return _sink(stream.sparkSession, path, stream.schema)


@query("stream_validate", f"SELECT request_id, {_STATUS} AS overall_status, violations FROM validated", "validated")
def stream_validate(spark, sf_dir):
    """Requests arrive as files with their model and item results."""
    rows = views.requests_with_items(spark, sf_dir).join(
        item_ops.regroup(checked_items(spark, sf_dir)), "request_id", "left"
    )
    path = scratch_path(spark, "requests")
    rows.write.parquet(path)
    arriving = jobs.read_files(spark, path, rows.schema)
    checked = requests.validate(arriving, views.POLICIES)
    return _run(
        checked.select("request_id", "overall_status", F.array_join("violation_reasons", "|").alias("violations")),
        "stream-validate",
        sf_dir,
    )


# Requests and files made of events: a file comes up to six minutes after its request, or a second before it, or too late.
_EVENT_PAIRS = """SELECT event_id AS conv_id, 1 AS turn, event_type || ' ' || props AS input_text,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE repeat(event_type || ' the ', event_id % 80) END AS output_text FROM events"""
_EVENT_FILES = """SELECT * FROM (SELECT r.request_id, 'f' || v.item_no || '.png' AS file_name, r.output_text AS description, (r.request_id + v.item_no) % 9 AS arrival,
      CASE (r.request_id + v.item_no) % 5 WHEN 0 THEN 'Class 1: PII' WHEN 1 THEN 'Class 2: Confidential'
           WHEN 2 THEN 'Class 3: Internal' WHEN 3 THEN 'Class 4: Public' ELSE 'Class 5: Unknown' END AS description_class
    FROM requests r, (VALUES (0), (1)) v(item_no) WHERE NOT (v.item_no = 1 AND r.output_text = '')) WHERE arrival < 7"""


@query(
    "stream_items",
    f"SELECT request_id, {_STATUS} AS overall_status, violations FROM validated",
    "validated",
    {"io_pairs": ("", _EVENT_PAIRS), "files": ("requests", _EVENT_FILES)},
)
def stream_items(spark, sf_dir):
    """Requests and their files as two streams: items are read, matched with rules and files, and settled within them."""
    events = views.events(spark, sf_dir)
    folder = jobs.write_in_time_order(events)

    def arriving():
        rows = jobs.read_files(spark, folder, events.schema, files_per_trigger=1)
        # the checks of a row cost far more than its bytes, of which a scan makes few tasks; long texts are made behind the shuffle
        rows = rows.repartition(jobs.row_partitions(spark), "event_id")
        answer = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.expr("repeat(event_type || ' the ', int(event_id % 80))"))
        pairs = rows.select(
            "ts", F.col("event_id").alias("conv_id"), F.lit(1).alias("turn"), F.concat_ws(" ", "event_type", "props").alias("input_text"), answer.alias("output_text")
        )
        return views.as_requests(pairs, "ts")

    given = views.files(spark, sf_dir, arriving(), carry=("ts",))
    number = F.col("request_id") + F.substring("file_name", 2, 1).cast("int")
    seconds = F.when(number % 9 == 7, -1).when(number % 9 == 8, 1200).otherwise(60 * (number % 9))
    attached = given.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 1_000_000 * seconds))
    checked = validate_arriving(views.requests_with_items(spark, sf_dir, arriving()), views.POLICIES, attached)
    return _run(
        checked.select("request_id", "overall_status", F.array_join("violation_reasons", "|").alias("violations")),
        "stream-items",
        sf_dir,
    )


@query(
    "rate_limit",
    f"""SELECT epoch(w)::BIGINT AS window_start, policy, user_id, calls FROM
         (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS policy, user_id, count(*) AS calls FROM events GROUP BY 1, 2, 3)
       WHERE calls > 1""",
)
def rate_limit(spark, sf_dir):
    events, finish = ended_stream(spark, sf_dir)
    calls = events.select("ts", F.col("event_type").alias("policy"), "user_id")
    found = _run(jobs.rate_limit(calls, ["policy", "user_id"], 1, "1 hour"), "rate-limit", sf_dir, finish=finish)
    return found.withColumn("window_start", F.unix_seconds("window_start"))


def _metrics(spark, sf_dir):
    events, finish = ended_stream(spark, sf_dir)
    return events.select("ts", F.col("event_type").alias("metric"), "value"), finish


def _settings(spark):
    """Alert thresholds per metric: configuration."""
    rows = [("click", 12.0), ("view", 10.0), ("purchase", 15.0), ("signup", 9.0), ("error", 11.0)]
    return spark.createDataFrame(rows, "metric string, threshold double")


_THRESHOLDS = "(VALUES ('click', 12.0), ('view', 10.0), ('purchase', 15.0), ('signup', 9.0), ('error', 11.0)) t(metric, threshold)"


@query(
    "quick_alert",
    f"""SELECT epoch(w)::BIGINT AS window_start, metric, round(mean, 6) AS mean, samples FROM
         (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_type AS metric, avg(value) AS mean, count(*) AS samples FROM events GROUP BY 1, 2)
         JOIN {_THRESHOLDS} USING (metric) WHERE mean > threshold""",
)
def quick_alert(spark, sf_dir):
    metrics, finish = _metrics(spark, sf_dir)
    found = _run(jobs.alerts(metrics, _settings(spark), "5 minutes"), "alerts", sf_dir, finish=finish)
    return found.select(F.unix_seconds("window_start").alias("window_start"), "metric", F.round("mean", 6).alias("mean"), "samples")


@query(
    "quick_alert_sliding",
    f"""SELECT epoch(w)::BIGINT AS window_start, metric, round(mean, 6) AS mean, samples FROM
         (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS w, event_type AS metric, avg(value) AS mean, count(*) AS samples
          FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2)
         JOIN {_THRESHOLDS} USING (metric) WHERE mean > threshold""",
)
def quick_alert_sliding(spark, sf_dir):
    metrics, finish = _metrics(spark, sf_dir)
    found = _run(jobs.alerts(metrics, _settings(spark), "1 hour", "30 minutes"), "alerts-sliding", sf_dir, finish=finish)
    return found.select(F.unix_seconds("window_start").alias("window_start"), "metric", F.round("mean", 6).alias("mean"), "samples")


# Alert configurations of the five metrics; the second one for clicks replaces the first.
ALERT_BODIES = [
    (1, "click", 1.0, "1d"), (2, "click", 12.0, "5m"), (1, "view", 10.0, "1h"), (1, "purchase", 9.0, "90m"),
    (1, "signup", 9.0, "2d"), (1, "error", 1.0, "soon"),
]


@query(
    "quick_alert_configured",
    """SELECT (epoch_us(ts) // 1000000 // s) * s AS window_start, s AS window_seconds, metric, round(avg(value), 6) AS mean, count(*) AS samples
       FROM (SELECT ts, event_type AS metric, value FROM events)
       JOIN (VALUES ('click', 12.0, 300), ('view', 10.0, 3600), ('purchase', 9.0, 5400), ('signup', 9.0, 172800)) t(metric, threshold, s) USING (metric)
       GROUP BY 1, 2, 3, threshold HAVING avg(value) > threshold""",
)
def quick_alert_configured(spark, sf_dir):
    """Alerts in windows of the length that each metric's configuration names, in one stream."""
    metrics, finish = _metrics(spark, sf_dir)
    bodies = [(ts, json.dumps({"targetMetric": m, "quickAlertHeuristic": {"threshold": t, "window": w}})) for ts, m, t, w in ALERT_BODIES]
    settings = jobs.alert_settings(spark.createDataFrame(bodies, "ts int, body string"))
    found = _run(jobs.alerts_by_setting(metrics, settings), "alerts-configured", sf_dir, finish=finish)
    return found.select(
        F.unix_seconds("window_start").alias("window_start"), "window_seconds", "metric", F.round("mean", 6).alias("mean"), "samples"
    )


@query(
    "policy_rate_limit",
    """SELECT epoch(time_bucket(INTERVAL 1 MINUTE, ts))::BIGINT AS window_start, event_type AS policy, user_id % 7 AS user_id, count(*) AS calls, allowed
       FROM events JOIN (VALUES ('click', 1), ('view', 2)) t(event_type, allowed) USING (event_type)
       GROUP BY 1, 2, 3, allowed HAVING count(*) > allowed""",
)
def policy_rate_limit(spark, sf_dir):
    """Calls a minute against the limit that stands in the caller's policy."""
    events, finish = ended_stream(spark, sf_dir)
    limits = {"Click": {"enabled": True, "max_requests_per_minute": 1}, "VIEW": {"enabled": True, "max_requests_per_minute": 2}, "error": {"enabled": False, "max_requests_per_minute": 0}}
    policies = {name: {"rate_limiting": limit} for name, limit in limits.items()}
    calls = events.select("ts", F.upper("event_type").alias("api_class"), (F.col("user_id") % 7).alias("user_id"))
    found = _run(jobs.rate_limit_by_policy(calls, policies), "policy-rate-limit", sf_dir, finish=finish)
    return found.withColumn("window_start", F.unix_seconds("window_start"))


# Versions of policies by the day of January from which they hold; the ones that are no JSON change nothing.
LIMIT_VERSIONS = [
    ("Click", 1, 1), ("click", 10, 2), ("CLICK", 20, None), ("View", 5, 1), ("view", 12, "{"), ("view", 25, 0), ("Error", 1, None), ("error", 15, 1),
]


@query(
    "versioned_rate_limit",
    """SELECT epoch(w)::BIGINT AS window_start, policy, user_id, calls, allowed FROM
         (SELECT w, policy, user_id, calls, (SELECT max_by(v.allowed, v.day) FROM
             (VALUES ('click', 1, 1), ('click', 10, 2), ('click', 20, -1), ('view', 5, 1), ('view', 25, 0), ('error', 1, -1), ('error', 15, 1)) v(policy, day, allowed)
             WHERE v.policy = c.policy AND make_timestamp(2024, 1, v.day, 0, 0, 0) <= c.w) AS allowed
          FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS w, event_type AS policy, user_id % 3 AS user_id, count(*) AS calls FROM events GROUP BY 1, 2, 3) c)
       WHERE allowed >= 0 AND calls > allowed""",
)
def versioned_rate_limit(spark, sf_dir):
    """Calls a minute against the policy version in force at that minute; the table of versions is read for every batch."""
    events, finish = ended_stream(spark, sf_dir)
    rows = [
        (name, f"2024-01-{day:02d}", number, limit if isinstance(limit, str) else json.dumps({"rate_limiting": {"enabled": limit is not None, "max_requests_per_minute": limit or 0}}))
        for number, (name, day, limit) in enumerate(LIMIT_VERSIONS)
    ]
    table = scratch_path(spark, "limit-versions")
    versions = spark.createDataFrame(rows, "policy_name string, day string, version_id long, body string")
    versions.withColumn("ts", F.col("day").cast("timestamp")).drop("day").write.parquet(table)
    job = jobs.VersionedRateLimit(spark, scratch_path(spark, "versioned-limit"), lambda: spark.read.parquet(table))
    calls = events.select("ts", F.col("event_type").alias("api_class"), (F.col("user_id") % 3).alias("user_id"))
    job.run_available(calls, jobs.state_partitions(spark, f"{sf_dir}/events.parquet"), finish)
    return job.rows().withColumn("window_start", F.unix_seconds("window_start"))


_ARRIVED = "epoch_us(ts) // 1000000 + CASE event_id % 10 WHEN 0 THEN 172800 WHEN 1 THEN 900 ELSE 0 END"


@query(
    "late_rows",
    f"""WITH part AS (SELECT *, ({_ARRIVED}) // 691200 AS arrival FROM events),
       seen AS (SELECT a.arrival, max(b.ts) - INTERVAL 10 MINUTE AS mark
                FROM (SELECT DISTINCT arrival FROM part) a LEFT JOIN (SELECT arrival, max(ts) AS ts FROM part GROUP BY 1) b ON b.arrival < a.arrival GROUP BY 1),
       placed AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, coalesce(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark, false) AS is_late
                  FROM part JOIN seen USING (arrival) WHERE ts IS NOT NULL)
       SELECT epoch(w)::BIGINT AS window_start, event_type, count(*) FILTER (NOT is_late) AS in_time, count(*) FILTER (is_late) AS late
       FROM placed GROUP BY 1, 2""",
)
def late_rows(spark, sf_dir):
    """Events that arrive in files of eight days, a tenth of them two days late: rows in time and late rows per hour and type."""
    events = views.events(spark, sf_dir)
    delay = F.when(F.col("event_id") % 10 == 0, 172800).when(F.col("event_id") % 10 == 1, 900).otherwise(0)
    parts = events.withColumn("arrival", F.floor((F.unix_seconds("ts") + delay) / 691200))
    known = [r["arrival"] for r in parts.select("arrival").distinct().orderBy("arrival").collect()]  # one value per eight days
    folder = scratch_path(spark, "arriving")
    job = jobs.LateRows(spark, scratch_path(spark, "late"), ["event_type"], "1 hour")
    for arrival in known:
        parts.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(folder)
        job.run_available(spark.readStream.schema(events.schema).parquet(folder))
    return job.counts().withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "stream_baseline",
    f"""SELECT epoch(w)::BIGINT AS window_start, metric, samples, round((m.mean - b.mean) / b.spread, 6) AS deviation FROM
         (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS metric, avg(value) AS mean, count(*) AS samples FROM events GROUP BY 1, 2) m
         JOIN (SELECT event_type AS metric, avg(value) AS mean, stddev_samp(value) AS spread FROM events GROUP BY 1) b USING (metric)""",
)
def stream_baseline(spark, sf_dir):
    # stored once: a stream would work the aggregate out again in every batch
    stored = cut_lineage(monitoring.baseline(views.metrics(spark, sf_dir), ["metric"]))
    metrics, finish = _metrics(spark, sf_dir)
    found = _run(jobs.against_baseline(metrics, stored, "1 hour"), "baseline", sf_dir, finish=finish)
    return found.select(
        F.unix_seconds("window_start").alias("window_start"), "metric", "samples", F.round("deviation", 6).alias("deviation")
    )


@query(
    "stream_breadcrumb",
    """SELECT log_id, CASE WHEN breadcrumb IS NULL THEN 'missing' WHEN breadcrumb <> sha256(use_case) THEN 'mismatch' ELSE 'ok' END AS finding FROM invocations""",
    "invocations",
)
def stream_breadcrumb(spark, sf_dir):
    log = views.as_invocations(event_stream(spark, sf_dir))
    found = audit.breadcrumb_findings(log, small_table(views.breadcrumbs(spark, sf_dir)))
    return _run(found.select("log_id", "finding"), "breadcrumbs", sf_dir)


@query(
    "stream_token_once",
    """SELECT token, min(log_id) FILTER (outcome = 'first') AS first_use, count(*) FILTER (outcome = 'replay') AS replays, count(*) FILTER (outcome = 'expired') AS expired FROM
         (SELECT token, log_id, CASE WHEN ts > expiry THEN 'expired'
            WHEN row_number() OVER (PARTITION BY token, ts <= expiry ORDER BY ts, log_id) = 1 THEN 'first' ELSE 'replay' END AS outcome FROM token_uses)
       GROUP BY token""",
    "token_uses",
)
def stream_token_once(spark, sf_dir):
    """What happened to every token of a twelve-hour life."""
    events, finish = ended_stream(spark, sf_dir)
    return _run(jobs.token_lives(views.as_token_uses(events), "12 hours"), "tokens", sf_dir, finish=finish)


@query("stream_token_first", "SELECT DISTINCT token FROM token_uses WHERE ts <= expiry", "token_uses")
def stream_token_first(spark, sf_dir):
    """The uses that pass: one per token that was used within its life."""
    uses = views.as_token_uses(event_stream(spark, sf_dir)).select("token", "ts", "expiry")
    return _run(jobs.first_uses(uses, "12 hours"), "token-first", sf_dir).select("token")


@query(
    "stream_handshake",
    """SELECT log_id AS transaction_id, sha256(exec_params) = auth_hash AS bound FROM invocations
       WHERE tool NOT IN ('view', 'error') AND exec_ts BETWEEN auth_ts AND expiry""",
    "invocations",
)
def stream_handshake(spark, sf_dir):
    def log():
        return views.as_invocations(event_stream(spark, sf_dir)).withColumn("transaction_id", F.col("log_id"))

    authorised = log().filter("tool <> 'view'").select("transaction_id", "token", "auth_ts", "auth_hash")
    executed = log().filter("tool <> 'error'").select(
        "transaction_id", "token", "exec_ts", F.sha2("exec_params", 256).alias("exec_hash")
    )
    return _run(jobs.matched_phases(authorised, executed), "handshake", sf_dir)


@query(
    "stream_action_log",
    "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, tool_name, arguments, status, result_summary FROM action_log ORDER BY 1 DESC",
    "action_log",
)
def stream_action_log(spark, sf_dir):
    return action_log_view(_run(agent.action_log(as_results(event_stream(spark, sf_dir)), "ts"), "actions", sf_dir))


@query("stream_pebble", "SELECT log_id, use_case, proof <> 'bad' AS verified FROM pebbles", "pebbles")
def stream_pebble(spark, sf_dir):
    """Pebbles with a bad proof land in their own folder of the sink."""
    checked = pebbles.verify(views.as_pebbles(event_stream(spark, sf_dir)))
    found = _run(checked, "pebbles", sf_dir, partition_by=("verified",))
    return found.select("log_id", "use_case", "verified")


@query(
    "stream_audit",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, schema_type,
         CASE schema_type WHEN 'enterprise' THEN 'enterprise' WHEN 'runtime' THEN 'lob' ELSE 'app' END || '-' || role AS author, body AS change FROM config_valid""",
    "config_valid",
)
def stream_audit(spark, sf_dir):
    """Authorised, valid changes appended to the audit log, one folder per schema type."""
    changes = config.authorise(views.as_config_changes(event_stream(spark, sf_dir)), views.role_table(spark))
    valid = config.validate_bodies(changes).filter((F.col("status_code") == 200) & (F.size("errors") == 0))
    path = jobs.run_available(audit_entries(valid), "audit", fmt="json", partition_by=("schema_type",))
    return read_audit(spark, path).select("timestamp", "schema_type", "author", "change")
