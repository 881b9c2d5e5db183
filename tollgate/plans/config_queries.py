"""Configuration changes, their schemas and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.operators import config
from tollgate.plans import views
from tollgate.plans.catalog import query, view
from tollgate.session import scratch_path
from tollgate.sources.logs import append_audit, audit_entries, read_audit

view(
    "config_auth",
    """SELECT c.*, role, CASE WHEN role IS NULL THEN 401 WHEN role <> CASE schema_type WHEN 'enterprise' THEN 'enterprise' WHEN 'runtime' THEN 'lob-it' ELSE 'app-team' END
           THEN 403 ELSE 200 END AS auth_code
       FROM config_changes c LEFT JOIN (VALUES ('tok-a', 'enterprise'), ('tok-b', 'lob-it'), ('tok-c', 'app-team')) r(token, role) USING (token)""",
    "config_changes",
)


@query(
    "config_authz",
    """SELECT change_id, auth_code AS status_code, CASE auth_code WHEN 401 THEN 'Invalid token' WHEN 403 THEN CASE schema_type WHEN 'enterprise'
         THEN 'Enterprise access required' WHEN 'runtime' THEN 'LOB IT access required' ELSE 'App team access required' END ELSE '' END AS detail,
         CASE schema_type WHEN 'enterprise' THEN 'enterprise' WHEN 'runtime' THEN 'lob' ELSE 'app' END || coalesce('-' || role, '') AS author FROM config_auth""",
    "config_auth",
)
def config_authz(spark, sf_dir):
    found = config.authorise(views.config_changes(spark, sf_dir), views.role_table(spark))
    return found.select("change_id", "status_code", F.coalesce("detail", F.lit("")).alias("detail"), "author")


view(
    "config_checked",
    """SELECT *, CASE WHEN NOT json_valid(body) THEN 'Body is not a JSON object' ELSE array_to_string(list_filter(
         CASE schema_type
           WHEN 'enterprise' THEN [CASE WHEN NOT json_exists(body, '$.reason') THEN 'Required field ''reason'' missing' END,
             CASE WHEN json_type(body, '$.targetMetric') <> 'VARCHAR' THEN 'Field ''targetMetric'' is not of type ''string''' END,
             CASE WHEN json_extract_string(body, '$.dataClassification') NOT IN ('Public', 'Internal', 'Confidential', 'Restricted')
                  THEN 'Field ''dataClassification'' is not one of the allowed values' END,
             CASE WHEN NOT json_exists(body, '$.quickAlertHeuristic.window') THEN 'Required field ''quickAlertHeuristic.window'' missing' END]
           WHEN 'runtime' THEN [CASE WHEN NOT json_exists(body, '$.reason') THEN 'Required field ''reason'' missing' END,
             CASE WHEN json_type(body, '$.validationParameters') <> 'OBJECT' THEN 'Field ''validationParameters'' is not of type ''object''' END]
           ELSE [CASE WHEN NOT json_exists(body, '$.reason') THEN 'Required field ''reason'' missing' END,
             CASE WHEN json_type(body, '$.customThresholds.accuracy') = 'VARCHAR' THEN 'Field ''customThresholds.accuracy'' is not of type ''number''' END]
         END, lambda x: x IS NOT NULL), '; ') END AS errors
       FROM (SELECT * REPLACE (CASE WHEN body = 'no json' THEN 'no json' ELSE body END AS body) FROM
             (SELECT change_id, ts, schema_type, token, role, auth_code, body FROM config_auth))""",
    "config_auth",
)


@query("config_validate", "SELECT change_id, schema_type, errors FROM config_checked", "config_checked")
def config_validate(spark, sf_dir):
    found = config.validate_bodies(views.config_changes(spark, sf_dir))
    return found.select("change_id", "schema_type", F.array_join("errors", "; ").alias("errors"))


view("config_valid", "SELECT * FROM config_checked WHERE auth_code = 200 AND errors = ''", "config_checked")
view(
    "config_fields",
    """SELECT change_id, ts, schema_type, field, json_extract(body, '$.' || field)::VARCHAR AS value,
         CASE json_type(body, '$.' || field) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
              WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS json_type
       FROM config_valid, unnest(json_keys(body)) t(field)""",
    "config_valid",
)
view("config_added", "SELECT * FROM config_fields WHERE field IN ('gpu_config', 'operational_metric', 'callbackUrl', 'audit_note')", "config_fields")
# The rule taken change by change: the types known so far go along, and a refused change adds none.
view(
    "config_steps",
    """SELECT schema_type, change_id, map(list(field), list(json_type)) AS given, row_number() OVER (PARTITION BY schema_type ORDER BY any_value(ts), change_id) AS no
       FROM config_added GROUP BY schema_type, change_id""",
    "config_added",
)
view(
    "config_walk",
    """SELECT DISTINCT schema_type, 0::BIGINT AS no, NULL::BIGINT AS change_id, false AS refused, MAP {}::MAP(VARCHAR, VARCHAR) AS known FROM config_steps
       UNION ALL
       SELECT schema_type, no, change_id, refused, CASE WHEN refused THEN known ELSE map_concat(given, known) END FROM
         (SELECT s.schema_type, s.no, s.change_id, s.given, w.known,
            len(list_filter(map_keys(s.given), lambda k: map_extract(w.known, k)[1] <> map_extract(s.given, k)[1])) > 0 AS refused
          FROM config_walk w JOIN config_steps s ON s.schema_type = w.schema_type AND s.no = w.no + 1)""",
    "config_steps",
)
view(
    "config_recorded",
    """SELECT schema_type, field, arg_min(json_type, (ts, change_id)) AS json_type, arg_min(change_id, (ts, change_id)) AS first_change, min((ts, change_id)) AS first
       FROM config_added WHERE change_id IN (SELECT change_id FROM config_walk WHERE NOT refused) GROUP BY 1, 2""",
    "config_added config_walk",
)
view(
    "config_conflicts",
    """SELECT a.change_id, a.schema_type, a.field, a.json_type, r.json_type AS recorded_type FROM config_added a
       JOIN config_recorded r ON r.schema_type = a.schema_type AND r.field = a.field WHERE a.json_type <> r.json_type AND (a.ts, a.change_id) > r.first""",
    "config_added config_recorded",
)
view(
    "config_accepted",
    "SELECT * FROM config_fields WHERE change_id NOT IN (SELECT change_id FROM config_conflicts)",
    "config_fields config_conflicts",
)


def valid_changes(spark, sf_dir):
    checked = config.validate_bodies(config.authorise(views.config_changes(spark, sf_dir), views.role_table(spark)))
    return checked.filter((F.col("status_code") == 200) & (F.size("errors") == 0))


def accepted_changes(spark, sf_dir):
    return config.apply_changes(views.config_changes(spark, sf_dir), views.role_table(spark)).filter("status_code = 200")


@query("config_new_fields", "SELECT schema_type, field, json_type, first_change FROM config_recorded", "config_recorded")
def config_new_fields(spark, sf_dir):
    return config.new_fields(valid_changes(spark, sf_dir))


@query(
    "config_type_conflict",
    "SELECT change_id, schema_type, field, json_type, recorded_type FROM config_conflicts",
    "config_conflicts",
)
def config_type_conflict(spark, sf_dir):
    found = config.type_conflicts(valid_changes(spark, sf_dir))
    return found.select("change_id", "schema_type", "field", "json_type", "recorded_type")


@query(
    "config_apply",
    """SELECT c.change_id, CASE WHEN auth_code <> 200 THEN auth_code WHEN errors <> '' OR k.change_id IS NOT NULL THEN 400 ELSE 200 END AS status_code
       FROM config_checked c LEFT JOIN (SELECT DISTINCT change_id FROM config_conflicts) k ON k.change_id = c.change_id""",
    "config_checked config_conflicts",
)
def config_apply(spark, sf_dir):
    return config.apply_changes(views.config_changes(spark, sf_dir), views.role_table(spark)).select(
        "change_id", "status_code"
    )


@query(
    "config_history",
    "SELECT schema_type, field, change_id, value, row_number() OVER (PARTITION BY schema_type, field ORDER BY ts, change_id) AS version FROM config_accepted",
    "config_accepted",
)
def config_history(spark, sf_dir):
    return config.history(accepted_changes(spark, sf_dir)).select("schema_type", "field", "change_id", "value", "version")


@query(
    "config_latest",
    "SELECT schema_type, field, arg_max(value, (ts, change_id)) AS value, arg_max(change_id, (ts, change_id)) AS change_id FROM config_accepted GROUP BY 1, 2",
    "config_accepted",
)
def config_latest(spark, sf_dir):
    return config.latest(accepted_changes(spark, sf_dir))


@query(
    "config_backcompat",
    """SELECT f.change_id, f.schema_type, f.field, f.json_type, n.newest_type FROM config_fields f JOIN
         (SELECT schema_type, field, arg_max(json_type, (ts, change_id)) AS newest_type FROM config_fields GROUP BY 1, 2) n
       ON n.schema_type = f.schema_type AND n.field = f.field WHERE f.json_type <> n.newest_type""",
    "config_fields",
)
def config_backcompat(spark, sf_dir):
    """All valid changes, also those in conflict, held against the newest types."""
    found = config.incompatible_history(valid_changes(spark, sf_dir))
    return found.select("change_id", "schema_type", "field", "json_type", "newest_type")


@query(
    "config_asof",
    """SELECT e.event_id AS row_id, e.event_type AS metric, coalesce(c.threshold, -1.0) AS threshold FROM events e ASOF LEFT JOIN
         (SELECT json_extract_string(body, '$.targetMetric') AS metric, ts, max_by(json_extract(body, '$.quickAlertHeuristic.threshold')::DOUBLE, change_id) AS threshold
          FROM config_valid WHERE schema_type = 'enterprise' GROUP BY 1, 2) c ON c.metric = e.event_type AND e.ts >= c.ts""",
    "config_valid",
)
def config_asof(spark, sf_dir):
    """The alert threshold in force at each event."""
    changes = valid_changes(spark, sf_dir).filter("schema_type = 'enterprise'")
    versions = changes.select(
        F.get_json_object("body", "$.targetMetric").alias("metric"),
        "ts",
        F.col("change_id").alias("version_id"),
        F.get_json_object("body", "$.quickAlertHeuristic.threshold").cast("double").alias("threshold"),
    )
    rows = views.metrics(spark, sf_dir).select("metric", "ts", F.col("event_id").alias("row_id"))
    found = config.in_force(rows, versions, "metric", "threshold")
    return found.select("row_id", "metric", F.coalesce("threshold", F.lit(-1.0)).alias("threshold"))


def _written_audit(spark, sf_dir):
    path = scratch_path(spark, "audit")
    append_audit(audit_entries(accepted_changes(spark, sf_dir)), path)
    return path


view(
    "config_audit",
    """SELECT DISTINCT c.change_id, strftime(c.ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, c.schema_type,
         CASE c.schema_type WHEN 'enterprise' THEN 'enterprise' WHEN 'runtime' THEN 'lob' ELSE 'app' END || '-' || c.role AS author, c.body AS change
       FROM config_valid c WHERE change_id NOT IN (SELECT change_id FROM config_conflicts)""",
    "config_valid config_conflicts",
)


@query("audit_append", "SELECT timestamp, schema_type, author, change FROM config_audit", "config_audit")
def audit_append(spark, sf_dir):
    """Accepted changes written to the audit log and read back."""
    return read_audit(spark, _written_audit(spark, sf_dir)).select("timestamp", "schema_type", "author", "change")


@query(
    "audit_by_type",
    "SELECT timestamp, author, change FROM config_audit WHERE schema_type = 'runtime'",
    "config_audit",
)
def audit_by_type(spark, sf_dir):
    """One schema type of the log: only its folder is read."""
    return read_audit(spark, _written_audit(spark, sf_dir), "runtime").select("timestamp", "author", "change")
