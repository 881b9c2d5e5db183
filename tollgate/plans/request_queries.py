"""Request validation, rule by rule and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.operators import items as item_ops
from tollgate.operators import requests as request_ops
from tollgate.operators import rules
from tollgate.plans import views
from tollgate.plans.catalog import query, view
from tollgate.sources.policies import parse_examples, parse_policies, policy_rows


def _listed(col="violations"):
    return F.array_join(F.col(col), "|").alias("violations")


@query("io_pairs", "SELECT conv_id, turn, input_text, output_text FROM io_pairs", "io_pairs")
def io_pairs(spark, sf_dir) -> DataFrame:
    return views.io_pairs(spark, sf_dir)


@query(
    "policy_lookup",
    """SELECT r.request_id, coalesce(p.policy_name, '') AS policy_name, coalesce(p.description, '') AS description
       FROM requests r LEFT JOIN (VALUES ('basicgate', 'Length limits on both texts of a request.'),
         ('strictgate', 'Caller identity and class lists on both texts.'),
         ('mediagate', 'Attached images, their derived text, lengths and identity.')) p(policy_name, description)
       ON lower(r.api_class) = p.policy_name""",
    "requests",
)
def policy_lookup(spark, sf_dir):
    found = request_ops.lookup_policy(views.requests(spark, sf_dir), views.policy_rows(spark))
    return found.select(
        "request_id",
        F.coalesce("policy_name", F.lit("")).alias("policy_name"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


@query(
    "policy_load",
    """SELECT lower(source) || '_gate' AS policy_name, 'Texts of ' || source AS description,
         max(n_chars) // 2 AS max_length FROM documents GROUP BY source""",
)
def policy_load(spark, sf_dir):
    """One policy file per document source, parsed back to policy rows."""
    sources = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("n"))
    rule = F.struct(
        F.lit("text_length_limit").alias("type"),
        F.floor(F.col("n") / 2).alias("max_length"),
        F.array(F.lit("text")).alias("text_fields"),
    )
    policy = F.struct(
        F.concat(F.lit("Texts of "), F.col("source")).alias("description"),
        F.array(rule).alias("custom_validation_rules"),
    )
    files = sources.select(
        F.to_json(F.map_from_arrays(F.array(F.concat(F.upper("source"), F.lit("_Gate"))), F.array(policy))).alias("value")
    )
    return parse_policies(files).select(
        "policy_name",
        F.col("policy.description").alias("description"),
        F.col("policy.custom_validation_rules")[0]["max_length"].alias("max_length"),
    )


@query(
    "policy_table_validate",
    """SELECT doc_id AS request_id, CASE WHEN violations = '' THEN 'PASS' ELSE 'REJECT_POLICY_VIOLATION' END AS overall_status, violations
       FROM (SELECT doc_id, concat_ws('|', CASE WHEN length(text) > limit_of THEN 'Field ''text'' (length ' || length(text) || ') exceeds maximum length of '
                 || limit_of || ' characters.' END,
               CASE WHEN NOT regexp_matches(lang, '^(en|' || other || ')$') THEN 'Field ''lang'' does not match required format pattern.' END) AS violations
             FROM documents JOIN (SELECT source, max(n_chars) // 2 AS limit_of, min(lang) AS other FROM documents GROUP BY source) USING (source))""",
)
def policy_table_validate(spark, sf_dir):
    """Every document against the policy of its source, from a table of policy files made from the sources."""
    docs = views.table(spark, sf_dir, "documents")
    sources = docs.groupBy("source").agg(F.max("n_chars").alias("n"), F.min("lang").alias("other"))
    rules = F.array(
        F.to_json(F.struct(F.lit("text_length_limit").alias("type"), F.floor(F.col("n") / 2).alias("max_length"), F.array(F.lit("text")).alias("text_fields"))),
        F.to_json(F.struct(F.lit("format_validation").alias("type"), F.lit("lang").alias("field"), F.concat(F.lit("(en|"), "other", F.lit(")$")).alias("pattern"))),
    )
    file = F.concat(F.lit('{"'), F.upper("source"), F.lit('_Gate": {"custom_validation_rules": ['), F.array_join(rules, ", "), F.lit("]}}"))
    incoming = docs.select(F.col("doc_id").alias("request_id"), F.concat("source", F.lit("_GATE")).alias("api_class"), "text", "lang")
    checked = request_ops.validate(incoming, policy_rows(sources.select(file.alias("value"))))
    return checked.select("request_id", "overall_status", _listed("violation_reasons"))


@query(
    "reference_examples",
    """SELECT lang || '/' || source AS class, doc_id, v.example_no,
         CASE v.example_no WHEN 0 THEN md5(source) ELSE md5(text) END AS example_md5
       FROM documents, (VALUES (0), (1)) v(example_no)""",
)
def reference_examples(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "lang", "source")
    files = docs.select(
        "doc_id",
        F.to_json(F.map_from_arrays(F.array(name), F.array(F.array("source", "text")))).alias("value"),
    )
    return parse_examples(files, keep=["doc_id"]).select(
        "class", "doc_id", "example_no", F.md5("example").alias("example_md5")
    )


@query(
    "rule_text_length",
    """SELECT request_id, array_to_string(list_filter([
          CASE WHEN length(input_text) > 300 THEN 'Field ''input_text'' (length ' || length(input_text) || ') exceeds maximum length of 300 characters.' END,
          CASE WHEN length(output_text) > 300 THEN 'Field ''output_text'' (length ' || length(output_text) || ') exceeds maximum length of 300 characters.' END],
          lambda x: x IS NOT NULL), '|') AS violations FROM requests""",
    "requests",
)
def rule_text_length(spark, sf_dir):
    df = views.requests(spark, sf_dir)
    found = rules.custom_rule_messages(views.POLICIES["BasicGate"], df)
    return df.withColumn("violations", found).select("request_id", _listed())


@query(
    "rule_required",
    """SELECT request_id, CASE WHEN coalesce(input_text, '') = '' THEN 'Required field ''input_text'' is missing or empty.|' ELSE '' END
         || CASE WHEN coalesce(user_id, '') = '' THEN 'Required field ''user_id'' is missing or empty.|' ELSE '' END
         || CASE WHEN turn = 0 THEN 'Required field ''turn'' is missing or empty.|' ELSE '' END
         || 'Required field ''tenant'' is missing or empty.' AS violations FROM requests""",
    "requests",
)
def rule_required(spark, sf_dir):
    df = views.requests(spark, sf_dir)
    rule = {"type": "required_fields", "fields": ["input_text", "user_id", "turn", "tenant"]}
    found = rules.custom_rule_messages({"custom_validation_rules": [rule]}, df)
    return df.withColumn("violations", found).select("request_id", _listed())


@query(
    "rule_format",
    """SELECT request_id,
         CASE WHEN user_email IS NOT NULL AND NOT regexp_matches(user_email, '^[^@ ]+@[^@ ]+[.][a-z]{2,9}$')
              THEN 'Field ''user_email'' does not match required format pattern.' ELSE '' END
         || CASE WHEN user_id IS NOT NULL THEN
              'Invalid regex pattern in ''format_validation'' for field ''user_id'': unterminated character set at position 0' ELSE '' END AS violations
       FROM requests""",
    "requests",
)
def rule_format(spark, sf_dir):
    df = views.requests(spark, sf_dir)
    wanted = [("user_email", views.EMAIL_PATTERN), ("user_id", "[u"), ("absent", "x")]
    listed = [{"type": "format_validation", "field": name, "pattern": pattern} for name, pattern in wanted]
    found = rules.custom_rule_messages({"custom_validation_rules": listed}, df)
    return df.withColumn("v", found).select("request_id", F.array_join("v", "").alias("violations"))


@query(
    "rule_config_errors",
    """SELECT message, count(*) AS requests FROM requests, (VALUES
         ('Invalid ''text_length_limit'' rule config at index 0.'), ('Custom rule at index 1 is not a valid object.'),
         ('Invalid ''required_fields'' rule config at index 2.'), ('Invalid ''format_validation'' rule config at index 3.'),
         ('Invalid ''custom_validation_rules'' format in policy.')) v(message) GROUP BY message""",
    "requests",
)
def rule_config_errors(spark, sf_dir):
    """Rules of a wrong shape report on every request and are skipped."""
    df = views.requests(spark, sf_dir)
    wrong = {
        "custom_validation_rules": [
            {"type": "text_length_limit", "max_length": "300"},
            "no rule",
            {"type": "required_fields", "fields": "user_id"},
            {"type": "format_validation", "field": "user_email"},
        ]
    }
    found = F.concat(
        rules.custom_rule_messages(wrong, df),
        rules.custom_rule_messages({"custom_validation_rules": {}}, df),
    )
    return df.select(F.explode(found).alias("message")).groupBy("message").agg(F.count("*").alias("requests"))


@query(
    "class_lists",
    """SELECT request_id, array_to_string(list_filter([
          CASE WHEN input_text <> '' AND input_class = 'Class 1: PII' THEN 'Input text classified as disallowed sensitivity: ''' || input_class || '''.' END,
          CASE WHEN input_text <> '' AND input_class NOT IN ('Class 3: Internal', 'Class 4: Public') THEN 'Input text sensitivity class ''' || input_class || ''' not in allowed list.' END,
          CASE WHEN output_text <> '' AND output_class IN ('Class 1: PII', 'Class 2: Confidential') THEN 'Output text classified as disallowed sensitivity: ''' || output_class || '''.' END],
          lambda x: x IS NOT NULL), '|') AS violations FROM scored_requests""",
    "scored_requests",
)
def class_lists(spark, sf_dir):
    df = views.scored_requests(spark, sf_dir)
    policy = views.POLICIES["StrictGate"]

    def listed(key):
        return F.array(*[F.lit(c) for c in policy.get(key, [])]).cast("array<string>")

    found = [
        rules.class_list_messages(
            side, F.col(f"{side}_text"), F.col(f"{side}_class"),
            listed(f"disallowed_colbert_{side}_classes"), listed(f"allowed_colbert_{side}_classes"),
        )
        for side in ("input", "output")
    ]
    return df.withColumn("violations", rules.joined(found)).select("request_id", _listed())


@query(
    "io_validity",
    """SELECT request_id, CASE WHEN io_probability < 0.45 AND (input_text <> '' OR output_text <> '')
         THEN format('ModernBERT I/O validation failed (validity score: {:.2f}).', io_probability) ELSE '' END AS violation
       FROM scored_requests""",
    "scored_requests",
)
def io_validity(spark, sf_dir):
    df = views.scored_requests(spark, sf_dir)
    found = rules.pair_messages(
        F.col("io_prediction"), F.col("io_probability"), F.col("input_text"), F.col("output_text")
    )
    return df.select("request_id", F.array_join(found, "|").alias("violation"))


# --- items ------------------------------------------------------------------------------

view(
    "shaped_items",
    """SELECT *, CASE request_id % 4 WHEN 0 THEN '[{"id": "a"}, 5, "x", {"id": "' || user || '"}]' WHEN 1 THEN '{"id": "a"}'
                  WHEN 2 THEN '[' || turn || ']' ELSE '[]' END AS input_items
       FROM (SELECT *, 'u' || conv_id AS user FROM requests)""",
    "requests",
)


@query(
    "item_shape",
    """SELECT request_id, CASE request_id % 4 WHEN 0 THEN 'Item at index 1 is not a valid object.|Item at index 2 is not a valid object.'
         WHEN 1 THEN 'Invalid ''input_items'' format: expected a list.' WHEN 2 THEN 'Item at index 0 is not a valid object.' ELSE '' END AS violations
       FROM shaped_items""",
    "shaped_items",
)
def item_shape(spark, sf_dir):
    df = views.requests(spark, sf_dir)
    kind = F.col("request_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('[{"id": "a"}, 5, "x", {"id": "u'), F.col("conv_id").cast("string"), F.lit('"}]')))
        .when(kind == 1, F.lit('{"id": "a"}'))
        .when(kind == 2, F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
        .otherwise(F.lit("[]"))
    )
    return df.withColumn("violations", item_ops.shape_messages(text)).select("request_id", _listed())


@query(
    "item_rule_match",
    """SELECT request_id, item_no, item_type, CASE WHEN policy_name = 'mediagate' AND item_type = 'image' THEN 0
         WHEN policy_name = 'mediagate' AND item_type = 'document' THEN 1 ELSE -1 END AS rule_no FROM items""",
    "items",
)
def item_rule_match(spark, sf_dir):
    items = item_ops.explode_items(views.requests_with_items(spark, sf_dir))
    matched = item_ops.match_rules(items, views.policy_rows(spark))
    return matched.select("request_id", "item_no", "item_type", F.coalesce("rule_no", F.lit(-1)).alias("rule_no"))


view(
    "item_results",
    """SELECT i.*, array_to_string(list_filter([
          CASE WHEN has_rule AND i.file_name IS NULL THEN 'VLM processing required for item ''' || item_id || ''', but ''filename_in_form'' is missing.' END,
          CASE WHEN has_rule AND i.file_name IS NOT NULL AND NOT found THEN 'Required file ''' || i.file_name || ''' for item ''' || item_id || ''' not found in form data.' END,
          CASE WHEN has_rule AND found AND item_type = 'document' THEN 'VLM processing not supported for item type: ''document''.' END,
          CASE WHEN has_rule AND found AND item_type = 'image' AND description <> '' AND description_class IN ('Class 1: PII', 'Class 2: Confidential')
               THEN 'VLM-derived text for item ''' || item_id || ''' classified as disallowed sensitivity: ''' || description_class || '''.' END,
          CASE WHEN has_rule AND found AND item_type = 'image' AND description <> '' AND words <> ''
               THEN 'VLM-derived text for item ''' || item_id || ''' contains blocked keywords: ' || words || '.' END,
          CASE WHEN policy_name = 'mediagate' AND item_type = 'audio' THEN 'No processing rule defined for item type: ''audio''.' END],
          lambda x: x IS NOT NULL), '|') AS violations
       FROM (SELECT i.*, f.request_id IS NOT NULL AS found, f.description, f.description_class,
               coalesce(policy_name = 'mediagate' AND item_type IN ('image', 'document'), false) AS has_rule,
               array_to_string(list_filter(['THE', 'ouen', 'ieren'], lambda w: contains(lower(f.description), lower(w))), ', ') AS words
             FROM items i LEFT JOIN files f ON i.request_id = f.request_id AND i.file_name = f.file_name) i""",
    "items files",
)


def checked_items(spark, sf_dir, base=None):
    base = base or views.requests(spark, sf_dir)
    items = item_ops.explode_items(views.requests_with_items(spark, sf_dir, base))
    given = views.files(spark, sf_dir, base)
    attached = items.join(
        given.withColumn("has_file", F.lit(True)), ["request_id", "file_name"], "left"
    )
    return item_ops.item_messages(attached, views.policy_rows(spark))


@query("item_checks", "SELECT request_id, item_no, item_type, violations FROM item_results", "item_results")
def item_checks(spark, sf_dir):
    return checked_items(spark, sf_dir).select("request_id", "item_no", "item_type", _listed())


@query(
    "item_strict_type",
    """SELECT request_id, item_no, CASE WHEN policy_name = 'mediagate' AND item_type = 'audio'
         THEN 'No processing rule defined for item type: ''audio''.' ELSE '' END AS violation FROM items""",
    "items",
)
def item_strict_type(spark, sf_dir):
    strict = {"MediaGate": {**views.POLICIES["MediaGate"], "item_processing_rules": [{"item_type": "image"}, {"item_type": "document"}]}}
    items = item_ops.explode_items(views.requests_with_items(spark, sf_dir))
    return item_ops.item_messages(items.withColumn("has_file", F.lit(False)), strict).select(
        "request_id", "item_no", F.array_join("violations", "|").alias("violation")
    )


@query(
    "blocked_keywords",
    """SELECT request_id, array_to_string(list_filter(['THE', 'ouen', 'ieren'],
         lambda w: contains(lower(input_text), lower(w))), ', ') AS found FROM requests""",
    "requests",
)
def blocked_keywords(spark, sf_dir):
    df = views.requests(spark, sf_dir)
    return df.select(
        "request_id", F.array_join(item_ops.blocked_words(F.col("input_text"), views.IMAGE_WORDS), ", ").alias("found")
    )


@query(
    "derived_text_class",
    """SELECT request_id, item_no, CASE WHEN coalesce(policy_name = 'mediagate' AND item_type = 'image' AND found AND description <> ''
         AND description_class IN ('Class 1: PII', 'Class 2: Confidential'), false) THEN description_class ELSE '' END AS denied_class
       FROM item_results""",
    "item_results",
)
def derived_text_class(spark, sf_dir):
    denied = F.regexp_extract(F.array_join("violations", "|"), "disallowed sensitivity: '([^']*)'", 1)
    return checked_items(spark, sf_dir).select("request_id", "item_no", denied.alias("denied_class"))


# --- the whole request ------------------------------------------------------------------

view(
    "validated",
    """SELECT r.*, array_to_string(list_filter(CASE policy
          WHEN 'basicgate' THEN [long_in, long_out]
          WHEN 'strictgate' THEN [pair, in_denied, in_allowed, out_denied, no_input, no_user, bad_mail]
          WHEN 'mediagate' THEN [items, long_in, long_out, no_input, no_user, bad_mail]
          ELSE ['']::VARCHAR[] END, lambda x: x IS NOT NULL AND x <> ''), '|') AS violations
       FROM (SELECT s.*, lower(s.api_class) AS policy, i.items,
          CASE WHEN length(input_text) > 300 THEN 'Field ''input_text'' (length ' || length(input_text) || ') exceeds maximum length of 300 characters.' END AS long_in,
          CASE WHEN length(output_text) > 300 THEN 'Field ''output_text'' (length ' || length(output_text) || ') exceeds maximum length of 300 characters.' END AS long_out,
          CASE WHEN coalesce(input_text, '') = '' THEN 'Required field ''input_text'' is missing or empty.' END AS no_input,
          CASE WHEN coalesce(user_id, '') = '' THEN 'Required field ''user_id'' is missing or empty.' END AS no_user,
          CASE WHEN user_email IS NOT NULL AND NOT regexp_matches(user_email, '^[^@ ]+@[^@ ]+[.][a-z]{2,9}$')
               THEN 'Field ''user_email'' does not match required format pattern.' END AS bad_mail,
          CASE WHEN io_probability < 0.45 AND (input_text <> '' OR output_text <> '')
               THEN format('ModernBERT I/O validation failed (validity score: {:.2f}).', io_probability) END AS pair,
          CASE WHEN input_text <> '' AND input_class = 'Class 1: PII' THEN 'Input text classified as disallowed sensitivity: ''' || input_class || '''.' END AS in_denied,
          CASE WHEN input_text <> '' AND input_class NOT IN ('Class 3: Internal', 'Class 4: Public') THEN 'Input text sensitivity class ''' || input_class || ''' not in allowed list.' END AS in_allowed,
          CASE WHEN output_text <> '' AND output_class IN ('Class 1: PII', 'Class 2: Confidential') THEN 'Output text classified as disallowed sensitivity: ''' || output_class || '''.' END AS out_denied
         FROM scored_requests s LEFT JOIN
          (SELECT request_id, string_agg(violations, '|' ORDER BY item_no) FILTER (violations <> '') AS items
           FROM item_results GROUP BY request_id) i ON s.request_id = i.request_id) r""",
    "scored_requests item_results",
)

_STATUS = """CASE WHEN coalesce(api_class, '') = '' THEN 'ERROR_BAD_REQUEST'
     WHEN policy NOT IN ('basicgate', 'strictgate', 'mediagate') THEN 'REJECT_INVALID_POLICY'
     WHEN violations <> '' THEN 'REJECT_POLICY_VIOLATION' ELSE 'PASS' END"""


def validated(spark, sf_dir):
    """Requests with model results, item results and all rules applied, by policies read from their JSON."""
    base = views.requests(spark, sf_dir)
    with_items = views.requests_with_items(spark, sf_dir, base)
    per_request = item_ops.regroup(checked_items(spark, sf_dir, base))
    return request_ops.validate(with_items, views.policy_rows(spark), per_request)


@query(
    "validate_requests",
    f"""SELECT request_id, {_STATUS} AS overall_status, violations,
         CASE WHEN coalesce(api_class, '') = '' THEN '''api_class'' field is required in JSON payload.'
              WHEN policy = 'nosuchgate' THEN 'Policy definition for API class ''NoSuchGate'' (normalized to ''nosuchgate'') not found or not loaded.'
              ELSE '' END AS error_message FROM validated""",
    "validated",
)
def validate_requests(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "request_id",
        "overall_status",
        _listed("violation_reasons"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


@query(
    "violation_list",
    """SELECT request_id, list_position(v, x) - 1 AS violation_no, x AS violation
       FROM (SELECT request_id, string_split(violations, '|') AS v FROM validated WHERE violations <> ''), unnest(v) t(x)""",
    "validated",
)
def violation_list(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "request_id", F.posexplode("violation_reasons").alias("violation_no", "violation")
    )


@query(
    "validation_summary",
    f"""SELECT coalesce(policy, '') AS policy, {_STATUS} AS overall_status, count(*) AS requests,
         sum(CASE WHEN violations = '' THEN 0 ELSE len(string_split(violations, '|')) END)::BIGINT AS violations
       FROM validated GROUP BY 1, 2""",
    "validated",
)
def validation_summary(spark, sf_dir):
    totals = request_ops.summary(validated(spark, sf_dir))
    return totals.withColumn("policy", F.coalesce("policy", F.lit("")))


@query(
    "checks_skipped",
    """SELECT request_id, CASE lower(api_class) WHEN 'strictgate'
         THEN 'modernbert_io_validation|colbert_input_sensitivity|colbert_output_sensitivity'
         WHEN 'mediagate' THEN 'item_processing_rules' ELSE '' END AS checks_skipped FROM requests""",
    "requests",
)
def checks_skipped(spark, sf_dir):
    """Without model results the model checks are skipped and named."""
    checked = request_ops.validate(views.requests(spark, sf_dir), views.POLICIES)
    return checked.select("request_id", F.array_join("checks_skipped", "|").alias("checks_skipped"))


@query(
    "request_defaults",
    """SELECT CASE WHEN request_id % 3 = 0 THEN 'req_' || (1700000000 + conv_id) || '_' || request_id ELSE request_id::VARCHAR END AS request_id,
         (1700000000 + conv_id)::DOUBLE AS timestamp_utc FROM requests""",
    "requests",
)
def request_defaults(spark, sf_dir):
    """Requests without an id get one made of the time and a key of the data."""
    rows = views.requests(spark, sf_dir).withColumn("key", F.col("request_id"))
    rows = rows.withColumn("request_id", F.when(F.col("key") % 3 != 0, F.col("key")))
    received = F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id"))
    return request_ops.with_request_id(rows, "key", received).select("request_id", "timestamp_utc")
