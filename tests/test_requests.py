"""Rule checks on hand-made requests."""

import json
import time

from pyspark.sql import functions as F

from tollgate.functions import text
from tollgate.operators import help, items, policies, requests, rules, zero_shot
from tollgate.plans import views
from tollgate.sources import policies as sources


def violations(df, policy):
    checked = requests.validate(df, {"P": policy})
    return [r["violation_reasons"] for r in checked.orderBy("request_id").collect()]


def frame(spark, rows, schema="request_id int, api_class string, input_text string, output_text string"):
    return spark.createDataFrame(rows, schema)


def test_benign_pair_passes_and_bad_pair_fails(spark):
    df = frame(spark, [(1, "p", "hi", "hello"), (2, "P", "hi", "bad"), (3, "p", "", "")])
    df = df.withColumns(
        {"io_prediction": F.when(F.col("request_id") == 1, 1).otherwise(0), "io_probability": F.lit(0.123)}
    )
    found = violations(df, {"modernbert_io_validation": True})
    assert found == [[], ["ModernBERT I/O validation failed (validity score: 0.12)."], []]


def test_sensitive_input_is_denied(spark):
    df = frame(spark, [(1, "P", "My SSN is 123-45-6789.", "Okay.")]).withColumn("input_class", F.lit("Class 1: PII"))
    policy = {"colbert_input_sensitivity": True, "disallowed_colbert_input_classes": ["Class 1: PII"]}
    assert violations(df, policy) == [["Input text classified as disallowed sensitivity: 'Class 1: PII'."]]


def test_text_one_over_the_limit(spark):
    df = frame(spark, [(1, "P", "x" * 1001, None), (2, "P", "\U0001f600" * 1000, None)])
    rule = {"type": "text_length_limit", "max_length": 1000, "text_fields": ["input_text", "absent"]}
    assert violations(df, {"custom_validation_rules": [rule]}) == [
        ["Field 'input_text' (length 1001) exceeds maximum length of 1000 characters."],
        [],
    ]


def test_required_counts_falsy_values_as_missing(spark):
    df = spark.createDataFrame(
        [(1, "P", 0, False, [], "", {"k": ""}), (2, "P", 3, True, ["a"], "x", {"k": "v"})],
        "request_id int, api_class string, n int, b boolean, l array<string>, s string, extra map<string,string>",
    )
    rule = {"type": "required_fields", "fields": ["n", "b", "l", "s", "k", "gone"]}
    first, second = violations(df, {"custom_validation_rules": [rule]})
    assert first == [f"Required field '{f}' is missing or empty." for f in ["n", "b", "l", "s", "k", "gone"]]
    assert second == ["Required field 'gone' is missing or empty."]


def test_format_is_anchored_at_the_start_only(spark):
    df = frame(spark, [(1, "P", "abc-tail", None), (2, "P", "x abc", None), (3, "P", None, None)])
    rule = {"type": "format_validation", "field": "input_text", "pattern": "abc|zzz"}
    assert violations(df, {"custom_validation_rules": [rule]}) == [
        [], ["Field 'input_text' does not match required format pattern."], [],
    ]


def test_statuses_and_policy_names(spark):
    df = frame(spark, [(1, "OTHER", "a", ""), (2, None, "a", ""), (3, "nope", "a", ""), (4, "other", "", ""), (5, "empty", "", "")])
    named = {
        "Other": {"custom_validation_rules": [{"type": "required_fields", "fields": ["missing"]}]},
        "OTHER": {"custom_validation_rules": [{"type": "required_fields", "fields": ["input_text"]}]},
        "Empty": {},
    }
    got = {r["request_id"]: r["overall_status"] for r in requests.validate(df, named).collect()}
    assert got == {
        1: "PASS", 2: "ERROR_BAD_REQUEST", 3: "REJECT_INVALID_POLICY", 4: "REJECT_POLICY_VIOLATION", 5: "REJECT_INVALID_POLICY",
    }


def test_missing_models_are_named(spark):
    df = frame(spark, [(1, "P", "a", "b")])
    checked = requests.validate(df, {"P": {"modernbert_io_validation": True, "colbert_output_sensitivity": True}}).first()
    assert checked["overall_status"] == "PASS"
    assert checked["checks_skipped"] == ["modernbert_io_validation", "colbert_output_sensitivity"]


def test_request_ids_are_stable(spark):
    df = spark.createDataFrame([("r1", 7), (None, 8)], "request_id string, key int").withColumn("at", F.timestamp_seconds(F.lit(1000)))
    made = [r["request_id"] for r in requests.with_request_id(df, "key", F.col("at")).orderBy("key").collect()]
    assert made == ["r1", "req_1000_8"]


def test_image_item_passes_with_its_file(spark):
    policy = {
        "P": {
            "item_processing_rules": [
                {"item_type": "image", "vlm_processing": {"required": True},
                 "derived_text_checks": {"colbert_sensitivity": True, "disallowed_classes": ["Class 1: PII"], "blocked_keywords": ["Secret"]}},
                {"item_type": "image", "vlm_processing": {"required": False}},
            ]
        }
    }
    df = spark.createDataFrame(
        [(1, "p", [("img_1", "image", "a.png"), (None, "image", None), ("z", "audio", "b")])],
        "request_id int, api_class string, items array<struct<id string, type string, filename_in_form string>>",
    )
    given = spark.createDataFrame([(1, "a.png", "a top SECRET place", "Class 4: Public")], "request_id int, file_name string, description string, description_class string")
    attached = items.explode_items(df).join(given.withColumn("has_file", F.lit(True)), ["request_id", "file_name"], "left")
    checked = items.item_messages(attached, policy)
    got = {r["item_id"]: r["violations"] for r in checked.collect()}
    assert got == {
        "img_1": ["VLM-derived text for item 'img_1' contains blocked keywords: Secret."],
        "item_1": ["VLM processing required for item 'item_1', but 'filename_in_form' is missing."],
        "z": [],
    }
    joined = items.regroup(checked).first()["item_violations"]
    assert len(joined) == 2 and joined[0].startswith("VLM-derived")


def test_help_queries_name_the_violation(spark):
    df = spark.createDataFrame([(["Input text classified as disallowed sensitivity: 'Class 1: PII'."],)], "v array<string>")
    got = df.select(help.help_queries(F.col("v"), F.lit("Test policy for PII")).alias("q")).first()["q"]
    assert got == sorted(got) and any("pii" in q.lower() for q in got)
    assert "understanding policy: Test policy for PII" in got


def test_zero_shot_violation_and_pass(spark):
    policy = {"SecretImagePolicy": {"zero_shot_violation_rules": [{"if_classified_as_contains": "secret", "reason": "Secret content."}]}}
    df = spark.createDataFrame(
        [("secretimagepolicy", ["a", "b"], "a benign image", 0.9), ("secretimagepolicy", ["a"], "a top secret square", 0.95)],
        "policy_name string, captions array<string>, classified_as string, confidence double",
    )
    found = {r["classified_as"]: (r["status"], r["violation_reason"]) for r in zero_shot.assess(df, policy).collect()}
    assert found["a benign image"] == ("no violation", zero_shot.NO_VIOLATION)
    assert found["a top secret square"] == ("violation", "Secret content.")


def test_model_failures_are_rows(spark):
    def make():
        def model(image, prompt):
            if image == b"bad":
                raise ValueError("broken image")
            return f"{prompt}: {len(image)} bytes"

        return model

    df = spark.createDataFrame([(b"good",), (b"bad",)], "content binary")
    got = [r["d"] for r in df.select(zero_shot.describe(F.col("content"), F.lit("p"), make).alias("d")).collect()]
    assert (got[0]["description"], got[0]["error"]) == ("p: 4 bytes", None)
    assert got[1]["error"] == "Error: broken image"


def test_text_helpers_agree_with_python(spark):
    white = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    samples = [f"{white}a b{white}", "", white, "a\x85b\r\nc\n", "x\n\ny", "été über"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select(
        text.strip(F.col("t")).alias("s"), text.word_count(F.col("t")).alias("w"), text.split_lines(F.col("t")).alias("l"),
        text.has_letters(F.col("t")).alias("a"),
    ).collect()
    for sample, row in zip(samples, rows):
        assert row["s"] == sample.strip()
        assert row["w"] == len(sample.split())
        assert row["l"] == sample.splitlines()
        assert row["a"] == any(c.isalpha() for c in sample)


def test_two_decimals_as_python_prints_them(spark):
    values = [n / 1000 for n in range(-50, 1200)] + [0.1249999999, 1.005, 2.675, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r["t"] for r in df.select(text.two_decimals(F.col("v")).alias("t")).collect()]
    wrong = [(v, g) for v, g in zip(values, got) if float(g) != float(f"{v:.2f}")]
    assert not wrong


def test_rule_messages_run_without_python(spark):
    """A rules-only policy is one native stage: no Python node, no shuffle; only the policy table is broadcast."""
    df = frame(spark, [(1, "BasicGate", "a", "b")])
    plan = requests.validate(df, {"BasicGate": views.POLICIES["BasicGate"]})._jdf.queryExecution().executedPlan().toString()
    moved = plan.replace("BroadcastExchange HashedRelationBroadcastMode(List(input[0, string", "")
    assert "Python" not in plan.replace("PythonRDD", "") and "Exchange" not in moved
    assert rules.rule_errors({"type": "text_length_limit"}, 4) == "Invalid 'text_length_limit' rule config at index 4."


def test_items_as_json_text(spark):
    policies = {"P": {"item_processing_rules": [{"item_type": "image", "vlm_processing": {"required": True}}]}, "Q": {"description": "no item rules"}}
    rows = [
        (1, "p", '[{"id": "a", "type": "image", "filename_in_form": "f"}, 5, {"type": "image"}]'),
        (2, "q", '{"id": 1}'), (3, "q", "[7]"), (4, "p", None), (5, "p", "[]"),
    ]
    df = spark.createDataFrame(rows, "request_id int, api_class string, input_items string")
    given = spark.createDataFrame([(1, "f", "text")], "request_id int, file_name string, description string")
    told = items.item_messages(items.attach_files(items.explode_json_items(df), given), policies)
    got = {r["request_id"]: r["item_violations"] for r in items.regroup(told).collect()}
    assert got[1] == ["Item at index 1 is not a valid object.", items.NO_FILE_NAME % "item_2"]
    assert got[2] == [items.NOT_A_LIST] and got[3] == [] and 4 not in got


def test_image_workflow(spark):
    def caption_model():
        return lambda image, prompt: f"{prompt} ASSISTANT: a {image.decode()}" if "1 of" in prompt else prompt

    def explain_model():
        def model(image, prompt):
            assert image == b"secret"
            return f"{prompt} it shows {image.decode()}"

        return model

    policies = {"P": {"description": "No secrets.", "zero_shot_violation_rules": [{"if_classified_as_contains": "secret"}]}}
    df = spark.createDataFrame([("p", "look", b"secret"), ("p", "look", b"tree")], "policy_name string, guidance string, content binary")
    shown = zero_shot.with_captions(df, caption_model, 3)
    assert [r["captions"] for r in shown.collect()][1] == [
        "a tree", "Failed to generate caption 2", "Failed to generate caption 3",
    ]
    judged = shown.withColumns({"classified_as": F.col("captions")[0], "confidence": F.lit(0.9)})
    from tollgate import api

    rows = {r["status"]: r["explanation"] for r in api.check_images(judged, policies, explain_model).collect()}
    assert rows == {"violation": "it shows secret", "no violation": None}


def many_policies(n):
    return {
        f"Policy{i}": {
            "description": f"policy {i}",
            "colbert_input_sensitivity": True,
            "disallowed_colbert_input_classes": [f"Class {i % 7}"],
            "custom_validation_rules": [
                {"type": "text_length_limit", "max_length": i, "text_fields": ["input_text"]},
                {"type": "required_fields", "fields": ["user", "absent"]},
                {"type": "format_validation", "field": "user", "pattern": f"u{i}$"},
            ],
            "item_processing_rules": [{"item_type": "image", "vlm_processing": {"required": i % 2 == 0}}],
        }
        for i in range(n)
    }


def policy_rows(spark, policies):
    return sources.policy_rows(spark.createDataFrame([(json.dumps(policies),)], "value string"))


def test_a_thousand_policies_take_the_time_of_ten(spark):
    rows = spark.range(60_000).select(
        F.col("id").alias("request_id"), F.concat(F.lit("policy"), (F.col("id") % 10).cast("string")).alias("api_class"),
        F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("input_text"), F.concat(F.lit("u"), (F.col("id") % 20).cast("string")).alias("user"),
        F.concat(F.lit("Class "), (F.col("id") % 9).cast("string")).alias("input_class"),
    )
    took, seen = {}, {}
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that is too large to compile would be an error
    try:
        for n in (10, 1000):
            checked = requests.validate(rows, policy_rows(spark, many_policies(n)))
            plan = checked._jdf.queryExecution().executedPlan().toString()
            assert "ArrowEvalPython" not in plan.split("BroadcastExchange")[0]
            for _ in range(2):
                began = time.perf_counter()
                checked.write.format("noop").mode("overwrite").save()
                took[n] = time.perf_counter() - began
            seen[n] = checked.agg(F.sum(F.xxhash64("request_id", "violation_reasons", "overall_status", "checks_skipped").cast("decimal(38)"))).first()[0]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert seen[10] == seen[1000]
    assert took[1000] < 3 * took[10] + 2


def test_policy_rows_and_dicts_say_the_same(spark):
    odd = {
        "A": {"custom_validation_rules": "none"},
        "a": {
            "custom_validation_rules": [
                {"type": "text_length_limit", "max_length": "3"}, 7, None, {"type": "text_length_limit", "max_length": 3, "text_fields": "input_text"},
                {"type": "text_length_limit", "max_length": 3, "text_fields": ["input_text", 5]}, {"type": "other"}, {},
                {"type": "required_fields", "fields": "x"}, {"type": "required_fields"}, {"type": "required_fields", "fields": ["n", "output_text", "k"]},
                {"type": "format_validation", "field": "input_text", "pattern": ""}, {"type": "format_validation", "field": "input_text", "pattern": "(x"},
                {"type": "format_validation", "field": "k", "pattern": "(?P<a>v)(?P=a)\\Z"}, {"type": "format_validation", "field": "n", "pattern": "7$"},
            ]
        },
        "Gone": {}, "B": {"description": "said", "modernbert_io_validation": True, "rate_limiting": {"enabled": True, "max_requests_per_minute": 5}},
    }
    df = spark.createDataFrame(
        [(1, "a", "long text", None, 0, {"k": "vv"}), (2, "A", "", "x", 7, {"k": "v"}), (3, "b", "", "", 1, None), (4, "gone", "", "", 1, None)],
        "request_id int, api_class string, input_text string, output_text string, n int, extra map<string,string>",
    )
    shown = ["request_id", "overall_status", "violation_reasons", "checks_skipped", "error_message"]
    one = sorted(map(str, requests.validate(df, odd).select(shown).collect()))
    other = sorted(map(str, requests.validate(df, policy_rows(spark, odd)).select(shown).collect()))
    assert one == other
    told = {r["request_id"]: r for r in requests.validate(df, odd).collect()}
    assert told[1]["violation_reasons"] == [
        "Invalid 'text_length_limit' rule config at index 0.", "Custom rule at index 1 is not a valid object.", "Custom rule at index 2 is not a valid object.",
        "Invalid 'text_length_limit' rule config at index 3.", "Field 'input_text' (length 9) exceeds maximum length of 3 characters.",
        "Invalid 'required_fields' rule config at index 7.", "Required field 'n' is missing or empty.", "Required field 'output_text' is missing or empty.",
        "Invalid 'format_validation' rule config at index 10.",
        "Invalid regex pattern in 'format_validation' for field 'input_text': missing ), unterminated subpattern at position 0",
        "Field 'n' does not match required format pattern.",
    ]
    assert told[2]["violation_reasons"][-1] == "Field 'k' does not match required format pattern."
    assert told[3]["overall_status"] == "PASS" and told[3]["checks_skipped"] == ["modernbert_io_validation"]
    assert told[4]["overall_status"] == "REJECT_INVALID_POLICY"
    limits = {r["policy_name"]: r["rate_limit"] for r in policies.policy_table(spark, policy_rows(spark, odd)).collect()}
    assert limits == {"a": None, "b": 5}


def test_a_policy_table_too_large_to_broadcast(spark, monkeypatch):
    df = frame(spark, [(i, f"POLICY{i % 9}", "text", "") for i in range(40)])
    want = sorted(map(str, requests.validate(df, many_policies(8)).collect()))
    monkeypatch.setattr(policies, "small_side", lambda table: table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = requests.validate(df, policy_rows(spark, many_policies(8)))
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
