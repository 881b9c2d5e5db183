"""The composite jobs end to end with the built-in models."""

from pyspark.sql import functions as F

from tollgate import api
from tollgate.operators import pairs
from tollgate.session import scratch_path

EXAMPLES = {"Class 1: PII": ["SSN: 123-45-6789"], "Class 4: Public": ["Press release for the public"]}
POLICIES = {
    "Gate": {
        "description": "Personal data policy.",
        "modernbert_io_validation": True,
        "colbert_input_sensitivity": True,
        "disallowed_colbert_input_classes": ["Class 1: PII"],
        "item_processing_rules": [
            {"item_type": "image", "vlm_processing": {"required": True},
             "derived_text_checks": {"colbert_sensitivity": True, "disallowed_classes": ["Class 1: PII"]}}
        ],
        "documentation_assistance": {"enabled": True, "index_path": "docs", "max_total_suggestions": 2},
    },
    "Open": {"custom_validation_rules": []},
}


def test_validate_with_models_and_help(spark):
    data = spark.createDataFrame(
        [(1, "gate", "ssn: 123-45-6789", "fine", [("a", "image", "a.png")]),
         (2, "gate", "a press release", "fine", []),
         (3, "open", "ssn: 123-45-6789", "bad bad", [])],
        "request_id long, api_class string, input_text string, output_text string, items array<struct<id string, type string, filename_in_form string>>",
    )
    files = spark.createDataFrame([(1, "a.png", "card with ssn: 123-45-6789")], "request_id long, file_name string, description string")
    pairs_table = spark.createDataFrame(
        [(i, "q", "fine" if i % 2 else "bad", float(i % 2)) for i in range(40)], "id long, input_text string, output_text string, label double"
    )
    model = pairs.train(pairs_table)
    results = api.validate(data, POLICIES, files, model, EXAMPLES)
    got = {r["request_id"]: r for r in results.collect()}
    assert got[1]["violation_reasons"] == [
        "Input text classified as disallowed sensitivity: 'Class 1: PII'.",
        "VLM-derived text for item 'a' classified as disallowed sensitivity: 'Class 1: PII'.",
    ]
    assert got[2]["violation_reasons"] == [] and got[3]["overall_status"] == "PASS" and got[1]["checks_skipped"] == []
    path = scratch_path(spark, "help-index")
    docs = spark.createDataFrame(
        [("handling.md", "# Handling\n## PII\nHandling PII and data privacy."), ("other.md", "# Zoo\nAnimals only.")], "source string, text string"
    )
    index = api.build_index(docs, path)
    shown = api.suggest_help(results, POLICIES, index).orderBy("rank").collect()
    assert {r["request_id"] for r in shown} == {1} and "Handling: PII" in {r["suggestion"]["title"] for r in shown}


def test_code_index_and_retrieval(spark):
    code = 'def add(a, b):\n    """Adds numbers."""\n    return a + b\n\n\nclass C:\n    def method_one(self):\n        """Method one docstring."""\n        return 1\n'
    files = spark.createDataFrame([("m.py", code)], "path string, code string")
    index = api.build_code_index(files, scratch_path(spark, "code-index"))
    asked = spark.createDataFrame([(1, "method one docstring"), (2, " ")], "query_id int, query string")
    rows = api.retrieve(asked, index, 1).orderBy("query_id").collect()
    assert rows[0]["id"] == "m.py#method_C_method_one" and rows[0]["error"] is None
    assert rows[1]["id"] is None and rows[1]["error"]


def test_handshake_findings(spark):
    auth = spark.createDataFrame([(1, "t1", 0, 300, "h"), (2, "t2", 0, 300, "h"), (3, "t3", 0, 300, "h"), (4, "t4", 0, 300, "h")],
                                 "transaction_id long, token string, auth_ts long, expiry long, auth_hash string")
    done = spark.createDataFrame([(1, "t1", 10, "h"), (2, "t2", 400, "h"), (3, "t3", 20, "x"), (5, "t1", 30, "h")],
                                 "transaction_id long, token string, exec_ts long, exec_hash string")
    got = {(r["transaction_id"], r["finding"]) for r in api.check_handshakes(auth, done).collect()}
    assert got == {
        (2, "outside token life"), (3, "parameters changed"), (4, "not executed"), (5, "not authorised"), (5, "token replayed"),
    }


def test_audit_and_review(spark):
    log = spark.createDataFrame(
        [
            (1, "u", "pay", "send", 1, "b", ["TransactionBoundTokens", "AtomicTokenConsumption", "DualAgentValidation"]),
            (2, "u", "pay", "send", 2, "x", []),
            (3, "u", "new", "send", 5, None, []),
            (4, "u", "pay", "list", 3, "b", ["TransactionBoundTokens", "AtomicTokenConsumption"]),
        ],
        "log_id long, use_case string, tool string, action string, class_no int, breadcrumb string, performed array<string>",
    )
    actions = spark.createDataFrame([("u", "pay", "send", 1), ("u", "pay", "list", 3)], "use_case string, tool string, action string, class_no int")
    crumbs = spark.createDataFrame([("u", "b")], "use_case string, breadcrumb string")
    got = {(r["log_id"], r["finding"]) for r in api.audit_invocations(log, actions, crumbs).collect()}
    assert {(2, "breadcrumb mismatch"), (2, "sensitivity drift"), (3, "breadcrumb missing"), (3, "unregistered action")} <= got
    assert not any(i in (1, 4) for i, _ in got) and (2, "missing DualAgentValidation") in got
    responses = spark.createDataFrame([(1, 'execute_code(code="import os")'), (2, "kill_process(pid=3)")], "id int, response string")
    decisions = spark.createDataFrame([(1, None, "APPROVE"), (2, "deny", "APPROVE")], "id int, human string, confirmation string")
    rows = {r["id"]: r for r in api.review_proposals(responses, decisions).collect()}
    assert rows[1]["outcome"] == "approved" and rows[1]["problem"] == "Disallowed AST node type used: Import"
    assert rows[2]["outcome"] == "denied" and rows[2]["problem"] is None


def test_pebbles_and_config(spark):
    log = spark.createDataFrame([("u", '{"a": 1}', "bad")], "use_case string, state string, proof string")
    assert not api.verify_pebbles(log, spark.createDataFrame([("u", "b")], "use_case string, breadcrumb string")).first()["verified"]
    changes = spark.createDataFrame(
        [(1, 1, "runtime", "t", '{"modelVersion":"v","validationParameters":{},"reason":"r","operational_metric":"x"}')],
        "change_id long, ts long, schema_type string, token string, body string",
    )
    done = api.apply_config_changes(changes, spark.createDataFrame([("t", "lob-it")], "token string, role string"))
    assert done["decisions"].first()["status_code"] == 200
    assert done["new_fields"].first()["json_type"] == "string"


def test_images(spark):
    df = spark.createDataFrame([("p", ["c"], "x", 0.5)], "policy_name string, captions array<string>, classified_as string, confidence double")
    assert api.check_images(df, {"P": {"zero_shot_violation_rules": [{"if_classified_as": "X"}]}}).first()["status"] == "violation"
    assert api.classify_sensitivity(df.withColumn("text", F.lit("ssn"))).first()["sensitivity"]["predicted_class"].startswith("Class")
