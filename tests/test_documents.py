"""Chunking, code, agent calls and sources on hand-made input."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tollgate.functions.canonical import breadcrumb, canonical_json, proof
from tollgate.operators import agent, chunking, code, pebbles
from tollgate.plans import views
from tollgate.session import scratch_path
from tollgate.sources import documents, index_store, logs, policies

SAMPLE_CODE = '''
import json

def top_level(a, b):
    """Adds."""
    return a + b

class Thing:
    """A thing."""
    size = 100

    def __init__(self, name):
        self.name = name

    def method_one(self):
        """Says hello."""
        return f"Hello {self.name}"

    def _hidden(self):
        pass
'''


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.!?é\U0001f600", max_size=400), st.integers(4, 60), st.integers(0, 80))
def test_splitter_properties(text, size, overlap):
    pieces = chunking.split_overlapping(text, size, overlap)
    if len(text) <= size:
        assert pieces == [text]
        return
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    covered = set()
    for piece in pieces:
        at = text.find(piece, at if at < len(text) else 0)
        found = text.find(piece)
        assert found >= 0
        start = 0
        while (start := text.find(piece, start)) >= 0:
            covered.update(range(start, start + len(piece)))
            start += 1
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_splitter_on_a_long_text():
    pieces = chunking.split_overlapping("This is a very long string. " * 100, 500, 125)
    assert len(pieces) > 1 and all(p.endswith(".") and len(p) <= 500 for p in pieces)


def test_markdown_headings_and_flags(spark):
    md = "# Header One\nFirst part.\n\n## Sub Header Two\nMore.\n```python\nprint('x')\n```\n# Next\nEnd\x85# not\n### deep\n"
    df = spark.createDataFrame([("d", md)], "src string, md string")
    rows = chunking.markdown_chunks(df, "md", "src", 500).orderBy("metadata.chunk_index").collect()
    heads = [(r["metadata"]["h1_section"], r["metadata"]["h2_section"]) for r in rows]
    assert heads == [("Header One", None), ("Header One", "Sub Header Two"), ("Next", None)]
    assert [r["metadata"]["contains_code_elements"] for r in rows] == [False, True, False]
    assert rows[0]["id"] == "fallback_chunk_d_0" and rows[2]["text"].endswith("### deep")
    whole = chunking.markdown_chunks(df, "md", "src", None).count()
    assert whole == 3


def test_model_answers(spark):
    good = 'Text\n    ```json\n    [\n  {"id": "t1", "text": " ok ", "metadata": {"h1_section": "S", "is_code_block": false, "topics": ["a"]}}\n    ]\n```\nend'
    bad = '```json\n[\n  {"id": "malformed", "text": "incomplete", \n]\n```'
    df = spark.createDataFrame([(1, good, "u"), (2, bad, "u"), (3, None, "u"), (4, '[{"text": "a [1] b"}, {"text": 3}]', "v")], "n int, answer string, src string")
    rows = chunking.model_chunks(df, "answer", "src").orderBy("n").collect()
    assert [(r["n"], r["id"], r["text"]) for r in rows] == [(1, "t1", "ok"), (4, "vlm_chunk_v_0", "a [1] b")]
    meta = rows[0]["metadata"]
    assert (meta["chunk_type"], meta["source_url"], meta["topics"], meta["vlm_processed"]) == ("content", "u", ["a"], True)


def test_long_chunks_get_parts(spark):
    df = spark.createDataFrame(
        [("big", "This is a very long string. " * 100, ("L", "s"))], "id string, text string, metadata struct<h1_section string, source_url string>"
    )
    parts = chunking.secondary_chunks(df, 500).collect()
    assert len(parts) > 1
    assert all(len(p["text"]) <= 500 and p["metadata"]["parent_chunk_id"] == "big" for p in parts)
    assert parts[0]["id"] == "big_part_1"


def test_code_chunks(spark):
    df = spark.createDataFrame([("f", SAMPLE_CODE), ("bad", "def (:\n")], "path string, code string")
    functions = code.code_chunks(df, "code", "functions").filter("path = 'f'").collect()
    assert [c["id"] for c in functions] == ["function_top_level", "method_Thing___init__", "method_Thing_method_one", "method_Thing__hidden"]
    assert functions[2]["docstring"] == "Says hello." and functions[2]["class_context"] == "Thing"
    classes = code.code_chunks(df, "code", "classes").collect()
    assert [c["type"] for c in classes] == ["class", "code_segment"]
    assert len(classes[0]["methods_signatures"]) == 3 and classes[0]["method_count"] == 3
    lines = code.code_chunks(df, "code", "lines", 120, 30).filter("path = 'f'").collect()
    assert len(lines) > 2 and lines[0]["estimated_start_line"] == 1
    kept = code.index_fields(code.code_chunks(df, "code", "classes"), "classes", ["path"])
    assert set(kept.schema["metadata"].dataType.names) == set(code.KEPT_FIELDS["classes"])


def test_code_audit():
    assert code.snippet_problem("with open('a/b.txt', 'w') as f:\n    f.write(str(1))", "/w") is None
    assert code.snippet_problem("open('/etc/passwd')", "/w").startswith("Path traversal")
    assert code.snippet_problem("open('a', mode)", "/w") == "Mode argument for 'open' must be a literal string."
    assert code.snippet_problem("x.__init__\nx.__dict__", "/w") == "Access to potentially unsafe attribute '__dict__' disallowed."
    assert code.snippet_problem("x = '\0'", "/w").startswith("Syntax error")


def test_tool_calls(spark):
    texts = [
        'kill_process(pid=12)\nI would stop it.\nexecute_code(code="print(\'a\')")',
        "NO_ACTIONS_NEEDED",
        "Sure! I will stop process 5.\nkill_process(pid=7)",
        'execute_code(code="a" + "b")\nkill_process(pid=07)',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    rows = agent.tool_calls(df, "id", "response").orderBy("id", "line_no").collect()
    assert [(r["id"], r["tool_name"], r["pid"] or r["code"]) for r in rows] == [
        (0, "kill_process", "12"), (0, "execute_code", "print('a')"), (2, "kill_process", "7"),
        (3, "execute_code", 'a" + "b'), (3, "kill_process", "07"),
    ]
    safe = agent.tool_calls(df, "id", "response").select("raw_call", agent.is_safe_call(F.col("raw_call")).alias("s")).collect()
    assert {r["raw_call"]: r["s"] for r in safe}['execute_code(code="a" + "b")'] is False


def test_canonical_json_and_proofs(spark):
    texts = ['{"b": [1, 2.50, "é"], "a": {"z": null, "y": true}}', "nope", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(canonical_json(F.col("t"))).collect()]
    assert got == [json.dumps(json.loads(texts[0]), sort_keys=True), None, None]
    row = df.limit(1).select(breadcrumb(F.col("t")).alias("b"), proof(canonical_json(F.col("t")), F.lit("s")).alias("p")).first()
    assert len(row["b"]) == 64 and len(row["p"]) == 64
    checked = pebbles.verify(df.limit(1).select(canonical_json(F.col("t")).alias("state"), F.lit("s").alias("breadcrumb"), F.lit(row["p"]).alias("proof")))
    assert checked.first()["verified"]


# --- sources ---------------------------------------------------------------------------------------


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext\n")
    (tmp_path / "b.md").write_text("B")
    rows = documents.read_documents(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.md"), str(tmp_path / "gone.md")]).collect()
    assert len(rows) == 2 and all(r["text"].startswith(f"\n\n# Source Document: {r['source']}\n\n") for r in rows)
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, [str(tmp_path / "gone.md")])


def test_corpus_and_chunk_files(spark, tmp_path):
    lines = [
        '{"id": 1, "text": "one", "metadata": {"category": "x"}, "difficulty": "hard"}', "{bad", '{"id": null, "text": "t"}',
        '{"id": "d4", "text": 5, "metadata": "none", "category": "top"}',
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = documents.read_corpus(spark, str(tmp_path / "c.jsonl"), metadata_fields=["category", "difficulty"]).orderBy("id").collect()
    assert [(r["id"], r["text"], r["metadata"]) for r in rows] == [
        ("1", "one", {"category": "x", "difficulty": "hard"}), ("d4", "5", {"category": "top"}),
    ]
    out = scratch_path(spark, "chunks")
    chunk = spark.createDataFrame([("c", "t")], "id string, text string")
    documents.write_chunks(chunk, out)
    assert spark.read.json(out).collect() == chunk.collect()


def test_images(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    row = documents.read_images(spark, str(tmp_path)).first()
    assert bytes(row["content"]) == b"\x89PNG" and row["length"] == 4


def test_index_life_cycle(spark):
    path = scratch_path(spark, "index-test")
    assert index_store.status(spark, path)["status"] == "does_not_exist"
    assert index_store.load_index(spark, path) is None
    rows = spark.createDataFrame([(str(i), f"text {i}", ("m",)) for i in range(3)], "id string, text string, metadata struct<topic string>")
    index_store.write_index(rows, path)
    state = index_store.status(spark, path)
    assert state["status"] == "exists_not_loaded" and state["num_documents"] == 3 and state["embedding_dimension"] == 64
    assert index_store.load_index(spark, path).count() == 3
    index_store.read_index(spark, path).limit(1).write.mode("append").parquet(f"{path}/documents")
    assert index_store.load_index(spark, path) is None
    spark.createDataFrame([("{broken",)], "value string").write.mode("overwrite").text(f"{path}/config")
    assert index_store.status(spark, path)["status"] == "exists_corrupt_config"


def test_policy_and_example_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(views.POLICIES))
    loaded = policies.load_policy_config(spark, str(tmp_path / "p.json"))
    assert set(loaded) == {"basicgate", "strictgate", "mediagate"}
    rows = {r["policy_name"]: r["policy"] for r in policies.read_policies(spark, str(tmp_path / "p.json")).collect()}
    assert rows["mediagate"]["item_processing_rules"][0]["derived_text_checks"]["blocked_keywords"] == views.IMAGE_WORDS
    assert policies.examples_table(spark).count() == 8


def test_logs_round_trip(spark):
    path = scratch_path(spark, "audit-test")
    assert logs.read_audit(spark, path, "runtime").count() == 0
    changes = spark.createDataFrame([("runtime", "lob-lob-it", '{"a": 1}'), ("enterprise", "e", "{}")], "schema_type string, author string, body string")
    logs.append_audit(logs.audit_entries(changes.withColumn("ts", F.timestamp_seconds(F.lit(0)))), path)
    only = logs.read_audit(spark, path, "runtime")
    assert [r["change"] for r in only.collect()] == ['{"a": 1}']
    assert "PartitionFilters: [isnotnull(schema_type" in only._jdf.queryExecution().executedPlan().toString()


def test_registry_files(spark, tmp_path):
    registry = {
        "use_case_id": "X-1",
        "tools_and_actions": [
            {"tool_system_id": "pay", "actions": [
                {"action_name": "run", "mcp_classification_attested_by_user": "Class1_PII", "mcp_classification_verified": "Class1_PII",
                 "mcp_handshake_extensions_required": ["TransactionBoundTokens"]},
                {"action_name": "status", "mcp_classification_attested_by_user": "Class2_SensitivePersonalData",
                 "mcp_classification_verified": "Class2_SensitivePersonalData", "mcp_handshake_extensions_required": []}]},
            {"tool_system_id": "ocr", "actions": [
                {"action_name": "scan", "mcp_classification_attested_by_user": "Class3_ConfidentialPersonalData",
                 "mcp_classification_verified": "Class3_ConfidentialPersonalData", "mcp_handshake_extensions_required": []}]},
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(registry, indent=1))
    from tollgate.operators import audit

    actions = logs.registry_actions(logs.read_registry(spark, str(tmp_path / "r.json")))
    assert actions.count() == 3
    numbered = actions.withColumn("class_no", audit.class_number(F.col("verified")))
    assert audit.overall_class(numbered).first()["label"] == "Class1_PII"
