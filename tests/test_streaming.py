"""Streams over files: order, late rows and state."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tollgate.operators import config, handshake
from tollgate.session import scratch_path
from tollgate.streaming import jobs
from tollgate.streaming.items import validate_arriving

SCHEMA = "token string, log_id long, ts timestamp, expiry timestamp"


def write_batches(spark, batches, schema):
    """One file per batch, in order of modification time."""
    path = scratch_path(spark, "stream-test")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def run(stream, label, schema=None):
    path = jobs.run_available(stream, label)
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(path).collect()


def issued(token, log_id, second, issue=0, life=300):
    return (token, log_id, at(second), at(issue + life))


def test_token_decisions_over_batches(spark):
    batches = [
        [issued("a", 3, 30), issued("a", 1, 10), issued("b", 2, 20)],
        [issued("a", 4, 5), issued("b", 5, 40), issued("c", 6, 50), issued("c", 7, 301)],
    ]
    path = write_batches(spark, batches, SCHEMA)
    rows = run(jobs.token_uses(jobs.read_files(spark, path, SCHEMA, files_per_trigger=1)), "tokens")
    got = {r["log_id"]: r["outcome"] for r in rows}
    # use 4 came late: the token had passed already
    assert got == {1: "first", 3: "replay", 2: "first", 4: "replay", 5: "replay", 6: "first", 7: "expired"}


# Uses of one token far apart, other tokens between them, one file each; ``d`` is used after its life only.
SPENT = [
    [issued("a", 1, 0), issued("b", 2, 20, 20), issued("b", 3, 90, 20)],
    [issued("a", 4, 1800), issued("c", 5, 1800, 1800)],
    [issued("a", 6, 3600), issued("c", 7, 1900, 1800)],
    [issued("a", 8, 5400), issued("d", 9, 5400, 0), issued("e", 10, 5400, 5400)],
    [issued("a", 11, 9000), issued("f", 12, 9000, 9000)],
]
OUTCOMES = {1: "first", 2: "first", 3: "replay", 4: "expired", 5: "first", 6: "expired", 7: "replay", 8: "expired", 9: "expired", 10: "first", 11: "expired", 12: "first"}


def test_spent_tokens_never_pass_again(spark):
    path = write_batches(spark, SPENT, SCHEMA)
    batch = handshake.outcomes(spark.read.parquet(path))
    assert {r["log_id"]: r["outcome"] for r in batch.collect()} == OUTCOMES

    def source():
        return jobs.read_files(spark, path, SCHEMA, files_per_trigger=1)

    passed = run(jobs.first_uses(source()), "first")
    assert sorted(r["log_id"] for r in passed) == [i for i, o in OUTCOMES.items() if o == "first"]
    decided = run(jobs.token_uses(source()), "uses")
    assert {r["log_id"]: r["outcome"] for r in decided} == OUTCOMES
    stream, finish = jobs.with_end(source(), "ts", "expiry")
    lives = jobs.token_lives(stream)
    sink = jobs.run_available(lives, "lives", finish=finish)
    rows = spark.read.schema(lives.schema).parquet(sink).collect()
    assert sorted((r["token"], r["first_use"], r["replays"], r["expired"]) for r in rows) == [
        ("a", 1, 0, 2), ("b", 2, 1, 0), ("c", 5, 1, 0), ("e", 10, 0, 0), ("f", 12, 0, 0),
    ]


def test_steady_replays_do_not_prolong_a_life(spark):
    rows = [[issued("a", i, 100 * i)] for i in range(5)]
    path = write_batches(spark, rows, SCHEMA)
    got = run(jobs.token_uses(jobs.read_files(spark, path, SCHEMA, files_per_trigger=1)), "steady")
    assert {r["log_id"]: r["outcome"] for r in got} == {0: "first", 1: "replay", 2: "replay", 3: "replay", 4: "expired"}


def test_a_finished_input_is_written_to_the_end(spark):
    schema = "ts timestamp, metric string, value double"
    path = write_batches(spark, [[(at(0), "m", 5.0)], [(at(3600), "m", 7.0), (at(3601), "n", 1.0)]], schema)
    settings = spark.createDataFrame([("m", 1.0), ("n", 3.0)], "metric string, threshold double")
    for ended, want in ((False, 1), (True, 2)):
        stream, finish = jobs.with_end(jobs.read_files(spark, path, schema, files_per_trigger=1), "ts")
        found = jobs.alerts(stream, settings, "5 minutes")
        sink = jobs.run_available(found, "ended", finish=finish if ended else None)
        assert spark.read.schema(found.schema).parquet(sink).count() == want


def test_late_rows_are_dropped_and_counted(spark):
    schema = "ts timestamp, policy string, user_id long"
    batches = [
        [(at(0), "p", 1), (at(10), "p", 1), (at(20), "p", 1)],
        [(at(7200), "p", 2)],
        [(at(7201), "p", 2)],
        # rows are late from the second batch after the watermark has passed them
        [(at(30), "p", 1), (at(20000), "q", 3)],
    ]
    path = write_batches(spark, batches, schema)
    source = jobs.read_files(spark, path, schema, files_per_trigger=1)
    counted = jobs.rate_limit(source, ["policy", "user_id"], 1, "1 minute", "10 minutes")
    base = scratch_path(spark, "late")
    query = (
        counted.writeStream.format("parquet").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(f"{base}/r")
    )
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    rows = spark.read.parquet(f"{base}/r").collect()
    assert dropped == 1
    assert sorted((r["user_id"], r["calls"]) for r in rows) == [(1, 3), (2, 2)]


def test_handshake_join_over_batches(spark):
    schema = "transaction_id long, token string, auth_ts timestamp, exec_ts timestamp, auth_hash string, exec_hash string"
    batches = [
        [(1, "t1", at(0), at(10), "h", "h"), (2, "t2", at(0), at(1000), "h", "h")],
        [(3, "t3", at(60), at(61), "h", "x")],
    ]
    path = write_batches(spark, batches, schema)
    a = jobs.read_files(spark, path, schema).select("transaction_id", "token", "auth_ts", "auth_hash")
    e = jobs.read_files(spark, path, schema).select("transaction_id", "token", "exec_ts", "exec_hash")
    rows = run(jobs.matched_phases(a, e), "phases")
    assert sorted((r["transaction_id"], r["bound"]) for r in rows) == [(1, True), (3, False)]


def test_config_decisions(spark):
    roles = spark.createDataFrame([("t-e", "enterprise"), ("t-a", "app-team")], "token string, role string")
    good = '{"name":"n","targetMetric":"m","dataClassification":"Public","quickAlertHeuristic":{"threshold":0.85,"window":"5m"},"reason":"r","gpu_config":%s}'
    rows = [
        (1, 10, "enterprise", "t-e", good % '{"type":"A100"}'),
        (2, 20, "enterprise", "t-e", good % '"A100"'),
        (3, 30, "enterprise", "t-a", good % '{"type":"A100"}'),
        (4, 40, "enterprise", "zzz", "{}"),
        (5, 50, "enterprise", "t-e", '{"name": 5}'),
        (6, 60, "integration", "t-a", '{"customThresholds":{"accuracy":"x"},"businessMetric":"b","reason":"r"}'),
        (7, 70, "integration", "t-a", '{"customThresholds":{},"businessMetric":"b","reason":"r","callbackUrl":"u"}'),
    ]
    changes = spark.createDataFrame(rows, "change_id long, ts long, schema_type string, token string, body string")
    got = {r["change_id"]: (r["status_code"], r["detail"]) for r in config.apply_changes(changes, roles).collect()}
    assert got[1] == (200, None) and got[7] == (200, None)
    assert got[2] == (400, "Field 'gpu_config' is not of type 'object'")
    assert got[3] == (403, "Enterprise access required") and got[4] == (401, "Invalid token")
    assert "Required field 'reason' missing" in got[5][1] and "Field 'name' is not of type 'string'" in got[5][1]
    assert got[6] == (400, "Field 'customThresholds.accuracy' is not of type 'number'")
    accepted = config.apply_changes(changes, roles).filter("status_code = 200")
    assert {r["field"] for r in config.new_fields(accepted).collect()} == {"gpu_config", "callbackUrl"}


def test_a_refused_change_records_no_type(spark):
    good = '{"modelVersion":"v","validationParameters":{},"reason":"r",%s}'
    bodies = ['"x":"t"', '"x":1,"y":"t"', '"y":2,"z":[]', '"y":"t"', '"z":[],"y":3', '"w":1,"z":"t"', '"w":"t"']
    rows = [(i + 1, (i + 1) * 10, "runtime", "t", good % b) for i, b in enumerate(bodies)]
    changes = spark.createDataFrame(rows, "change_id long, ts long, schema_type string, token string, body string")
    roles = spark.createDataFrame([("t", "lob-it")], "token string, role string")
    decided = config.apply_changes(changes, roles)
    assert {r["change_id"]: r["status_code"] for r in decided.collect()} == {1: 200, 2: 400, 3: 200, 4: 400, 5: 200, 6: 400, 7: 200}
    valid = config.validate_bodies(config.authorise(changes, roles))
    assert {(r["field"], r["json_type"], r["first_change"]) for r in config.new_fields(valid).collect()} == {
        ("x", "string", 1), ("y", "number", 3), ("z", "array", 3), ("w", "string", 7),
    }
    assert {(r["change_id"], r["field"]) for r in config.type_conflicts(valid).collect()} == {(2, "x"), (4, "y"), (6, "z")}


def test_duration_texts():
    from tollgate.functions.text import duration_interval

    assert duration_interval("5m") == "5 minutes" and duration_interval(" 30 s") == "30 seconds"
    with pytest.raises(ValueError):
        duration_interval("soon")


def test_stream_reader_takes_folders_and_files(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = jobs.read_files(spark, path, spark.read.parquet(path).schema)
    assert stream.isStreaming
    rows = run(stream.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "files")
    assert len(rows) == spark.read.parquet(path).count()


def test_settled_types_equal_one_by_one(spark):
    """Random changes with shared and disputed fields, against a loop over the changes in order."""
    rng = random.Random(9)
    rows, changes = [], []
    for change in range(300):
        fields = {f"f{rng.randrange(14)}": rng.choice(["string", "string", "number"]) for _ in range(rng.randrange(1, 4))}
        fields = {f: "string" if f in ("f0", "f1", "f2") else kind for f, kind in fields.items()}
        changes.append((change, fields))
        rows += [("s", change // 3, change, f, kind) for f, kind in fields.items()]
    recorded = {}
    for change, fields in changes:
        if all(recorded.get(f, (kind, 0))[0] == kind for f, kind in fields.items()):
            for f, kind in fields.items():
                recorded.setdefault(f, (kind, change))
    df = spark.createDataFrame(rows, "schema_type string, ts long, change_id long, field string, json_type string")
    found = config._settled_types(df).collect()
    assert {r["field"]: (r["recorded_type"], r["first_change"]) for r in found} == recorded and len(found) == len(recorded)
    plain = df.filter("field IN ('f0', 'f1', 'f2')")
    assert {r["recorded_type"] for r in config._settled_types(plain).collect()} == {"string"}


def test_late_rows_are_a_result(spark):
    path, schema = scratch_path(spark, "late-in"), "ts timestamp, kind string, n int"
    job = jobs.LateRows(spark, scratch_path(spark, "late-out"), ["kind"], "1 minute", late="2 minutes")
    batches = [
        [(at(0), "a", 1), (at(30), "a", 2), (at(400), "b", 3), (None, "b", 4)],
        # before the mark of 280 s: windows that end at 240 s or less are late, the one that ends at 300 s is not
        [(at(10), "a", 5), (at(239), "a", 6), (at(240), "a", 7), (at(410), None, 8)],
        [],
        [(at(20), "a", 9), (at(900), "b", 10)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        job.run_available(spark.readStream.schema(schema).parquet(path))
    got = {(r["window_start"], r["kind"]): (r["in_time"], r["late"]) for r in job.counts().collect()}
    assert got == {
        (at(0), "a"): (2, 2), (at(180), "a"): (0, 1), (at(240), "a"): (1, 0), (at(360), "b"): (1, 0), (at(360), None): (1, 0), (at(900), "b"): (1, 0),
    }
    assert sorted(r["n"] for r in job.late_rows().collect()) == [5, 6, 9]
    total = job.progress().agg(F.sum("rows"), F.sum("late"), F.sum("untimed")).first()
    assert tuple(total) == (10, 3, 1)
    # a batch that is repeated replaces its rows
    last = job.progress().agg(F.max("batch")).first()[0]
    job.step(spark.createDataFrame(batches[3], schema), last)
    assert sorted(r["n"] for r in job.late_rows().collect()) == [5, 6, 9]


def test_a_new_policy_version_takes_effect_while_the_stream_runs(spark):
    schema = "ts timestamp, api_class string, user_id long"
    versions = "policy_name string, ts timestamp, version_id long, body string"
    calls, table = scratch_path(spark, "calls"), scratch_path(spark, "versions")

    def add_version(second, number, body):
        spark.createDataFrame([("Gate", at(second), number, body)], versions).write.mode("append").parquet(table)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(calls)
        job.run_available(spark.readStream.schema(schema).parquet(calls))

    def limit(number, enabled=True):
        return '{"rate_limiting": {"enabled": %s, "max_requests_per_minute": %d}}' % (str(enabled).lower(), number)

    job = jobs.VersionedRateLimit(spark, scratch_path(spark, "limits"), lambda: spark.read.parquet(table), "0 seconds")
    add_version(0, 1, limit(1))
    arrive([(at(0), "gate", 1), (at(5), "GATE", 1), (at(6), "gate", None), (at(70), "gate", 2), (at(71), "gate", 2), (at(200), "none", 1), (at(201), "none", 1)])
    arrive([(at(3600), "gate", 1)])
    assert {(r["user_id"], r["calls"], r["allowed"]) for r in job.rows().collect()} == {(1, 2, 1), (2, 2, 1)}
    # a limit of two from here on, then one that is no JSON, then none at all
    add_version(3600, 2, limit(2))
    add_version(3660, 3, "[")
    arrive([(at(3601), "gate", 1), (at(3665 + 2), "gate", 3), (at(3668), "gate", 3), (at(3669), "gate", 3)])
    add_version(7200, 4, limit(0, enabled=False))
    arrive([(at(7200), "gate", 1), (at(7201), "gate", 1), (at(7300), "gate", 1)])
    arrive([(at(9000), "gate", 1)])
    # a call before the first version is limited by none
    got = {(r["window_start"].minute, r["user_id"], r["calls"], r["allowed"]) for r in job.rows().collect()}
    assert got == {(0, 1, 2, 1), (1, 2, 2, 1), (1, 3, 3, 2)}


ITEM_POLICIES = {
    "Media": {
        "strict_item_type_matching": True,
        "colbert_input_sensitivity": True,
        "disallowed_colbert_input_classes": ["Class 1: PII"],
        "item_processing_rules": [
            {"item_type": "image", "vlm_processing": {"required": True},
             "derived_text_checks": {"colbert_sensitivity": True, "disallowed_classes": ["Class 1: PII"], "blocked_keywords": ["Secret"]}}
        ],
        "custom_validation_rules": [{"type": "required_fields", "fields": ["user_id"]}],
    },
    "Plain": {"custom_validation_rules": []},
}
ITEM_REQUESTS = "request_id long, ts timestamp, api_class string, user_id string, input_text string, output_text string, input_items string"
ITEM_FILES = "request_id long, file_name string, ts timestamp, description string"


def image(name, kind="image"):
    return '{"id": "%s", "type": "%s", "filename_in_form": "%s"}' % (name, kind, name)


def test_items_and_files_of_streams_equal_the_batch(spark):
    from tollgate import api

    examples = {"Class 1: PII": ["SSN: 123-45-6789"], "Class 4: Public": ["Press release for the public"]}

    def asked(number, second, items, gate="media", user="u", text="a press release"):
        return (number, at(second) if second is not None else None, gate, user, text, "", items)

    batches = [
        [asked(1, 0, f"[{image('a')}, {image('b')}]"), asked(2, 10, f"[{image('a')}]", user=None), asked(3, 20, "[]"), asked(4, 30, None, text="ssn: 123-45-6789")],
        [asked(5, 700, '{"no": "list"}'), asked(6, 710, f"[{image('a')}, 7, {image('x', 'audio')}]", text="ssn: 123-45-6789"), asked(7, 720, f"[{image('a')}]", gate="plain")],
        [asked(8, 1500, f"[{image('a')}]", gate="none"), asked(9, 1510, "broken ["), asked(10, 1520, f"[{image('a')}]"), asked(11, 1530, '[{"type": "image"}]')],
    ]
    given = [
        [(1, "a", at(1), "a top SECRET place"), (2, "a", at(10), "press release"), (2, "other", at(11), "secret")],
        # the second file of request 1 comes with a later batch; the same file again counts once
        [(1, "b", at(600), "card with ssn: 123-45-6789"), (1, "a", at(500), "press release"), (6, "a", at(720), "")],
        # too late for its request, and before its request
        [(10, "a", at(1520 + 601), "press release"), (11, "", at(1531), "secret"), (9, "a", at(1500), "x")],
    ]
    requests_path, files_path = write_batches(spark, batches, ITEM_REQUESTS), write_batches(spark, given, ITEM_FILES)
    incoming, no_more_requests = jobs.with_end(jobs.read_files(spark, requests_path, ITEM_REQUESTS, files_per_trigger=1), "ts")
    files, no_more_files = jobs.with_end(jobs.read_files(spark, files_path, ITEM_FILES, files_per_trigger=1), "ts")

    def finish():
        no_more_requests()
        no_more_files()

    checked = api.validate_stream(incoming, ITEM_POLICIES, files, examples=examples)
    sink = jobs.run_available(checked, "items", finish=finish)
    rows = spark.read.schema(checked.schema).parquet(sink).collect()
    got = {r["request_id"]: (r["overall_status"], r["violation_reasons"], r["checks_skipped"], r["error_message"]) for r in rows}
    counted = [f for f in sum(given, []) if f[:3] not in ((1, "a", at(500)), (10, "a", at(2121)), (9, "a", at(1500)))]
    batch = api.validate(
        spark.createDataFrame(sum(batches, []), ITEM_REQUESTS), ITEM_POLICIES, spark.createDataFrame(counted, ITEM_FILES).drop("ts"), examples=examples
    )
    want = {r["request_id"]: (r["overall_status"], r["violation_reasons"], r["checks_skipped"], r["error_message"]) for r in batch.collect()}
    assert len(rows) == 11 and got == want
    assert [m.split(" ")[0] for m in got[1][1]] == ["VLM-derived", "VLM-derived"] and len(got[6][1]) == 3 and got[3][0] == "PASS"


def test_a_request_without_a_time_cannot_wait_for_files(spark):
    rows = [(1, None, "media", "u", "", "", f"[{image('a')}]"), (2, None, "plain", "u", "", "", f"[{image('a')}]")]
    path = write_batches(spark, [rows], ITEM_REQUESTS)
    none = scratch_path(spark, "no-files")
    spark.createDataFrame([], ITEM_FILES).write.parquet(none)
    checked = validate_arriving(
        jobs.read_files(spark, path, ITEM_REQUESTS).withColumn("input_class", F.lit("Class 4: Public")), ITEM_POLICIES, spark.readStream.schema(ITEM_FILES).parquet(none)
    )
    sink = jobs.run_available(checked, "timeless")
    got = {r["request_id"]: (r["overall_status"], r["checks_skipped"]) for r in spark.read.schema(checked.schema).parquet(sink).collect()}
    assert got == {1: ("PASS", ["item_processing_rules"]), 2: ("PASS", [])}


def test_a_finished_table_in_time_order_keeps_little_state(spark):
    schema = "n long, ts timestamp, user_id long"
    rows = [(n, at((n * 7919) % 40000) if n % 50 else None, n % 3) for n in range(400)]
    table = spark.createDataFrame(rows, schema).repartition(5)
    folder = jobs.write_in_time_order(table, rows_each=100)
    stream = jobs.read_files(spark, folder, schema, files_per_trigger=1)
    counted = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute"), "user_id").count()
    base = scratch_path(spark, "ordered")
    query = counted.writeStream.format("parquet").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(f"{base}/r")
    query.awaitTermination()
    operators = [op for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(op["numRowsDroppedByWatermark"] for op in operators) == 0
    # two spans at most, not the 392 windows of the table
    assert 0 < max(op["numRowsTotal"] for op in operators) <= 230
    got = sorted((r["window"]["start"], r["user_id"], r["count"]) for r in spark.read.parquet(f"{base}/r").collect())
    want = table.filter("ts IS NOT NULL").groupBy(F.window("ts", "1 minute"), "user_id").count().collect()
    assert got == sorted((r["window"]["start"], r["user_id"], r["count"]) for r in want)


def test_a_table_of_one_time_is_one_span(spark):
    schema = "n long, ts timestamp"
    for times in ([at(0)] * 30, [None] * 30, []):
        table = spark.createDataFrame([(n, t) for n, t in enumerate(times)], schema)
        written = spark.read.parquet(jobs.write_in_time_order(table, rows_each=10))
        assert written.filter(F.coalesce(F.col("ts") < F.lit(jobs.FAR), F.lit(True))).count() == len(times)
        assert written.filter(F.col("ts") == F.lit(jobs.FAR)).count() == 1


def test_stream_items_in_many_spans_equal_the_sql(spark, sf_dir, monkeypatch):
    import functools

    import check_sql
    from tollgate.plans import catalog

    catalog.load()
    monkeypatch.setattr(jobs, "write_in_time_order", functools.partial(jobs.write_in_time_order, rows_each=300))
    good, text = check_sql.compare(spark, sf_dir, "stream_items")
    assert good, text


@pytest.mark.parametrize("others", [0, 80])
def test_descriptions_of_files_are_read_where_they_arrive(spark, others):
    """Messages are those of the batch; the texts stay out of the state unless the words are too many to look for."""
    from pathlib import Path

    from tollgate.operators import items, requests

    rng = random.Random(4)
    noise = ["".join(rng.choices("bcdfghjklmnpqrstvwxyz0123456789", k=20000)) for _ in range(60)]
    words = ["Zebra", "ÜBER", "oak"]
    rule = {"item_type": "image", "vlm_processing": {"required": True}, "derived_text_checks": {"blocked_keywords": words + [f"none{n}" for n in range(others)]}}
    policies = {"Media": {"item_processing_rules": [rule]}, "Other": {"item_processing_rules": [{**rule, "derived_text_checks": {"blocked_keywords": ["oak"]}}]}}
    ends = ["an OAK", "über a zebra", "", "plain"]
    asked = [(n, at(n), ("media", "other")[n % 2], "u", "", "", f"[{image('a')}]") for n in range(60)]
    given = [(n, "a", at(n + 1), None if n % 15 == 7 else "" if n % 15 == 8 else noise[n] + " " + ends[n // 2 % 4]) for n in range(60) if n % 15 != 9]
    requests_path, files_path = write_batches(spark, [asked], ITEM_REQUESTS), write_batches(spark, [given], ITEM_FILES)
    checked = validate_arriving(
        jobs.read_files(spark, requests_path, ITEM_REQUESTS), policies, jobs.read_files(spark, files_path, ITEM_FILES)
    )
    sink = jobs.run_available(checked, "described")
    state = sum(p.stat().st_size for p in (Path(sink.removeprefix("file:")).parent / "checkpoint" / "state").rglob("*") if p.is_file())
    assert (state > 600_000) if others else (state < 300_000)

    incoming, no_more_requests = jobs.with_end(jobs.read_files(spark, requests_path, ITEM_REQUESTS), "ts")
    files, no_more_files = jobs.with_end(jobs.read_files(spark, files_path, ITEM_FILES), "ts")
    ended = validate_arriving(incoming, policies, files)
    sink = jobs.run_available(ended, "described-ended", finish=lambda: (no_more_requests(), no_more_files()))
    got = {r["request_id"]: r["violation_reasons"] for r in spark.read.schema(ended.schema).parquet(sink).collect()}
    batch = spark.createDataFrame(asked, ITEM_REQUESTS)
    told = items.item_messages(items.attach_files(items.explode_json_items(batch), spark.createDataFrame(given, ITEM_FILES)), policies)
    want = {r["request_id"]: r["violation_reasons"] for r in requests.validate(batch, policies, items.regroup(told)).collect()}
    assert got == want and {m.split(": ")[-1] for own in want.values() for m in own if "blocked" in m} == {"oak.", "Zebra, ÜBER."}
