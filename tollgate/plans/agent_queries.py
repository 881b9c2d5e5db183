"""Agent proposals, action log and source-code jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions.text import truncate_lines
from tollgate.operators import agent, code
from tollgate.plans import views
from tollgate.plans.catalog import query, view
from tollgate.session import spread
from tollgate.sources.logs import action_log_view as newest_first

view(
    "responses",
    """SELECT event_id, ts, CASE event_id % 7 WHEN 0 THEN 'NO_ACTIONS_NEEDED'
         WHEN 1 THEN 'kill_process(pid=' || user_id || ')' || chr(10) || 'execute_code(code="print(' || user_id || ')")'
         WHEN 2 THEN '  kill_process(pid= 12)' || chr(10) || 'I think process 5 should stop.' || chr(10) || chr(10) || 'execute_code(code=''x = "' || event_type || '"'')'
         WHEN 3 THEN 'delete_file(path="/x")' || chr(10) || 'execute_code( code = "a' || user_id || '" )'
         WHEN 4 THEN 'execute_code(code="import os")'
         WHEN 5 THEN 'kill_process(pid=' || event_id || ') ' || chr(10) || 'kill_process(pid=x)'
         ELSE 'NO_ACTIONS_NEEDED' || chr(10) || 'kill_process(pid=1)' END AS response FROM events""",
)


def as_responses(rows):
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = eid % 7
    text = (
        F.when(kind == 0, F.lit("NO_ACTIONS_NEEDED"))
        .when(kind == 1, F.concat(F.lit("kill_process(pid="), user, F.lit(')\nexecute_code(code="print('), user, F.lit(')")')))
        .when(
            kind == 2,
            F.concat(
                F.lit("  kill_process(pid= 12)\nI think process 5 should stop.\n\nexecute_code(code='x = \""),
                F.col("event_type"),
                F.lit("\"')"),
            ),
        )
        .when(kind == 3, F.concat(F.lit('delete_file(path="/x")\nexecute_code( code = "a'), user, F.lit('" )')))
        .when(kind == 4, F.lit('execute_code(code="import os")'))
        .when(kind == 5, F.concat(F.lit("kill_process(pid="), eid.cast("string"), F.lit(") \nkill_process(pid=x)")))
        .otherwise(F.lit("NO_ACTIONS_NEEDED\nkill_process(pid=1)"))
    )
    return rows.select("event_id", "ts", text.alias("response"))


view(
    "calls",
    r"""SELECT event_id, line_no - 1 AS line_no, raw_call, regexp_extract(raw_call, '^\s*(\w+)\((.*)\)\s*$', 1) AS tool_name,
         CASE WHEN raw_call LIKE 'kill_process(%' THEN nullif(regexp_extract(args, '^\s*pid=(\d+)\s*$', 1), '') END AS pid,
         CASE WHEN raw_call LIKE 'execute_code(%' THEN coalesce(nullif(regexp_extract(args, '^\s*code\s*=\s*"(.*)"\s*$', 1), ''),
              nullif(regexp_extract(args, '^\s*code\s*=\s*''(.*)''\s*$', 1), '')) END AS code
       FROM (SELECT event_id, line_no, raw_call, trim(regexp_extract(raw_call, '^\s*(\w+)\((.*)\)\s*$', 2)) AS args FROM
         (SELECT event_id, trim(unnest(string_split(trim(response), chr(10)))) AS raw_call,
            generate_subscripts(string_split(trim(response), chr(10)), 1) AS line_no FROM responses WHERE response <> 'NO_ACTIONS_NEEDED'))""",
    "responses",
)
view("parsed_calls", "SELECT * FROM calls WHERE pid IS NOT NULL OR code IS NOT NULL", "calls")


def parsed_calls(spark, sf_dir):
    return agent.tool_calls(as_responses(views.events(spark, sf_dir)), "event_id", "response")


@query(
    "tool_calls",
    "SELECT event_id, line_no::INTEGER AS line_no, raw_call, tool_name, coalesce(pid, '') AS pid, coalesce(code, '') AS code FROM parsed_calls",
    "parsed_calls",
)
def tool_calls(spark, sf_dir):
    return parsed_calls(spark, sf_dir).select(
        "event_id", "line_no", "raw_call", "tool_name",
        F.coalesce("pid", F.lit("")).alias("pid"), F.coalesce("code", F.lit("")).alias("code"),
    )


_SAFE = r"""(regexp_matches(raw_call, '^kill_process\(pid=\d+\)$') OR regexp_matches(raw_call, '^execute_code\(code="((\\.)|[^"])*"\)$')
           OR regexp_matches(raw_call, '^execute_code\(code=''((\\.)|[^''])*''\)$'))"""


@query("call_safety", f"SELECT event_id, raw_call, {_SAFE} AS safe FROM parsed_calls", "parsed_calls")
def call_safety(spark, sf_dir):
    calls = parsed_calls(spark, sf_dir)
    return calls.select("event_id", "raw_call", agent.is_safe_call(F.col("raw_call")).alias("safe"))


view(
    "decisions",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'approve' END AS human,
         CASE event_id % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'DENY too risky' WHEN 2 THEN 'ERROR_LLM_COMMUNICATION: APPROVE' ELSE 'APPROVE with care' END AS confirmation
       FROM events""",
)


def decisions(spark, sf_dir):
    eid = F.col("event_id")
    return views.events(spark, sf_dir).select(
        "event_id",
        F.when(eid % 5 == 0, "deny").when(eid % 5 == 1, "approve").alias("human"),
        F.when(eid % 4 == 0, "APPROVE")
        .when(eid % 4 == 1, "DENY too risky")
        .when(eid % 4 == 2, "ERROR_LLM_COMMUNICATION: APPROVE")
        .otherwise("APPROVE with care")
        .alias("confirmation"),
    )


@query("confirm_decision", "SELECT event_id, event_id % 4 IN (0, 3) AS approved FROM decisions", "decisions")
def confirm_decision(spark, sf_dir):
    return decisions(spark, sf_dir).select("event_id", agent.confirmed(F.col("confirmation")).alias("approved"))


@query(
    "approval_gate",
    f"""SELECT p.event_id, line_no::INTEGER AS line_no, CASE WHEN NOT {_SAFE} THEN 'rejected' WHEN CASE WHEN human IS NOT NULL THEN human <> 'deny'
         ELSE starts_with(confirmation, 'APPROVE') END THEN 'approved' ELSE 'denied' END AS outcome
       FROM parsed_calls p JOIN decisions d ON d.event_id = p.event_id""",
    "parsed_calls decisions",
)
def approval_gate(spark, sf_dir):
    gated = agent.approval_gate(parsed_calls(spark, sf_dir), decisions(spark, sf_dir), "event_id")
    return gated.select("event_id", "line_no", "outcome")


view(
    "results",
    """SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN '{"status":"success","message":"done ' || user_id || '"}'
         WHEN 1 THEN '{"status":"error","error_message":"boom","stderr":"' || repeat('e', user_id % 200) || '"}'
         WHEN 2 THEN 'plain text ' || user_id WHEN 3 THEN '{"status":"success"}'
         ELSE '{"status":"error","message":"' || repeat('long ', user_id % 150) || '"}' END AS result FROM events""",
)
view(
    "summaries",
    """SELECT event_id, tool_name, status, CASE status WHEN 'success' THEN coalesce(message, 'Success')
         WHEN 'error' THEN CASE WHEN r IS NULL THEN 'Tool returned non-JSON result: ' || result || '...' ELSE coalesce(message, error_message, 'Error occurred')
           || CASE WHEN tool_name = 'execute_code' AND coalesce(stderr, '') <> '' THEN ' | Stderr: ' || substr(stderr, 1, 100) || '...' ELSE '' END END END AS summary
       FROM (SELECT event_id, result, r, CASE event_id % 2 WHEN 0 THEN 'execute_code' ELSE 'kill_process' END AS tool_name,
           CASE WHEN r IS NULL THEN 'error' ELSE json_extract_string(r, '$.status') END AS status,
           json_extract_string(r, '$.message') AS message, json_extract_string(r, '$.error_message') AS error_message, json_extract_string(r, '$.stderr') AS stderr
         FROM (SELECT *, CASE WHEN json_valid(result) THEN result END AS r FROM results))""",
    "results",
)


def as_results(rows):
    """One executed call with the tool's JSON result per event."""
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = eid % 5
    repeats = (F.col("user_id") % 200).cast("int"), (F.col("user_id") % 150).cast("int")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"status":"success","message":"done '), user, F.lit('"}')))
        .when(
            kind == 1,
            F.concat(F.lit('{"status":"error","error_message":"boom","stderr":"'), F.repeat(F.lit("e"), repeats[0]), F.lit('"}')),
        )
        .when(kind == 2, F.concat(F.lit("plain text "), user))
        .when(kind == 3, F.lit('{"status":"success"}'))
        .otherwise(F.concat(F.lit('{"status":"error","message":"'), F.repeat(F.lit("long "), repeats[1]), F.lit('"}')))
    )
    runs_code = eid % 2 == 0
    return rows.select(
        "event_id",
        "ts",
        F.when(runs_code, "execute_code").otherwise("kill_process").alias("tool_name"),
        F.when(~runs_code, user).alias("pid"),
        F.when(runs_code, F.concat(F.lit('print("é'), user, F.lit('")'))).alias("code"),
        text.alias("result"),
    )


@query("result_summary", "SELECT event_id, status, summary AS result_summary FROM summaries", "summaries")
def result_summary(spark, sf_dir):
    rows = as_results(views.events(spark, sf_dir))
    return rows.withColumns(agent.result_columns(F.col("tool_name"), F.col("result"))).select(
        "event_id", "status", "result_summary"
    )


view(
    "action_log",
    r"""SELECT s.event_id, e.ts AS timestamp, tool_name, CASE tool_name WHEN 'kill_process' THEN '{"pid": ' || e.user_id || '}'
           ELSE '{"code": "print(\"\u00e9' || e.user_id || '\")"}' END AS arguments, status,
         CASE WHEN length(summary) > 500 THEN substr(summary, 1, 500) || '...' ELSE summary END AS result_summary
       FROM summaries s JOIN events e ON e.event_id = s.event_id""",
    "summaries",
)


@query(
    "action_log_write",
    "SELECT epoch_us(timestamp) AS at_micros, tool_name, arguments, status, result_summary FROM action_log",
    "action_log",
)
def action_log_write(spark, sf_dir):
    log = agent.action_log(as_results(views.events(spark, sf_dir)), "ts")
    return log.select(F.unix_micros("timestamp").alias("at_micros"), "tool_name", "arguments", "status", "result_summary")


@query(
    "action_log_view",
    "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, tool_name, arguments, status, result_summary FROM action_log ORDER BY 1 DESC",
    "action_log",
)
def action_log_view(spark, sf_dir):
    return newest_first(agent.action_log(as_results(views.events(spark, sf_dir)), "ts"))


@query(
    "truncate_lines",
    """SELECT doc_id, md5(array_to_string(l[1:3], chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) || '... (truncated - ' || len(l) || ' total lines)' ELSE '' END) AS output_md5
       FROM (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[1:-2] ELSE text END, chr(10)) AS l FROM documents)""",
)
def truncated(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(truncate_lines(F.col("text"), 3)).alias("output_md5"))


# --- source code ------------------------------------------------------------------------------------

view(
    "snippets",
    r"""SELECT event_id, CASE event_id % 12
         WHEN 0 THEN '' WHEN 1 THEN 'Disallowed AST node type used: Import' WHEN 2 THEN 'Disallowed function call: eval'
         WHEN 3 THEN 'Path traversal detected or path outside designated workspace ''/workspace'': ''../' || user_id || '''' WHEN 4 THEN ''
         WHEN 5 THEN 'Invalid characters in file mode ''q''.' WHEN 6 THEN 'Access to potentially unsafe attribute ''__class__'' disallowed.'
         WHEN 7 THEN 'Syntax error in code: ''('' was never closed (<unknown>, line 1)' WHEN 8 THEN 'Filename argument for ''open'' must be a literal string.'
         WHEN 9 THEN 'Invalid ''open'' call: Requires at least a filename.' WHEN 10 THEN 'Disallowed AST node type used: Delete'
         ELSE 'Disallowed AST node type used: Global' END AS problem FROM events""",
)


@query("code_audit", "SELECT event_id, problem FROM snippets", "snippets")
def code_audit(spark, sf_dir):
    user = F.col("user_id").cast("string")
    samples = [
        F.concat(F.lit("x = sum(range("), user, F.lit("))\nprint(x)")),
        F.lit("import os"),
        F.lit("eval('1')"),
        F.concat(F.lit("open('../"), user, F.lit("')")),
        F.concat(F.lit("with open('out/"), user, F.lit(".txt', 'w') as f:\n    f.write('a')")),
        F.lit("open('a.txt', 'q')"),
        F.lit("().__class__"),
        F.lit("x = ("),
        F.lit("name = 'a'\nopen(name)"),
        F.lit("open()"),
        F.lit("x = 1\ndel x"),
        F.lit("def f():\n    global x\n    x = 1"),
    ]
    snippet = F.element_at(F.array(*samples), (F.col("event_id") % 12 + 1).cast("int"))
    rows = views.events(spark, sf_dir).select("event_id", snippet.alias("code"))
    return rows.select("event_id", F.coalesce(code.code_problem(F.col("code")), F.lit("")).alias("problem"))


def source_files(spark, sf_dir):
    """One small source file per part; every seventh has a syntax error."""
    key, price = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("import math\n\n\nclass Part"), key, F.lit(':\n    """'), F.col("p_name"), F.lit('."""\n\n    size = '), price,
        F.lit("\n\n    def area(self, n):\n        return self.size * n\n\n    def label(self):\n        \"\"\"Name.\"\"\"\n        return '"),
        F.col("p_brand"), F.lit("'\n\n\ndef make_"), key, F.lit("(a, b=1):\n    return a + b\n"),
    )
    return spread(views.table(spark, sf_dir, "part")).select(
        "p_partkey", F.when(F.col("p_partkey") % 7 == 3, F.concat(text, F.lit("def broken(:\n"))).otherwise(text).alias("code")
    )


view(
    "source_files",
    """SELECT p_partkey, p_partkey % 7 = 3 AS broken, p_name, p_brand, length(p_name) AS n,
         'import math' || repeat(chr(10), 3) || 'class Part' || p_partkey || ':' || chr(10) || '    \"\"\"' || p_name || '.\"\"\"' || repeat(chr(10), 2) || '    size = ' || p_size
         || repeat(chr(10), 2) || '    def area(self, n):' || chr(10) || '        return self.size * n' || repeat(chr(10), 2) || '    def label(self):' || chr(10)
         || '        \"\"\"Name.\"\"\"' || chr(10) || '        return ''' || p_brand || '''' || repeat(chr(10), 3) || 'def make_' || p_partkey || '(a, b=1):' || chr(10) || '    return a + b' || chr(10)
         || CASE WHEN p_partkey % 7 = 3 THEN 'def broken(:' || chr(10) ELSE '' END AS code FROM part""",
)


@query(
    "code_functions",
    """SELECT p_partkey, v.chunk_no, CASE v.chunk_no WHEN 0 THEN 'method_Part' || p_partkey || '_area' WHEN 1 THEN 'method_Part' || p_partkey || '_label' ELSE 'function_make_' || p_partkey END AS id,
         CASE v.chunk_no WHEN 0 THEN 'def area(self, n):' WHEN 1 THEN 'def label(self):' ELSE 'def make_' || p_partkey || '(a, b=1):' END AS signature,
         CASE v.chunk_no WHEN 0 THEN 9 WHEN 1 THEN 12 ELSE 17 END AS start_line, CASE v.chunk_no WHEN 0 THEN 10 WHEN 1 THEN 14 ELSE 18 END AS end_line,
         CASE v.chunk_no WHEN 1 THEN 'Name.' ELSE '' END AS docstring, CASE v.chunk_no WHEN 2 THEN '' ELSE 'Part' || p_partkey END AS class_context
       FROM source_files, (VALUES (0), (1), (2)) v(chunk_no) WHERE NOT broken
       UNION ALL SELECT p_partkey, 0, 'code_segment_1', '', -1, -1, '', '' FROM source_files WHERE broken""",
    "source_files",
)
def code_functions(spark, sf_dir):
    chunks = code.code_chunks(source_files(spark, sf_dir), "code", "functions", 2000, 100)
    texts = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("signature", "docstring", "class_context")}
    lines = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("start_line", "end_line")]
    return chunks.select("p_partkey", "chunk_no", "id", *texts.values(), *lines)


@query(
    "code_class_stats",
    """SELECT p_partkey, 'class_Part' || p_partkey AS id, p_name || '.' AS docstring, 2 AS method_count, 'def area(self, n):|def label(self):' AS methods, 4 AS start_line, 11 AS line_count
       FROM source_files WHERE NOT broken""",
    "source_files",
)
def code_class_stats(spark, sf_dir):
    chunks = code.code_chunks(source_files(spark, sf_dir), "code", "classes", 2000, 100)
    return chunks.filter("type = 'class'").select(
        "p_partkey", "id", "docstring", "method_count", F.array_join("methods_signatures", "|").alias("methods"), "start_line", "line_count"
    )


@query(
    "code_lines",
    """SELECT p_partkey, 'code_segment_1' AS id, md5(code) AS text_md5, 1 AS estimated_start_line, (length(code) - length(replace(code, chr(10), '')) + 1)::INTEGER AS estimated_end_line
       FROM source_files""",
    "source_files",
)
def code_lines(spark, sf_dir):
    chunks = code.code_chunks(source_files(spark, sf_dir), "code", "lines", 2000, 100)
    return chunks.select("p_partkey", "id", F.md5("text").alias("text_md5"), "estimated_start_line", "estimated_end_line")
