"""Agent proposals: parse, check, decide, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.canonical import canonical_json
from tollgate.functions.text import cut, strip

# The call formats.
NO_ACTIONS = "NO_ACTIONS_NEEDED"
CALL = "(?Ud)^\\s*(\\w+)\\((.*)\\)\\s*$"
PID_ARGUMENT = "(?U)^\\s*pid=(\\d+)\\s*$"
CODE_ARGUMENT = "(?Us)^\\s*code\\s*=\\s*([\"'])(.*?)\\1\\s*$"
SAFE_CALL = "(?Ud)\\A(?:(^kill_process\\(pid=\\d+\\)$)|(^execute_code\\(code=([\"'])((?:\\\\.|(?!\\3).)*)\\3\\)$))"
CONTACT_ERROR = "ERROR_LLM_COMMUNICATION"


def tool_calls(responses: DataFrame, key: str, response: str) -> DataFrame:
    """One row per well-formed call of a known tool: ``call_no``, ``raw_call``, ``tool_name``, ``pid``, ``code``."""
    text = F.when(F.col(response) != NO_ACTIONS, F.col(response))
    lines = F.transform(F.split(strip(text), "\n"), strip)
    rows = responses.select(key, F.posexplode(lines).alias("line_no", "raw_call"))
    parts = rows.select(
        key,
        "line_no",
        "raw_call",
        F.regexp_extract("raw_call", CALL, 1).alias("tool_name"),
        strip(F.regexp_extract("raw_call", CALL, 2)).alias("_args"),
    )
    pid = F.when(F.col("tool_name") == "kill_process", F.regexp_extract("_args", PID_ARGUMENT, 1))
    quote = F.regexp_extract("_args", CODE_ARGUMENT, 1)
    code = F.when((F.col("tool_name") == "execute_code") & (quote != ""), F.regexp_extract("_args", CODE_ARGUMENT, 2))
    typed = parts.withColumns({"pid": F.when(pid != "", pid), "code": code})
    return typed.filter("pid IS NOT NULL OR code IS NOT NULL").drop("_args")


def is_safe_call(raw_call: Column) -> Column:
    """The strict form of a call; ``$`` allows one line end as in the original format."""
    return raw_call.rlike(SAFE_CALL)


def confirmed(answer: Column) -> Column:
    """Whether the confirming agent approved; errors and all other texts deny."""
    said = F.coalesce(answer, F.lit(""))
    return F.when(said.startswith(CONTACT_ERROR), False).otherwise(said.startswith("APPROVE"))


def approval_gate(calls: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``outcome`` of each call: ``rejected``, ``denied`` or ``approved``.

    ``decisions`` holds ``(key, human, confirmation)``, one row per key. A human
    decision counts alone when given, else the confirming agent decides.
    """
    joined = calls.join(decisions, key, "left")
    agreed = F.when(F.col("human").isNotNull(), F.col("human") != "deny").otherwise(confirmed(F.col("confirmation")))
    outcome = (
        F.when(~is_safe_call(F.col("raw_call")), "rejected").when(agreed, "approved").otherwise("denied")
    )
    return joined.withColumn("outcome", outcome)


def arguments_json(pid: Column, code: Column) -> Column:
    """The call's arguments as JSON text with Python's separators and escapes."""
    number = F.concat(F.lit('{"pid": '), F.regexp_replace(pid, "^0+(?=\\d)", ""), F.lit("}"))
    return F.when(pid.isNotNull(), number).otherwise(canonical_json(F.to_json(F.struct(code.alias("code")))))


def result_columns(tool: Column, result: Column) -> dict[str, Column]:
    """``status`` and ``result_summary`` of a tool's JSON result."""
    parsed = F.try_parse_json(result)

    def text(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "string")

    state = F.coalesce(text("status"), F.lit("unknown"))
    message = F.coalesce(text("message"), text("error_message"), F.lit("Error occurred"))
    stderr = F.coalesce(text("stderr"), F.lit(""))
    tail = F.when(
        (tool == "execute_code") & (stderr != ""),
        F.concat(F.lit(" | Stderr: "), F.substring(stderr, 1, 100), F.lit("...")),
    ).otherwise("")
    broken = F.concat(F.lit("Tool returned non-JSON result: "), F.substring(result, 1, 200), F.lit("..."))
    return {
        "status": F.when(parsed.isNull(), "error").otherwise(state),
        "result_summary": F.when(parsed.isNull(), broken)
        .when(state == "success", F.coalesce(text("message"), F.lit("Success")))
        .otherwise(F.concat(message, tail)),
    }


def action_log(calls: DataFrame, logged_at: str) -> DataFrame:
    """Executed calls with their ``result`` as rows of the action log. Works on streams."""
    judged = calls.withColumns(result_columns(F.col("tool_name"), F.col("result")))
    return judged.select(
        F.col(logged_at).alias("timestamp"),
        "tool_name",
        arguments_json(F.col("pid"), F.col("code")).alias("arguments"),
        "status",
        cut(F.col("result_summary"), 500).alias("result_summary"),
    )
