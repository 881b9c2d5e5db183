"""The jobs as one call each: tables in, tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.functions.text import is_blank
from tollgate.operators import agent, audit, chunking, code, config, handshake, help, items, pairs, pebbles, requests, zero_shot
from tollgate.operators.embedding import Embedder, TrigramEmbedder, classify_texts, embed_text
from tollgate.operators.policies import Policies, policy_table, with_policy
from tollgate.operators.similarity import top_k
from tollgate.session import cut_lineage
from tollgate.sources import index_store
from tollgate.streaming.items import validate_arriving

Make = Callable[[], Embedder]


def validate(
    incoming: DataFrame,
    policies: Policies,
    files: DataFrame | None = None,
    pair_model: PipelineModel | None = None,
    examples: Mapping[str, Sequence[str]] | None = None,
    make: Make = TrigramEmbedder,
) -> DataFrame:
    """Requests with ``overall_status``, ``violation_reasons``, ``checks_skipped`` and ``error_message``.

    ``policies`` is a dict, or a table as :func:`tollgate.sources.policies.policy_rows` gives it. Items come as an
    array column ``items`` or as JSON text in ``input_items``. ``files`` holds ``(request_id, file_name, description)``
    of attached files. A model only sees the rows whose policy asks for it.
    """
    table = _stored_policies(incoming, policies)
    rows = _with_models(incoming, table, pair_model, examples, make)
    listed = {"items": items.explode_items, "input_items": items.explode_json_items}
    given = next((c for c in listed if c in rows.columns), None)
    if files is not None and given:
        attached = items.attach_files(listed[given](rows), files)
        described = classify_texts(attached, "description", "_found", examples, make)
        checked = items.item_messages(
            described.withColumn("description_class", F.col("_found.predicted_class")).drop("_found"), table
        )
        return requests.validate(rows, table, items.regroup(checked))
    return requests.validate(rows, table)


def validate_stream(
    incoming: DataFrame,
    policies: Policies,
    files: DataFrame,
    pair_model: PipelineModel | None = None,
    examples: Mapping[str, Sequence[str]] | None = None,
    make: Make = TrigramEmbedder,
    wait: str = "10 minutes",
    late: str = "10 minutes",
) -> DataFrame:
    """:func:`validate` for streams: requests ``(request_id, ts, ...)``, and their files ``(request_id, file_name, ts, description)``.

    Models see each text and each description once, where it arrives. See :func:`tollgate.streaming.items.validate_arriving`.
    """
    table = _stored_policies(incoming, policies)
    rows = _with_models(incoming, table, pair_model, examples, make)
    described = classify_texts(files, "description", "_found", examples, make)
    described = described.withColumn("description_class", F.col("_found.predicted_class")).drop("_found")
    return validate_arriving(rows, table, described, wait, late)


def _stored_policies(incoming: DataFrame, policies: Policies) -> DataFrame:
    table = policy_table(incoming.sparkSession, policies)
    return cut_lineage(table) if isinstance(policies, DataFrame) else table  # met several times


def _with_models(
    incoming: DataFrame, table: DataFrame, pair_model: PipelineModel | None, examples: Mapping[str, Sequence[str]] | None, make: Make
) -> DataFrame:
    """Requests with their policy and the results of the models that some policy asks for."""
    asked = table.agg(*[F.max(c).alias(c) for c in ("pair_check", "input_check", "output_check")]).first()
    rows = with_policy(incoming, table)
    for side in ("input", "output"):
        if not asked[f"{side}_check"]:
            continue
        text = F.when(F.col(f"_policy.{side}_check"), F.col(f"{side}_text"))
        rows = (
            classify_texts(rows.withColumn("_text", text), "_text", "_found", examples, make)
            .withColumn(f"{side}_class", F.col("_found.predicted_class"))
            .drop("_text", "_found")
        )
    if pair_model is not None and asked["pair_check"]:
        rows = pairs.score(rows, pair_model)
    return rows


def build_index(
    docs: DataFrame, path: str, size: int | None = 1000, answer: str | None = None, make: Make = TrigramEmbedder
) -> DataFrame:
    """``(source, text)`` documents cut, embedded and written; ``answer`` names a column of model answers."""
    keyed = docs.withColumn("_key", F.xxhash64("source"))
    if answer:
        chunks = chunking.chunks_or_fallback(keyed, "_key", "text", "source", answer, size)
    else:
        chunks = chunking.markdown_chunks(keyed, "text", "source", size)
    index_store.write_index(chunks.select("id", "text", "metadata"), path, make)
    return index_store.read_index(docs.sparkSession, path)


def build_code_index(
    files: DataFrame, path: str, strategy: str = "functions", size: int = 1000, overlap: int = 100, make: Make = TrigramEmbedder
) -> DataFrame:
    """``(path, code)`` source files cut and embedded; ids carry the file's path."""
    chunks = code.index_fields(code.code_chunks(files, "code", strategy, size, overlap), strategy, ["path"])
    named = chunks.select(F.concat_ws("#", "path", "id").alias("id"), "text", "metadata")
    index_store.write_index(named, path, make, metadata_fields=tuple(code.KEPT_FIELDS[strategy]))
    return index_store.read_index(files.sparkSession, path)


def retrieve(queries: DataFrame, index: DataFrame, k: int = 5, make: Make = TrigramEmbedder) -> DataFrame:
    """Top ``k`` chunks for each ``(query_id, query)``; a blank query gives one row with its error."""
    blank = F.coalesce(is_blank(F.col("query")), F.lit(True))
    asked = queries.filter(~blank).select("query_id", embed_text(F.col("query"), make).alias("vector"))
    hits = top_k(asked, index.select("id", "embedding"), k).withColumn("error", F.lit(None).cast("string"))
    refused = queries.filter(blank).select("query_id", F.lit("'query' field required.").alias("error"))
    return hits.unionByName(refused, allowMissingColumns=True)


def classify_sensitivity(
    texts: DataFrame, text: str = "text", examples: Mapping[str, Sequence[str]] | None = None, make: Make = TrigramEmbedder
) -> DataFrame:
    return classify_texts(texts, text, "sensitivity", examples, make)


def suggest_help(results: DataFrame, policies: Policies, index: DataFrame, make: Make = TrigramEmbedder) -> DataFrame:
    """Suggestions for the rejected rows of :func:`validate`."""
    rejected = results.filter(F.col("overall_status") == requests.VIOLATION)
    return help.suggest(rejected, policies, index, make)


def check_images(images: DataFrame, policies: Mapping[str, Mapping], explain: zero_shot.Model | None = None) -> DataFrame:
    """Status and reason per image from its captions, class and confidence.

    With ``explain``, violating images (column ``content``) also get an ``explanation``;
    the model sees no others.
    """
    assessed = zero_shot.assess(images, policies)
    return assessed if explain is None else zero_shot.explained(assessed, policies, explain)


def apply_config_changes(changes: DataFrame, roles: DataFrame) -> dict[str, DataFrame]:
    """The decision on each change, and the fields the accepted ones added."""
    decided = cut_lineage(config.apply_changes(changes, roles))
    return {"decisions": decided, "new_fields": config.new_fields(decided.filter("status_code = 200"))}


def audit_invocations(log: DataFrame, actions: DataFrame, registered: DataFrame) -> DataFrame:
    """All findings on a log: ``(log_id, finding)``.

    ``actions`` holds ``(use_case, tool, action, class_no)``, ``registered`` ``(use_case, breadcrumb)``.
    """
    crumbs = audit.breadcrumb_findings(log, registered).filter("finding <> 'ok'").select(
        "log_id", F.concat(F.lit("breadcrumb "), "finding").alias("finding")
    )
    drift = audit.sensitivity_drift(log, actions).select("log_id", "finding")
    missing = audit.missing_extensions(log).select("log_id", F.concat(F.lit("missing "), "extension").alias("finding"))
    return crumbs.unionByName(drift).unionByName(missing)


def check_handshakes(authorised: DataFrame, executed: DataFrame) -> DataFrame:
    """Findings per transaction: one phase missing, late or reused token, changed parameters."""
    lonely = handshake.orphans(authorised, executed)
    a = authorised.select("transaction_id", F.col("token").alias("issued"), "auth_ts", "expiry", "auth_hash")
    both = executed.join(a, "transaction_id")
    finding = (
        F.when(F.col("token") != F.col("issued"), "other token")
        .when(~F.col("exec_ts").between(F.col("auth_ts"), F.col("expiry")), "outside token life")
        .when(F.col("exec_hash") != F.col("auth_hash"), "parameters changed")
    )
    wrong = both.withColumn("finding", finding).filter("finding IS NOT NULL").select("transaction_id", "finding")
    used = executed.select("token", F.col("exec_ts").alias("ts"), F.col("transaction_id").alias("log_id"))
    again = handshake.replays(used).select(F.col("log_id").alias("transaction_id"), F.lit("token replayed").alias("finding"))
    return lonely.unionByName(wrong).unionByName(again)


def verify_pebbles(log: DataFrame, breadcrumbs: DataFrame) -> DataFrame:
    """Pebbles with ``verified``; the breadcrumb of a use case comes from its table."""
    return pebbles.verify(log.join(breadcrumbs.select("use_case", "breadcrumb"), "use_case", "left"))


def review_proposals(responses: DataFrame, decisions: DataFrame, key: str = "id", response: str = "response") -> DataFrame:
    """Calls in agent responses with ``outcome`` and, for code, the ``problem`` of its audit."""
    calls = agent.approval_gate(agent.tool_calls(responses, key, response), decisions, key)
    return calls.withColumn("problem", code.code_problem(F.col("code")))
