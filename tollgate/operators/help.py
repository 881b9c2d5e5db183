"""Documentation suggestions for rejected requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.text import cut, no_text
from tollgate.operators.embedding import Embedder, TrigramEmbedder, embed_text
from tollgate.operators.policies import PER_QUERY, Policies, policy_table, with_policy
from tollgate.operators.similarity import top_k
from tollgate.session import cut_lineage, small_side

# The search phrases of each violation term, and the error texts.
TERM_QUERIES: dict[str, list[str]] = {
    "pii": ["handling PII", "sensitive data policy", "data privacy"],
    "sensitive": ["data sensitivity levels", "confidential information rules"],
    "modernbert i/o": ["input output validation", "API request format", "model validation"],
    "colbert": ["content sensitivity classification", "text analysis policy"],
    "vlm": ["image content policy", "video analysis rules", "multimodal validation"],
    "length limit": ["text length restrictions", "payload size limits"],
    "required field": ["mandatory fields", "API data requirements"],
    "format validation": ["data format rules", "pattern matching requirements"],
}
NO_INDEX_PATH = "Documentation RAG index path not configured."
INDEX_MISSING = "Documentation RAG index at '%s' not available or failed to load."
NO_QUERIES = "No specific help queries generated for violations."
NOTHING_FOUND = "No relevant documentation found for these violations."


def keyword_query(violation: Column) -> Column:
    """Query from the words of a violation without a known term."""
    low = F.lower(violation)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit("(?U)\\b[a-zA-Z]{4,}\\b"), F.lit(0))))
    guideline = F.concat(F.lit("guidelines for '"), F.substring(low, 1, 30), F.lit("...'"))
    return F.when(
        F.size(found) > 0, F.concat(F.lit("how to fix "), F.array_join(F.slice(found, 1, 3), " "))
    ).otherwise(guideline)


def term_queries(violation: Column) -> Column:
    """The phrases of every term inside a violation."""
    low = F.lower(violation)
    parts = [
        F.when(F.contains(low, F.lit(term)), F.array(*[F.lit(q) for q in queries])).otherwise(no_text())
        for term, queries in TERM_QUERIES.items()
    ]
    return F.concat(*parts)


def help_queries(violations: Column, description: Column) -> Column:
    """Distinct queries for a list of violations and the policy's description, in alphabetical order."""

    def each(violation: Column) -> Column:
        known = term_queries(violation)
        return F.when(F.size(known) > 0, known).otherwise(F.array(keyword_query(violation)))

    about = F.when(
        F.coalesce(description, F.lit("")) != "",
        F.array(F.concat(F.lit("understanding policy: "), F.substring(description, 1, 50))),
    ).otherwise(no_text())
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(violations, each)), about)))


def suggestion_title(doc_id: Column, metadata: Column) -> Column:
    h1, h2 = metadata["h1_section"], metadata["h2_section"]
    code = F.coalesce(metadata["is_code_block"], F.lit(False)) | F.coalesce(metadata["chunk_type"] == "code", F.lit(False))
    return (
        F.when(F.coalesce(h2, F.lit("")) != "", F.concat(F.coalesce(h1, F.lit("None")), F.lit(": "), h2))
        .when(F.coalesce(h1, F.lit("")) != "", h1)
        .when(code, F.lit("Relevant Code Example/Reference"))
        .when(F.coalesce(metadata["contains_commands"], F.lit(False)), F.lit("Relevant Command Reference"))
        .when(F.coalesce(doc_id, F.lit("")) != "", F.concat(F.lit("Documentation Snippet: "), doc_id))
        .otherwise(F.lit("General Documentation"))
    )


def preview(text: Column) -> Column:
    return cut(text, 500)


def suggestion(doc_id: Column, shown: Column, metadata: Column, score: Column) -> Column:
    """The record shown for a suggested chunk; ``shown`` is the preview of its text."""
    return F.struct(
        suggestion_title(doc_id, metadata).alias("title"),
        shown.alias("content_preview"),
        F.lit(True).alias("full_content_available"),
        doc_id.alias("document_id"),
        score.alias("relevance_score"),
        F.coalesce(metadata["source_url"], F.lit("N/A")).alias("source_url"),
        F.coalesce(metadata["h1_section"], F.lit("Documentation")).alias("primary_section"),
        F.coalesce(metadata["h2_section"], F.lit("")).alias("secondary_section"),
        F.coalesce(metadata["chunk_type"], F.lit("content")).alias("chunk_type"),
        F.struct(
            (
                F.coalesce(metadata["is_code_block"], F.lit(False))
                | F.coalesce(metadata["chunk_type"] == "code", F.lit(False))
            ).alias("is_code_example"),
            F.coalesce(metadata["contains_commands"], F.lit(False)).alias("contains_commands"),
            F.coalesce(metadata["vlm_processed"], F.lit(False)).alias("vlm_processed_doc"),
        ).alias("tags"),
    )


def with_help_queries(rejected: DataFrame, policies: Policies) -> DataFrame:
    """Adds the assistance settings of the policy and ``help_queries``."""
    filled = with_policy(rejected, policies)
    settings = ("help_enabled", "index_path", "per_query", "total", "threshold", "max_queries")
    filled = filled.withColumns({n: F.col(f"_policy.help.{n}") for n in settings} | {"description": F.col("_policy.description")})
    queries = help_queries(F.col("violation_reasons"), F.col("description"))
    return filled.drop("_policy").withColumn("help_queries", queries).withColumn(
        "queries_used", F.slice("help_queries", 1, F.col("max_queries"))
    )


def suggest(
    rejected: DataFrame,
    policies: Policies,
    index: DataFrame,
    make: Callable[[], Embedder] = TrigramEmbedder,
) -> DataFrame:
    """Suggested chunks per rejected request: ``(request_id, rank, relevant, suggestion)``.

    Each distinct query text is searched once, however many requests share it.
    The hits (queries times k) then meet the index and the requests as the small
    side, so neither is shuffled on a popular query or chunk.
    """
    asking = with_help_queries(rejected, policies).filter("help_enabled AND index_path IS NOT NULL")
    # Read three times below; the checkpoint saves validating the requests again.
    asked = cut_lineage(
        asking.select("request_id", "per_query", "total", "threshold", F.explode("queries_used").alias("query"))
    )
    most = policy_table(rejected.sparkSession, policies).agg(F.max("help.per_query").alias("k")).first()
    k = most["k"] or PER_QUERY
    texts = asked.select("query").distinct().withColumn("vector", embed_text(F.col("query"), make))
    hits = cut_lineage(top_k(texts, index.select("id", "embedding"), k, query_id="query"))
    records = index.select("id", preview(F.col("text")).alias("preview"), "metadata")
    shown = cut_lineage(records.join(small_side(hits), "id"))
    found = asked.join(small_side(shown.withColumnRenamed("query", "hit_query")), F.col("query") == F.col("hit_query"))
    near = found.filter((F.col("rank") <= F.col("per_query")) & (F.col("score") >= F.col("threshold")))
    best = near.groupBy("request_id", "id").agg(
        F.max("score").alias("score"),
        F.first("total").alias("total"),
        F.first("preview").alias("preview"),
        F.first("metadata").alias("metadata"),
    )
    # at most max_queries * per_query rows per request
    of_request = Window.partitionBy("request_id")
    ranked = best.withColumns(
        {
            "rank": F.row_number().over(of_request.orderBy(F.desc("score"), "id")),
            "relevant": F.count("*").over(of_request),
        }
    ).filter(F.col("rank") <= F.col("total"))
    record = suggestion(F.col("id").cast("string"), F.col("preview"), F.col("metadata"), F.col("score"))
    return ranked.select("request_id", "rank", "relevant", record.alias("suggestion"))


def outcome(asking: DataFrame, counts: DataFrame, known_indexes: list[str]) -> DataFrame:
    """Which of the six results a rejected request gets. ``counts`` holds ``(request_id, relevant, shown)``."""
    joined = asking.join(counts, "request_id", "left")
    path = F.coalesce("index_path", F.lit(""))
    result = (
        F.when(~F.coalesce("help_enabled", F.lit(False)), F.lit("off"))
        .when(path == "", F.lit(NO_INDEX_PATH))
        .when(~path.isin(known_indexes), F.format_string(INDEX_MISSING, path))
        .when(F.size("help_queries") == 0, F.lit(NO_QUERIES))
        .when(F.coalesce("shown", F.lit(0)) == 0, F.lit(NOTHING_FOUND))
        .otherwise(F.lit("suggestions"))
    )
    return joined.withColumns(
        {"documentation_assistance_attempted": F.coalesce("help_enabled", F.lit(False)), "outcome": result}
    )
