"""Image rules over captions and caption classes given by models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tollgate.functions.text import is_blank, round_two, strip_caption_echo, strip_explanation_echo, two_decimals
from tollgate.functions.vectors import best_of, cosine, softmax
from tollgate.operators.policies import by_lower_name

# Texts that mark failed captions, and result texts.
FAILED = "Failed to generate"
PLACEHOLDER = "Placeholder caption"
PADDING = "Placeholder caption due to insufficient generation "
NO_VIOLATION = "No violation detected based on defined policy rules."
DEFAULT_REASON = "Policy violation based on classification."
NO_FRAMES = "No frames analyzed."
NO_DESCRIPTIONS = "No valid descriptions found in analyzed frames."
HIGHLIGHTS = "Video content highlights: "
DEFAULT_CAPTION_PROMPT = "Describe this image in detail. Caption:"


# --- captions ---------------------------------------------------------------------------------


def valid_captions(captions: Column) -> Column:
    """Captions that are not blank and do not report a failure."""
    return F.filter(
        captions, lambda c: ~is_blank(c) & ~F.contains(c, F.lit(FAILED)) & ~F.contains(c, F.lit(PLACEHOLDER))
    )


def distinct_padded(captions: Column, count: int) -> Column:
    """The first ``count`` different captions in order, filled up with placeholders."""
    kept = F.slice(F.array_distinct(F.filter(captions, lambda c: c != "")), 1, count)
    fill = F.array(*[F.lit(f"{PADDING}{n + 1}") for n in range(count)])
    return F.concat(kept, F.slice(fill, F.size(kept) + 1, F.lit(count)))


def caption_prompts(base: Column, guidance: Column, count: int) -> Column:
    """One prompt per wanted caption."""
    start = F.coalesce(base, F.lit(DEFAULT_CAPTION_PROMPT))
    prefix = F.when(
        F.coalesce(guidance, F.lit("")) != "",
        F.concat(F.lit("Considering the policy: '"), guidance, F.lit("', "), start),
    ).otherwise(start)
    return F.array(*[F.concat(prefix, F.lit(f" (Suggestion {n + 1} of {count})")) for n in range(count)])


def explanation_prompt(description: Column, reason: Column, classified_as: Column, confidence: Column) -> Column:
    """Prompt that asks a model to explain a violation; the answer follows its last word."""
    return F.concat(
        F.lit("Policy: '"), description,
        F.lit("'\nViolation: '"), reason,
        F.lit("'\nClassified as '"), classified_as,
        F.lit("' with confidence "), two_decimals(confidence),
        F.lit(".\nExplain in a few words how the image breaks the policy.\nExplanation:"),
    )


def markdown_prompt(markdown: Column) -> Column:
    """Prompt that asks a model to cut a Markdown document into chunks."""
    return F.concat(
        F.lit(
            "Cut this Markdown document into chunks for search. Keep code blocks whole and name the sections.\n"
            "Answer with a fenced JSON array of objects: id, text, and metadata with h1_section, h2_section, "
            "h3_section, h4_section, is_code_block, contains_code_elements, contains_commands, chunk_type, topics.\n"
            "Document:\n---\n"
        ),
        markdown,
        F.lit("\n---\nJSON Output:"),
    )


# --- rules --------------------------------------------------------------------------------------


def _condition(rule: Mapping) -> Column:
    low = F.lower(F.coalesce("classified_as", F.lit("")))
    confidence = F.coalesce("confidence", F.lit(0.0))
    exact = str(rule.get("if_classified_as", "")).lower()
    part = str(rule.get("if_classified_as_contains", "")).lower()
    met = F.lit(False)
    if exact:
        met = met | (low == exact)
    if part:
        met = met | F.contains(low, F.lit(part))
    if "if_confidence_above" in rule:
        met = met & (confidence >= float(rule["if_confidence_above"]))
    if "if_confidence_below" in rule:
        met = met & (confidence < float(rule["if_confidence_below"]))
    return met


def violation_reason(rules: list[Mapping]) -> Column:
    """Reason of the first rule that matches, null if none does."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        chosen = chosen.when(_condition(rule), F.lit(rule.get("reason", DEFAULT_REASON)))
    return chosen


def assess(images: DataFrame, policies: Mapping[str, Mapping]) -> DataFrame:
    """Status and reason per image.

    Reads ``policy_name`` (lower case), ``captions``, ``classified_as`` and
    ``confidence``. The run stops without captions, without a valid one, or when
    the classifier gave no class.
    """
    named = by_lower_name(policies)
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, policy in named.items():
        reason = reason.when(
            F.col("policy_name") == name, violation_reason(policy.get("zero_shot_violation_rules", []))
        )
    status = (
        F.when(~F.coalesce(F.col("policy_name").isin(list(named)), F.lit(False)), "policy not found")
        .when(F.coalesce(F.size("captions"), F.lit(0)) <= 0, "no captions")
        .when(F.size(valid_captions(F.col("captions"))) == 0, "no valid captions")
        .when(F.col("classified_as").isNull(), "classification failed")
        .when(F.col("_reason").isNotNull(), "violation")
        .otherwise("no violation")
    )
    told = F.when(F.col("status") == "violation", F.col("_reason")).when(
        F.col("status") == "no violation", F.lit(NO_VIOLATION)
    )
    return (
        images.withColumn("_reason", reason)
        .withColumn("status", status)
        .withColumn("violation_reason", told)
        .drop("_reason")
    )


def to_explain(assessed: DataFrame) -> DataFrame:
    """The rows an explanation is generated for."""
    return assessed.filter("status = 'violation'")


# --- video frames -----------------------------------------------------------------------------------


def sampled_frames(frames: DataFrame, interval: float = 5) -> DataFrame:
    """Every ``int(fps * interval)``-th frame with its time. Reads ``frame_no`` and ``fps``."""
    fps = F.when(F.col("fps") == 0, 30.0).otherwise(F.col("fps").cast("double"))
    step = F.floor(fps * interval)
    step = F.when(step <= 0, F.floor(fps)).otherwise(step)
    return frames.filter(F.col("frame_no") % step == 0).withColumn(
        "timestamp_seconds", round_two(F.col("frame_no") / fps)
    )


def frame_summaries(videos: DataFrame, frames: DataFrame, key: str = "video_id", most: int = 5) -> DataFrame:
    """The first ``most`` different descriptions of each video, in alphabetical order.

    Descriptions are made distinct before the shuffle, so a long video with few
    different descriptions sends few rows.
    """
    distinct = frames.groupBy(key, "description").agg(F.count("*").alias("frames"))
    order = Window.partitionBy(key).orderBy(F.col("description").asc_nulls_last())
    top = distinct.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= most)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list("description")).alias("_texts"))
    text = (
        F.when(F.col("_texts").isNull(), F.lit(NO_FRAMES))
        .when(F.size("_texts") == 0, F.lit(NO_DESCRIPTIONS))
        .otherwise(F.concat(F.lit(HIGHLIGHTS), F.array_join("_texts", "; ")))
    )
    return videos.join(listed, key, "left").withColumn("summary", text).drop("_texts")


# --- model calls ------------------------------------------------------------------------------------


Model = Callable[[], Callable[[bytes, str], str]]


def describe(content: Column, prompt: Column, make: Model) -> Column:
    """``struct(description, error)`` from a caller's model; a failure is a row, never an exception.

    ``make`` loads the model once per Python worker and returns ``(image bytes, prompt) -> text``.
    """

    @pandas_udf("struct<description string, error string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for images, prompts in batches:
            rows = []
            for image, text in zip(images, prompts):
                try:
                    rows.append((model(image, text), None))
                except Exception as error:  # noqa: BLE001
                    rows.append(("Error processing image", f"Error: {error}"))
            yield pd.DataFrame(rows, columns=["description", "error"])

    return run(content, prompt)


def captions(content: Column, prompts: Column, make: Model) -> Column:
    """One raw answer per prompt; a failure gives ``Error: ...`` for every prompt."""

    @pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()

        def answers(image, texts):
            try:
                return [model(image, text) for text in texts]
            except Exception as error:  # noqa: BLE001
                return [f"Error: {error}"] * len(texts)

        for images, prompt_lists in batches:
            yield pd.Series([answers(image, list(texts)) for image, texts in zip(images, prompt_lists)])

    return run(content, prompts)


def with_captions(images: DataFrame, make: Model, count: int = 3) -> DataFrame:
    """``captions`` of images ``(content, guidance)``: echoes removed, different ones, padded to ``count``."""
    asked = images.withColumn("_prompts", caption_prompts(F.lit(None).cast("string"), F.col("guidance"), count))
    raw = asked.withColumn("_raw", captions(F.col("content"), F.col("_prompts"), make))
    cleaned = F.transform(
        F.arrays_zip("_raw", "_prompts"),
        lambda z: strip_caption_echo(z["_raw"], z["_prompts"]),
    )
    named = F.transform(
        cleaned,
        lambda c, n: F.when(c == "", F.concat(F.lit(f"{FAILED} caption "), (n + 1).cast("string"))).otherwise(c),
    )
    return raw.withColumn("captions", distinct_padded(named, count)).drop("_prompts", "_raw")


def classify_captions(image: Column, caption_vectors: Column) -> Column:
    """``struct(index, score)`` of the caption nearest to the image: softmax of 100 times the cosine."""
    scores = F.transform(caption_vectors, lambda c: 100.0 * cosine(image, c))
    return best_of(softmax(scores))


def explained(assessed: DataFrame, policies: Mapping[str, Mapping], make: Model) -> DataFrame:
    """Adds ``explanation`` to violating rows. Only their images reach the model."""
    about = F.when(F.lit(False), F.lit(""))
    for name, policy in by_lower_name(policies).items():
        about = about.when(F.col("policy_name") == name, F.lit(policy.get("description", "No policy description provided.")))
    prompt = explanation_prompt(about, F.col("violation_reason"), F.col("classified_as"), F.col("confidence"))
    told = describe(F.col("content"), prompt, make)
    violating = to_explain(assessed).withColumn("_told", told)
    text = F.when(
        F.col("_told.error").isNotNull(),
        F.concat(F.lit("Error generating explanation: "), F.substring("_told.error", 8, 1 << 30)),
    ).otherwise(strip_explanation_echo(F.col("_told.description")))
    others = assessed.filter("status <> 'violation'").withColumn("explanation", F.lit(None).cast("string"))
    return violating.withColumn("explanation", text).drop("_told").unionByName(others)
