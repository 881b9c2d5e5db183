"""Captions, image rules, video frames, and the pair classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions.text import strip_caption_echo, strip_description_echo, strip_explanation_echo
from tollgate.operators import pairs, zero_shot
from tollgate.plans import views
from tollgate.plans.catalog import query, view

IMAGE_POLICIES = {
    "ImageGate": {
        "description": "Block images of sign-ups and purchases.",
        "zero_shot_violation_rules": [
            {"if_classified_as": "a SIGNUP", "if_confidence_above": 0.1, "reason": "Shows a sign-up."},
            {"if_classified_as_contains": "Sign", "if_confidence_below": 0.05},
            {"if_classified_as": "zzz", "if_classified_as_contains": "purchase", "reason": "Shows a purchase."},
            {"if_classified_as_contains": "a", "if_confidence_above": 0.6, "reason": "Too certain."},
        ],
    }
}

view(
    "images",
    """SELECT event_id AS image_id, CASE WHEN user_id % 10 = 9 THEN 'othergate' ELSE 'imagegate' END AS policy_name,
         CASE event_id % 9 WHEN 7 THEN []::VARCHAR[] WHEN 8 THEN ['  ', 'Failed to generate caption 2', 'Placeholder caption 3']
              ELSE [event_type, ' ', 'Failed to generate caption 2', '', 'a ' || event_type, event_type] END AS captions,
         CASE WHEN user_id % 8 = 7 THEN NULL ELSE 'A ' || event_type END AS classified_as, least(value / 60.0, 1.0) AS confidence FROM events""",
)


def images(spark, sf_dir):
    """Events as images with the captions and the class that models gave."""
    eid = F.col("event_id")
    captions = (
        F.when(eid % 9 == 7, F.array().cast("array<string>"))
        .when(eid % 9 == 8, F.array(F.lit("  "), F.lit("Failed to generate caption 2"), F.lit("Placeholder caption 3")))
        .otherwise(
            F.array(
                F.col("event_type"), F.lit(" "), F.lit("Failed to generate caption 2"), F.lit(""),
                F.concat(F.lit("a "), F.col("event_type")), F.col("event_type"),
            )
        )
    )
    return views.events(spark, sf_dir).select(
        eid.alias("image_id"),
        F.when(F.col("user_id") % 10 == 9, "othergate").otherwise("imagegate").alias("policy_name"),
        captions.alias("captions"),
        F.when(F.col("user_id") % 8 != 7, F.concat(F.lit("A "), F.col("event_type"))).alias("classified_as"),
        F.least(F.col("value") / 60.0, F.lit(1.0)).alias("confidence"),
    )


@query(
    "caption_filter",
    """SELECT image_id, array_to_string(list_filter(captions, lambda c: trim(c) <> '' AND NOT contains(c, 'Failed to generate') AND NOT contains(c, 'Placeholder caption')), '|') AS valid FROM images""",
    "images",
)
def caption_filter(spark, sf_dir):
    return images(spark, sf_dir).select("image_id", F.array_join(zero_shot.valid_captions(F.col("captions")), "|").alias("valid"))


@query(
    "caption_distinct_pad",
    """SELECT image_id, CASE WHEN image_id % 9 = 7 THEN array_to_string(list_transform([1, 2, 3, 4, 5], lambda n: 'Placeholder caption due to insufficient generation ' || n), '|')
         WHEN image_id % 9 = 8 THEN '  |Failed to generate caption 2|Placeholder caption 3|Placeholder caption due to insufficient generation 4|Placeholder caption due to insufficient generation 5'
         ELSE captions[1] || '| |Failed to generate caption 2|' || captions[5] || '|Placeholder caption due to insufficient generation 5' END AS captions FROM images""",
    "images",
)
def caption_distinct_pad(spark, sf_dir):
    return images(spark, sf_dir).select(
        "image_id", F.array_join(zero_shot.distinct_padded(F.col("captions"), 5), "|").alias("captions")
    )


view(
    "image_rules",
    """SELECT *, CASE WHEN lower(classified_as) = 'a signup' AND confidence >= 0.1 THEN 'Shows a sign-up.'
         WHEN contains(lower(classified_as), 'sign') AND confidence < 0.05 THEN 'Policy violation based on classification.'
         WHEN contains(lower(classified_as), 'purchase') THEN 'Shows a purchase.'
         WHEN contains(lower(classified_as), 'a') AND confidence >= 0.6 THEN 'Too certain.' END AS reason FROM images""",
    "images",
)


@query(
    "zero_shot_rules",
    "SELECT image_id, coalesce(reason, '') AS reason FROM image_rules",
    "image_rules",
)
def zero_shot_rules(spark, sf_dir):
    reason = zero_shot.violation_reason(IMAGE_POLICIES["ImageGate"]["zero_shot_violation_rules"])
    return images(spark, sf_dir).select("image_id", F.coalesce(reason, F.lit("")).alias("reason"))


@query(
    "zero_shot_status",
    """SELECT image_id, status, CASE status WHEN 'violation' THEN reason WHEN 'no violation' THEN 'No violation detected based on defined policy rules.' ELSE '' END AS reason FROM
         (SELECT *, CASE WHEN policy_name <> 'imagegate' THEN 'policy not found' WHEN image_id % 9 = 7 THEN 'no captions' WHEN image_id % 9 = 8 THEN 'no valid captions'
            WHEN classified_as IS NULL THEN 'classification failed' WHEN reason IS NOT NULL THEN 'violation' ELSE 'no violation' END AS status FROM image_rules)""",
    "image_rules",
)
def zero_shot_status(spark, sf_dir):
    found = zero_shot.assess(images(spark, sf_dir), IMAGE_POLICIES)
    return found.select("image_id", "status", F.coalesce("violation_reason", F.lit("")).alias("reason"))


@query(
    "prompt_build",
    """SELECT image_id, 'Considering the policy: ''Guard ' || policy_name || ''', Describe this image in detail. Caption: (Suggestion 2 of 3)' AS caption_prompt,
         'Policy: ''Block images of sign-ups and purchases.''' || chr(10) || 'Violation: ''' || reason || '''' || chr(10) || 'Classified as ''' || classified_as || ''' with confidence '
         || format('{:.2f}', confidence) || '.' || chr(10) || 'Explain in a few words how the image breaks the policy.' || chr(10) || 'Explanation:' AS explanation_prompt
       FROM image_rules WHERE reason IS NOT NULL AND classified_as IS NOT NULL AND policy_name = 'imagegate' AND image_id % 9 < 7""",
    "image_rules",
)
def prompt_build(spark, sf_dir):
    """Prompts for the images that broke a rule."""
    found = zero_shot.to_explain(zero_shot.assess(images(spark, sf_dir), IMAGE_POLICIES))
    prompts = zero_shot.caption_prompts(
        F.lit(None).cast("string"), F.concat(F.lit("Guard "), "policy_name"), 3
    )
    about = F.lit(IMAGE_POLICIES["ImageGate"]["description"])
    return found.select(
        "image_id",
        prompts[1].alias("caption_prompt"),
        zero_shot.explanation_prompt(about, F.col("violation_reason"), F.col("classified_as"), F.col("confidence")).alias(
            "explanation_prompt"
        ),
    )


@query(
    "strip_echo",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'Describe ' || event_type || ' now' ELSE event_type END AS caption,
         CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN 'ASSISTANT: ' || event_type WHEN 1 THEN event_type ELSE 'Describe ' || event_type || ' now' END AS description,
         CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'Failed to generate a clear explanation for the violation.' WHEN 2 THEN event_type ELSE 'Describe ' || event_type || ' now' END AS explanation
       FROM events""",
)
def strip_echo(spark, sf_dir):
    kind, word = F.col("event_id") % 4, F.col("event_type")
    prompt = F.lit("Tell me")
    raw = (
        F.when(kind == 0, F.concat(F.lit("Tell me ASSISTANT: "), word, F.lit("\n")))
        .when(kind == 1, F.concat(F.lit(" Tell me "), word))
        .when(kind == 2, F.concat(F.lit("ASSISTANT: ASSISTANT: "), word))
        .otherwise(F.concat(F.lit("Describe "), word, F.lit(" now ")))
    )
    told = (
        F.when(kind == 0, F.concat(F.lit("ASSISTANT: Why? Explanation: "), word))
        .when(kind == 1, F.lit("prompt Explanation:  "))
        .when(kind == 2, F.concat(F.lit("x ASSISTANT: "), word))
        .otherwise(F.concat(F.lit("Describe "), word, F.lit(" now ")))
    )
    # the caption of kind 2 keeps what follows the first marker
    caption = strip_caption_echo(F.when(kind == 2, F.concat(F.lit("ASSISTANT:"), word)).otherwise(raw), prompt)
    return views.events(spark, sf_dir).select(
        "event_id",
        caption.alias("caption"),
        strip_description_echo(raw, prompt).alias("description"),
        strip_explanation_echo(told).alias("explanation"),
    )


# --- frames ---------------------------------------------------------------------------------------------

view("frames", "SELECT user_id AS video_id, event_id AS frame_no, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 8 ELSE 40 END AS fps, CASE WHEN user_id % 6 = 5 OR event_type = 'error' THEN NULL ELSE event_type || ' ' || props END AS description FROM events")


def frames(spark, sf_dir):
    user = F.col("user_id")
    return views.events(spark, sf_dir).select(
        user.alias("video_id"),
        F.col("event_id").alias("frame_no"),
        F.when(user % 4 == 0, 0).when(user % 4 == 1, 25).when(user % 4 == 2, 8).otherwise(40).alias("fps"),
        F.when((user % 6 != 5) & (F.col("event_type") != "error"), F.concat_ws(" ", "event_type", "props")).alias("description"),
    )


@query(
    "frame_sample",
    """SELECT video_id, frame_no, format('{:.2f}', frame_no / CASE fps WHEN 0 THEN 30.0::DOUBLE ELSE fps::DOUBLE END) AS seconds FROM frames
       WHERE frame_no % CASE fps WHEN 0 THEN 3 WHEN 25 THEN 2 WHEN 8 THEN 8 ELSE 4 END = 0""",
    "frames",
)
def frame_sample(spark, sf_dir):
    found = zero_shot.sampled_frames(frames(spark, sf_dir), 0.1)
    return found.select("video_id", "frame_no", F.format_string("%.2f", "timestamp_seconds").alias("seconds"))


@query(
    "frame_summary",
    """SELECT video_id, CASE WHEN video_id < 0 THEN 'No frames analyzed.' WHEN len(l) = 0 THEN 'No valid descriptions found in analyzed frames.'
         ELSE 'Video content highlights: ' || array_to_string(l[1:5], '; ') END AS summary FROM
         (SELECT video_id, coalesce(list(DISTINCT description ORDER BY description) FILTER (description IS NOT NULL), []) AS l FROM frames GROUP BY 1
          UNION ALL SELECT -1 - r_regionkey, [] FROM region)""",
    "frames",
)
def frame_summary(spark, sf_dir):
    """All videos with frames, and one without frames per region."""
    rows = frames(spark, sf_dir)
    empty = views.table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("video_id"))
    videos = rows.select("video_id").distinct().unionByName(empty)
    return zero_shot.frame_summaries(videos, rows)


# --- pair classifier ----------------------------------------------------------------------------------------


@query(
    "io_scores",
    """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS prediction, round(exp(embedding[2]::DOUBLE) / total, 6) AS probability_positive,
         round(exp(list_max(embedding)::DOUBLE) / total, 6) AS confidence
       FROM (SELECT *, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS total FROM embeddings)""",
)
def io_scores(spark, sf_dir):
    """Each vector read as the logits of a classifier."""
    found = views.table(spark, sf_dir, "embeddings").withColumn("given", pairs.from_logits(F.col("embedding")))
    return found.select(
        "vec_id",
        "given.prediction",
        F.round("given.probability_positive", 6).alias("probability_positive"),
        F.round("given.confidence", 6).alias("confidence"),
    )


@query("train_eval")
def train_eval(spark, sf_dir):
    """Train the pair classifier on labelled documents and test it on held-out ids."""
    docs = views.documents(spark, sf_dir).join(views.table(spark, sf_dir, "labels"), "doc_id")
    labelled = docs.select("doc_id", F.col("source").alias("input_text"), F.col("text").alias("output_text"), F.col("quality").alias("label"))
    training, test = pairs.split_by_id(labelled, "doc_id", 0.25)
    return pairs.evaluate(test, pairs.train(training))
