"""The pair classifier: outputs from logits, and training on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.vectors import best_of, let, softmax


def from_logits(logits: Column) -> Column:
    """``struct(prediction, probability_positive, confidence)`` of a classifier's logits."""

    def read(shares: Column) -> Column:
        best = best_of(shares)
        positive = F.when(F.size(shares) > 1, F.try_element_at(shares, F.lit(2))).otherwise(shares[0])
        return F.struct(
            best["index"].alias("prediction"),
            positive.alias("probability_positive"),
            best["score"].alias("confidence"),
        )

    return let(softmax(F.transform(logits, lambda x: x.cast("double"))), read)


def _with_pair_text(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pair_text", F.concat_ws("\n", "input_text", "output_text"))


def split_by_id(pairs: DataFrame, key: str, test_share: float) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id: the same split on every run."""
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(1000)) < int(test_share * 1000)
    return pairs.filter(~part), pairs.filter(part)


def train(pairs: DataFrame, epochs: int = 20, rate: float = 0.01, features: int = 1 << 14) -> PipelineModel:
    """Fit on ``(input_text, output_text, label)``; label 1 is a valid pair. ``rate`` is the L2 weight."""
    stages = [
        RegexTokenizer(inputCol="pair_text", outputCol="words", pattern="\\s+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=epochs, regParam=rate, labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(_with_pair_text(pairs).withColumn("label", F.col("label").cast("double")))


def score(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``io_prediction`` and ``io_probability``, the columns that request validation reads."""
    scored = model.transform(_with_pair_text(pairs))
    return scored.withColumns(
        {
            "io_prediction": F.col("prediction").cast("int"),
            "io_probability": vector_to_array("probability")[1],
        }
    ).drop("pair_text", "words", "counts", "features", "rawPrediction", "probability", "prediction")


def evaluate(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """One row: test rows, accuracy and area under the curve."""
    scored = model.transform(_with_pair_text(pairs).withColumn("label", F.col("label").cast("double")))
    area = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    return scored.agg(
        F.count("*").alias("test_rows"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
    ).withColumn("area_under_curve", F.lit(float(area)))
