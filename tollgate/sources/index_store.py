"""The vector index on disk: one Parquet table and one settings row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.embedding import Embedder, TrigramEmbedder, embed_text
from tollgate.sources.documents import _exists

CONFIG_SCHEMA = (
    "embedding_model_id string, metadata_fields array<string>, num_documents bigint, embedding_dimension int,"
    " index_timestamp timestamp"
)


def write_index(
    chunks: DataFrame,
    path: str,
    make: Callable[[], Embedder] = TrigramEmbedder,
    model_id: str = "hashed-trigrams",
    metadata_fields: tuple[str, ...] = (),
) -> None:
    """Embed ``(id, text, metadata)`` and write it. Each vector lives in its document's row."""
    spark = chunks.sparkSession
    chunks.withColumn("embedding", embed_text(F.col("text"), make).cast("array<float>")).write.mode(
        "overwrite"
    ).parquet(f"{path}/documents")
    written = spark.read.parquet(f"{path}/documents")
    config = written.agg(
        F.lit(model_id).alias("embedding_model_id"),
        F.array(*[F.lit(f) for f in metadata_fields]).cast("array<string>").alias("metadata_fields"),
        F.count("*").alias("num_documents"),
        F.max(F.size("embedding")).alias("embedding_dimension"),
        F.current_timestamp().alias("index_timestamp"),
    )
    config.coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).json(f"{path}/config")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents")


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """Documents, vectors of the configured dimension, and whether both agree with the settings."""
    config = read_config(spark, path).first()
    dim = config["embedding_dimension"] or 0
    found = read_index(spark, path).agg(
        F.count("*").alias("documents"), F.count_if(F.size("embedding") == dim).alias("vectors")
    )
    sound = (F.col("documents") == F.col("vectors")) & (F.col("documents") == F.lit(config["num_documents"]))
    return found.withColumn("sound", sound)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index if it is whole, else None."""
    if status(spark, path)["status"] != "exists_not_loaded" or not integrity(spark, path).first()["sound"]:
        return None
    return read_index(spark, path)


def status(spark: SparkSession, path: str) -> dict:
    """``does_not_exist``, ``exists_corrupt_config`` or ``exists_not_loaded`` with the counts."""
    if not (_exists(spark, f"{path}/config") and _exists(spark, f"{path}/documents")):
        return {"status": "does_not_exist", "index_path": path}
    config = read_config(spark, path).first()
    if config is None or config["num_documents"] is None:
        return {"status": "exists_corrupt_config", "index_path": path}
    return {
        "status": "exists_not_loaded",
        "index_path": path,
        "num_documents": config["num_documents"],
        "embedding_model_id": config["embedding_model_id"],
        "embedding_dimension": config["embedding_dimension"],
    }
