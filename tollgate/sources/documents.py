"""Documents, corpora, images and chunk files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.chunking import with_source_header


def read_documents(spark: SparkSession, paths: Sequence[str], source_header: bool = True) -> DataFrame:
    """Whole files as ``(source, text)``; missing ones are skipped, an error only if none is left."""
    kept = [p for p in paths if _exists(spark, p)]
    if not kept:
        raise FileNotFoundError(f"could not read any of {list(paths)}")
    rows = spark.read.option("ignoreMissingFiles", "true").text(kept, wholetext=True)
    source = F.col("_metadata.file_path")
    text = with_source_header(source, F.col("value")) if source_header else F.col("value")
    return rows.select(source.alias("source"), text.alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def parse_corpus(
    lines: DataFrame, id_field: str = "id", text_field: str = "text", metadata_fields: Sequence[str] = ()
) -> DataFrame:
    """``value`` holds JSON lines; gives ``(id, text, metadata)``.

    Bad JSON and lines without id or text are dropped. A metadata field comes
    from the line's ``metadata`` object, else from its top level, else it is absent.
    """
    # Generator output keeps the filters below from copying the parse.
    parsed = lines.select(F.explode(F.array(F.try_parse_json("value"))).alias("_line"))

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("_line", path, kind)

    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.coalesce(field(f"$.metadata.{name}"), field(f"$.{name}")).alias("value"),
            )
            for name in metadata_fields
        ]
    ).cast("array<struct<key string, value string>>")
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    rows = parsed.select(
        F.inline(
            F.array(
                F.struct(
                    field(f"$.{id_field}").alias("id"), field(f"$.{text_field}").alias("text"), present.alias("metadata")
                )
            )
        )
    )
    return rows.filter("id IS NOT NULL AND text IS NOT NULL")


def read_corpus(spark: SparkSession, path: str, **fields) -> DataFrame:
    return parse_corpus(spark.read.text(path), **fields)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as ``(path, content)`` rows for a batch model call."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
