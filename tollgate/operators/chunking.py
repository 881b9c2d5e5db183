"""Documents to chunks. Every document is handled inside its own row: no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.runs import in_runs
from tollgate.functions.text import first_line, is_blank, strip

# Where a long text may be cut, in order of preference, and the
# shell commands that mark a chunk.
CUT_MARKS = ["\n\n", "\n", ". ", "! ", "? "]
COMMANDS = "curl|python|pip|docker|git"
HEADING = "(?dm)(?=^#{1,2} )"
FENCED_ARRAY = "(?s)```json\\s*(\\[.*?\\])\\s*```"


def _last_cut(text: str, low: int, high: int, least: int) -> int:
    """Where the piece ``text[low:high]`` ends: behind the last of the best mark that leaves more than ``least``, else at ``high``."""
    for mark in CUT_MARKS:
        # the first place where the mark would end far enough behind the piece's start
        first = max(least - len(mark), low) + 1
        if (at := text.rfind(mark, first, high)) >= 0:
            return at + len(mark)
    return high


def split_overlapping(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters that start ``overlap`` before the last cut.

    A cut falls behind the preferred mark that leaves more than a quarter of the
    size. A text that fits comes back unchanged. Each cut looks backwards from the end
    of its piece, and for a lesser mark only when no better one will do.
    """
    if len(text) <= size:
        return [text]
    spans = []
    start, end = 0, 0
    while end < len(text):
        limit = start + size
        end = _last_cut(text, start, limit, start + size // 4) if limit < len(text) else len(text)
        spans.append((start, end))
        start = min(end, max(end - overlap, start + 1))
    stripped = (text[a:b].strip() for a, b in spans)
    return [piece for piece in stripped if piece]


def split_column(col: Column, size: int, overlap: int) -> Column:
    """Pieces of each text; only texts longer than ``size`` go through Python."""

    def each(texts: pa.Array) -> list:
        return [None if t is None else split_overlapping(t, size, overlap) for t in texts.to_pylist()]

    return F.coalesce(in_runs(lambda: each, "array<string>")(F.when(F.length(col) > size, col)), F.array(col))


def _split_many(blocks: Column, size: int, overlap: int) -> Column:
    """The same for an array of texts; null for entries that fit."""

    def pieces(texts: list | None) -> list | None:
        return None if texts is None else [None if t is None else split_overlapping(t, size, overlap) for t in texts]

    def each(lists: pa.Array) -> list:
        return [pieces(texts) for texts in lists.to_pylist()]

    return in_runs(lambda: each, "array<array<string>>")(F.transform(blocks, lambda b: F.when(F.length(b) > size, b)))


def with_source_header(source: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n# Source Document: "), source, F.lit("\n\n"), text)


def heading_blocks(text: Column) -> Column:
    """Blocks that begin at H1 and H2 lines, each with its heading line; blank ones dropped."""
    return F.filter(F.split(text, HEADING), lambda b: ~is_blank(b))


def _h1(line: Column) -> Column:
    return F.when(line.startswith("# "), strip(F.substr(line, F.lit(3))))


def _h2(line: Column) -> Column:
    return F.when(line.startswith("## "), strip(F.substr(line, F.lit(4))))


def carried_headings(blocks: Column) -> Column:
    """``array<struct<h1, h2>>``: the headings in force in each block.

    A new H1 clears the H2. Only heading lines go through Python, many documents at
    once: each heading is filled forward within its document, and H2 within its H1.
    """

    def each(column: pa.Array) -> list:
        lists = column.to_pylist()
        sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
        lines = pd.Series([line for x in lists if x is not None for line in x], dtype=object)
        doc = pd.Series(np.repeat(np.arange(len(sizes)), sizes))
        level = lines.str.extract(r"^(#{1,2}) ")[0].str.len() if len(lines) else pd.Series(dtype=float)
        title = pd.Series([x[int(n) + 1 :].strip() if n == n else None for x, n in zip(lines, level, strict=True)], dtype=object)
        h1 = title.where(level == 1).groupby(doc).ffill()
        part = (level == 1).groupby(doc).cumsum()
        h2 = title.where(level == 2).groupby([doc, part]).ffill()
        rows = [{"h1": a if isinstance(a, str) else None, "h2": b if isinstance(b, str) else None} for a, b in zip(h1, h2, strict=True)]
        ends = np.cumsum(sizes)
        return [None if x is None else rows[end - size : end] for x, size, end in zip(lists, sizes, ends, strict=True)]

    def heading(block: Column) -> Column:
        return F.when(first_line(block).rlike("^#{1,2} "), first_line(block))

    return in_runs(lambda: each, "array<struct<h1 string, h2 string>>")(F.transform(blocks, heading))


def chunk_flags(text: Column) -> dict[str, Column]:
    body = strip(text)
    fence = body.startswith("```") & body.endswith("```")
    return {
        "is_code_block": fence,
        "contains_code_elements": F.contains(text, F.lit("`")),
        "contains_commands": text.rlike(f"(?Udmi)^\\s*({COMMANDS})"),
    }


def blocks_with_headings(docs: DataFrame, text: str) -> DataFrame:
    """One row per block: ``block_no``, ``h1``, ``h2``, ``block``."""
    split = docs.withColumn("_blocks", heading_blocks(F.col(text)))
    named = split.withColumn("_heads", carried_headings(F.col("_blocks")))
    kept = [c for c in docs.columns if c != text]
    rows = named.select(*kept, F.posexplode(F.arrays_zip("_blocks", "_heads")).alias("block_no", "_z"))
    return rows.select(*kept, "block_no", "_z._heads.h1", "_z._heads.h2", F.col("_z._blocks").alias("block"))


def markdown_chunks(docs: DataFrame, text: str, source: str, size: int | None = 1000) -> DataFrame:
    """Markdown chunks with their metadata: ``(<other columns>, id, text, metadata)``."""
    split = docs.withColumn("_blocks", heading_blocks(F.col(text)))
    named = split.withColumn("_heads", carried_headings(F.col("_blocks")))
    if size:
        named = named.withColumn("_pieces", _split_many(F.col("_blocks"), size, size // 4))
    else:
        named = named.withColumn("_pieces", F.lit(None).cast("array<array<string>>"))

    def pieces(z):
        head = z["_heads"]
        texts = F.filter(F.coalesce(z["_pieces"], F.array(z["_blocks"])), lambda p: ~is_blank(p))
        return F.transform(
            texts, lambda p: F.struct(p.alias("piece"), head["h1"].alias("h1"), head["h2"].alias("h2"))
        )

    zipped = F.arrays_zip("_blocks", "_heads", "_pieces") if size else F.transform(
        F.arrays_zip("_blocks", "_heads"),
        lambda z: F.struct(
            z["_blocks"].alias("_blocks"), z["_heads"].alias("_heads"), F.lit(None).cast("array<string>").alias("_pieces")
        ),
    )
    kept = [c for c in docs.columns if c not in (text, source)]
    rows = named.select(
        *kept, F.col(source).alias("_source"), F.posexplode(F.flatten(F.transform(zipped, pieces))).alias("_no", "_c")
    )
    body = strip(F.col("_c.piece"))
    line = first_line(F.col("_c.piece"))
    flags = chunk_flags(F.col("_c.piece"))
    h1, h2 = _h1(line), _h2(line)
    metadata = F.struct(
        F.coalesce(h1, F.col("_c.h1")).alias("h1_section"),
        F.when(h1.isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce(h2, F.col("_c.h2"))).alias("h2_section"),
        F.lit(None).cast("string").alias("h3_section"),
        F.lit(None).cast("string").alias("h4_section"),
        *[flag.alias(name) for name, flag in flags.items()],
        F.when(flags["is_code_block"], "code").otherwise("content").alias("chunk_type"),
        F.array().cast("array<string>").alias("topics"),
        F.col("_source").alias("source_url"),
        F.lit(False).alias("vlm_processed"),
        F.length(body).alias("char_count"),
        F.col("_no").alias("chunk_index"),
        F.lit(False).alias("is_sub_chunk"),
        F.lit(None).cast("string").alias("parent_chunk_id"),
    )
    name = F.concat_ws("_", F.lit("fallback_chunk"), "_source", F.col("_no").cast("string"))
    return rows.select(*kept, name.alias("id"), body.alias("text"), metadata.alias("metadata"))


def secondary_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Split chunks longer than ``size``; parts know their parent."""
    long = F.length("text") > size
    unsplit = {"char_count": F.length("text"), "is_sub_chunk": F.lit(False), "parent_chunk_id": F.lit(None).cast("string")}
    for name, value in unsplit.items():
        if name not in chunks.schema["metadata"].dataType.names:
            chunks = chunks.withColumn("metadata", F.col("metadata").withField(name, value))
    rows = chunks.withColumn("_pieces", split_column(F.col("text"), size, size // 4)).withColumn("_long", long)
    kept = [c for c in chunks.columns if c not in ("id", "text", "metadata")]
    parts = rows.select(*kept, "id", "metadata", "_long", F.posexplode("_pieces").alias("_no", "_text"))
    parts = parts.filter(~F.col("_long") | ~is_blank(F.col("_text")))
    metadata = (
        F.col("metadata")
        .withField("char_count", F.length("_text"))
        .withField("is_sub_chunk", F.lit(True))
        .withField("parent_chunk_id", F.col("id"))
    )
    return parts.select(
        *kept,
        F.when(F.col("_long"), F.concat("id", F.lit("_part_"), (F.col("_no") + 1).cast("string")))
        .otherwise(F.col("id"))
        .alias("id"),
        F.col("_text").alias("text"),
        F.when(F.col("_long"), metadata).otherwise(F.col("metadata")).alias("metadata"),
    )


# --- chunks given by a model ------------------------------------------------------------------


def _answer_json(answer: Column) -> Column:
    """The parsed JSON array inside a model's answer: the fenced one, else the first that parses."""

    def found(pattern: str) -> Column:
        text = F.regexp_extract(answer, pattern, 1)
        return F.when(text != "", text)

    return F.coalesce(
        F.when(
            F.contains(answer, F.lit("```json")) & answer.rlike(FENCED_ARRAY),
            F.coalesce(F.try_parse_json(found(FENCED_ARRAY)), F.parse_json(F.lit("null"))),
        ),
        F.try_parse_json(found("(?s)(\\[.*?\\s\\])")),
        F.try_parse_json(found("(?s)(\\[.*\\])")),
    )


def _elements(parsed: Column) -> Column:
    return F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed).cast("array<variant>")


def _truthy(value: Column) -> Column:
    """Python truth of a JSON value; null when the value is absent."""
    text = value.cast("string")
    return F.when(value.isNotNull(), ~F.coalesce(text.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(True)))


def _field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def with_parsed_answer(answers: DataFrame, answer: str) -> DataFrame:
    """Adds ``_json``. As generator output it is parsed once, whatever is filtered on it later."""
    return answers.select("*", F.explode(F.array(_answer_json(F.col(answer)))).alias("_json"))


def model_chunks(answers: DataFrame, answer: str, source: str) -> DataFrame:
    """Chunks listed in a model's answer, with ids and metadata filled in.

    An answer that is no JSON array gives none. Elements that are no objects or
    have a blank text are dropped; ``chunk_index`` is the place in the array.
    """
    return _listed_chunks(with_parsed_answer(answers, answer).drop(answer), source)


def _listed_chunks(parsed: DataFrame, source: str) -> DataFrame:
    kept = [c for c in parsed.columns if c not in ("_json", source)]
    listed = parsed.select(*kept, F.col(source).alias("_source"), F.posexplode(_elements(F.col("_json"))).alias("_no", "_e"))
    is_text = F.schema_of_variant(_field(F.col("_e"), "$.text")) == "STRING"
    rows = listed.withColumns(
        {
            "_text": F.when(is_text, strip(_field(F.col("_e"), "$.text", "string"))),
            "_m": _field(F.col("_e"), "$.metadata"),
        }
    ).filter(F.coalesce(F.col("_text"), F.lit("")) != "")
    meta = F.col("_m")

    def text_of(name: str) -> Column:
        return _field(meta, f"$.{name}", "string").alias(name)

    made = F.concat_ws("_", F.lit("vlm_chunk"), "_source", F.col("_no").cast("string"))
    metadata = F.struct(
        text_of("h1_section"),
        text_of("h2_section"),
        text_of("h3_section"),
        text_of("h4_section"),
        F.coalesce(_truthy(_field(meta, "$.is_code_block")), F.lit(False)).alias("is_code_block"),
        F.coalesce(_truthy(_field(meta, "$.contains_code_elements")), F.contains("_text", F.lit("`"))).alias(
            "contains_code_elements"
        ),
        F.coalesce(_truthy(_field(meta, "$.contains_commands")), F.lit(False)).alias("contains_commands"),
        F.coalesce(_field(meta, "$.chunk_type", "string"), F.lit("content")).alias("chunk_type"),
        F.coalesce(_field(meta, "$.topics", "array<string>"), F.array().cast("array<string>")).alias("topics"),
        F.col("_source").alias("source_url"),
        F.lit(True).alias("vlm_processed"),
        F.length("_text").alias("char_count"),
        F.col("_no").alias("chunk_index"),
        F.lit(False).alias("is_sub_chunk"),
        F.lit(None).cast("string").alias("parent_chunk_id"),
    )
    return rows.select(
        *kept,
        F.coalesce(_field(F.col("_e"), "$.id", "string"), made).alias("id"),
        F.col("_text").alias("text"),
        metadata.alias("metadata"),
    )


def chunks_or_fallback(
    docs: DataFrame, key: str, text: str, source: str, answer: str, size: int | None = 1000
) -> DataFrame:
    """Model chunks where the answer has any, the Markdown chunker for the other documents."""
    parsed = with_parsed_answer(docs.select(key, source, text, answer), answer).drop(answer)
    usable = F.coalesce(F.exists(_elements(F.col("_json")), _gives_chunk), F.lit(False))
    good = _listed_chunks(parsed.filter(usable).select(key, source, "_json"), source)
    if size:
        good = secondary_chunks(good, size)
    rest = markdown_chunks(parsed.filter(~usable).select(key, source, text), text, source, size)
    return good.unionByName(rest)


def _gives_chunk(element: Column) -> Column:
    is_text = F.schema_of_variant(_field(element, "$.text")) == "STRING"
    return F.coalesce(is_text & ~is_blank(_field(element, "$.text", "string")), F.lit(False))
