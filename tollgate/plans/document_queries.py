"""Documents, chunks, the index and help suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate import api
from tollgate.functions.text import duration_seconds, has_letters, word_count
from tollgate.operators import chunking, help
from tollgate.operators.embedding import classify_texts, embed_text
from tollgate.plans import views
from tollgate.plans.catalog import query, view
from tollgate.plans.request_queries import validated
from tollgate.session import scratch_path
from tollgate.sources import index_store
from tollgate.sources.documents import parse_corpus, read_corpus, write_chunks

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def docs(spark, sf_dir):
    return views.documents(spark, sf_dir)


@query(
    "src_documents",
    """SELECT 'docs/' || doc_id AS source, md5(chr(10) || chr(10) || '# Source Document: docs/' || doc_id || chr(10) || chr(10) || text) AS text_md5 FROM documents""",
)
def src_documents(spark, sf_dir):
    source = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select(source.alias("source"), F.md5(chunking.with_source_header(source, F.col("text"))).alias("text_md5"))


view(
    "corpus",
    """SELECT doc_id::VARCHAR AS id, text, CASE WHEN doc_id % 2 = 0 THEN lang || '-m' ELSE lang END AS lang, source FROM documents
       WHERE doc_id % 10 NOT IN (3, 4, 5)""",
)


def corpus_lines(spark, sf_dir):
    """Documents as JSON lines; some cut short, some without id or text."""
    key = F.col("doc_id")
    line = F.to_json(
        F.struct(
            F.when(key % 10 != 4, key).alias("id"),
            F.when(key % 10 != 5, F.col("text")).alias("text"),
            "lang",
            F.when(key % 2 == 0, F.struct(F.concat("lang", F.lit("-m")).alias("lang"), "source"))
            .otherwise(F.struct(F.lit(None).cast("string").alias("lang"), F.col("source")))
            .alias("metadata"),
        )
    )
    return docs(spark, sf_dir).select(F.when(key % 10 == 3, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))


@query("corpus_scan", "SELECT id, md5(text) AS text_md5 FROM corpus", "corpus")
def corpus_scan(spark, sf_dir):
    return parse_corpus(corpus_lines(spark, sf_dir)).select("id", F.md5("text").alias("text_md5"))


@query("chunk_sink", "SELECT id, md5(text) AS text_md5 FROM corpus", "corpus")
def chunk_sink(spark, sf_dir):
    """Chunks written as JSON lines and read again."""
    path = scratch_path(spark, "chunks")
    write_chunks(parse_corpus(corpus_lines(spark, sf_dir)), path)
    return read_corpus(spark, path).select("id", F.md5("text").alias("text_md5"))


@query("corpus_metadata", "SELECT id, lang, source, '' AS topic FROM corpus", "corpus")
def corpus_metadata(spark, sf_dir):
    found = parse_corpus(corpus_lines(spark, sf_dir), metadata_fields=["lang", "source", "topic"])
    return found.select(
        "id",
        *[F.coalesce(F.col("metadata")[name], F.lit("")).alias(name) for name in ("lang", "source", "topic")],
    )


# --- chunks -------------------------------------------------------------------------------------


def _cut_sql(low: str, size: int) -> str:
    """End of the piece that starts at ``low``, in SQL over ``t``."""
    segment = f"substr(t, {low} + 1, {size})"
    tests = []
    for mark, width in (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("'! '", 2), ("'? '", 2)):
        back = f"instr(reverse({segment}), reverse({mark}))"
        at = f"({size} - {back} - {width} + 1)"
        tests.append(f"WHEN {back} > 0 AND {at} > 0 AND {at} + {width} > {size // 4} THEN {low} + {at} + {width}")
    return f"CASE WHEN {low} + {size} >= length(t) THEN length(t) {' '.join(tests)} ELSE {low} + {size} END"


def _split_views(name: str, base: str, size: int, overlap: int) -> None:
    """Views ``<name>_walk`` and ``<name>_pieces`` over a base of ``(id, t)``."""
    view(
        f"{name}_walk",
        f"""SELECT id, 0 AS n, 0 AS lo, {_cut_sql('0', size)} AS hi FROM {base} WHERE length(t) > {size}
            UNION ALL SELECT id, n + 1, nlo, {_cut_sql('nlo', size)} FROM
              (SELECT w.id, w.n, b.t, least(greatest(w.lo + 1, w.hi - {overlap}), w.hi) AS nlo
               FROM {name}_walk w JOIN {base} b ON b.id = w.id WHERE w.hi < length(b.t))""",
        base,
    )
    view(
        f"{name}_pieces",
        f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS piece_no, piece, true AS was_long FROM
              (SELECT w.id, w.n, trim(substr(b.t, w.lo + 1, w.hi - w.lo), {_SPACE}) AS piece FROM {name}_walk w JOIN {base} b ON b.id = w.id)
            WHERE piece <> '' UNION ALL SELECT id, 0, t, false FROM {base} WHERE length(t) <= {size}""",
        f"{base} {name}_walk",
    )


view("plain_docs", "SELECT doc_id AS id, text AS t FROM documents")
_split_views("plain", "plain_docs", 500, 125)


@query(
    "split_overlap",
    "SELECT id AS doc_id, piece_no::INTEGER AS piece_no, md5(piece) AS piece_md5, length(piece)::INTEGER AS chars FROM plain_pieces",
    "plain_pieces",
)
def split_overlap(spark, sf_dir):
    pieces = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.split_column(F.col("text"), 500, 125)).alias("piece_no", "p"))
    return pieces.select("doc_id", "piece_no", F.md5("p").alias("piece_md5"), F.length("p").alias("chars"))


view(
    "md_lines",
    """SELECT doc_id, i, line, (starts_with(line, '# ') OR starts_with(line, '## ')) AS head, max(i) OVER (PARTITION BY doc_id) AS last_i FROM
         (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM md_docs)""",
    "md_docs",
)
view(
    "md_all_blocks",
    """SELECT doc_id, b, string_agg(line, chr(10) ORDER BY i) || CASE WHEN max(i) < any_value(last_i) THEN chr(10) ELSE '' END AS block FROM
         (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM md_lines) GROUP BY doc_id, b""",
    "md_lines",
)
view(
    "md_blocks",
    f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block_no, string_split(trim(block, {_SPACE}), chr(10))[1] AS line
       FROM md_all_blocks WHERE trim(block, {_SPACE}) <> ''""",
    "md_all_blocks",
)
view(
    "md_heads",
    f"""SELECT doc_id, block_no, block, h1, CASE WHEN starts_with(line, '# ') THEN NULL ELSE last_value(CASE WHEN starts_with(line, '## ') THEN trim(line[4:], {_SPACE}) END IGNORE NULLS)
           OVER (PARTITION BY doc_id, h1_no ORDER BY block_no) END AS h2 FROM
         (SELECT *, last_value(CASE WHEN starts_with(line, '# ') THEN trim(line[3:], {_SPACE}) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no) AS h1,
            count(CASE WHEN starts_with(line, '# ') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS h1_no FROM md_blocks)""",
    "md_blocks",
)


@query("md_blocks", "SELECT doc_id, block_no::INTEGER AS block_no, md5(block) AS block_md5 FROM md_blocks", "md_blocks")
def md_blocks(spark, sf_dir):
    rows = views.md_docs(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(chunking.heading_blocks(F.col("md"))).alias("block_no", "b")).select(
        "doc_id", "block_no", F.md5("b").alias("block_md5")
    )


@query(
    "heading_context",
    "SELECT doc_id, block_no::INTEGER AS block_no, coalesce(h1, '') AS h1, coalesce(h2, '') AS h2 FROM md_heads",
    "md_heads",
)
def heading_context(spark, sf_dir):
    rows = chunking.blocks_with_headings(views.md_docs(spark, sf_dir), "md")
    return rows.select("doc_id", "block_no", F.coalesce("h1", F.lit("")).alias("h1"), F.coalesce("h2", F.lit("")).alias("h2"))


view("md_base", "SELECT doc_id * 100000 + block_no AS id, block AS t FROM md_heads", "md_heads")
_split_views("md", "md_base", 600, 150)
view(
    "md_chunks",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, piece_no) - 1 AS chunk_index, trim(piece, {_SPACE}) AS text,
         CASE WHEN starts_with(line, '# ') THEN trim(line[3:], {_SPACE}) ELSE h1 END AS h1,
         CASE WHEN starts_with(line, '# ') THEN NULL WHEN starts_with(line, '## ') THEN trim(line[4:], {_SPACE}) ELSE h2 END AS h2,
         contains(piece, '`') AS contains_code_elements,
         regexp_matches(piece, '(?im)^\\s*(curl|python|pip|docker|git)') AS contains_commands
       FROM (SELECT h.doc_id, h.block_no, h.h1, h.h2, p.piece_no, p.piece, string_split(trim(p.piece, {_SPACE}), chr(10))[1] AS line
             FROM md_pieces p JOIN md_heads h ON h.doc_id = p.id // 100000 AND h.block_no = p.id % 100000)""",
    "md_pieces md_heads",
)


def md_chunks(spark, sf_dir, size=600):
    return chunking.markdown_chunks(views.md_docs(spark, sf_dir), "md", "source", size)


@query(
    "md_chunks",
    """SELECT doc_id, 'fallback_chunk_docs/' || doc_id || '_' || chunk_index AS id, md5(text) AS text_md5, coalesce(h1, '') AS h1, coalesce(h2, '') AS h2,
         contains_code_elements, contains_commands, length(text)::INTEGER AS char_count FROM md_chunks""",
    "md_chunks",
)
def markdown(spark, sf_dir):
    return md_chunks(spark, sf_dir).select(
        "doc_id",
        "id",
        F.md5("text").alias("text_md5"),
        F.coalesce("metadata.h1_section", F.lit("")).alias("h1"),
        F.coalesce("metadata.h2_section", F.lit("")).alias("h2"),
        "metadata.contains_code_elements",
        "metadata.contains_commands",
        "metadata.char_count",
    )


@query(
    "chunk_numbering",
    "SELECT doc_id, count(*) AS chunks, max(chunk_index) AS last_index FROM md_chunks GROUP BY 1",
    "md_chunks",
)
def chunk_numbering(spark, sf_dir):
    rows = md_chunks(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("metadata.chunk_index").cast("long").alias("last_index"))


@query(
    "chunk_flags",
    """SELECT doc_id, lang = 'fr' AS is_code_block, true AS contains_code_elements, regexp_matches(t, '(?im)^\\s*(curl|python|pip|docker|git)') AS contains_commands FROM
         (SELECT doc_id, lang, CASE lang WHEN 'fr' THEN '```' || chr(10) || text || chr(10) || '``` ' ELSE '`' || text || CASE WHEN n_chars % 2 = 0 THEN chr(10) || '  Docker run' ELSE '' END END AS t FROM documents)""",
)
def chunk_flags(spark, sf_dir):
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n``` "))
    ticked = F.concat(F.lit("`"), "text", F.when(F.col("n_chars") % 2 == 0, "\n  Docker run").otherwise(""))
    rows = docs(spark, sf_dir).withColumn("t", F.when(F.col("lang") == "fr", fenced).otherwise(ticked))
    return rows.select("doc_id", *[c.alias(n) for n, c in chunking.chunk_flags(F.col("t")).items()])


_split_views("part", "plain_docs", 800, 200)


@query(
    "secondary_chunks",
    """SELECT CASE WHEN was_long THEN 'd' || id || '_part_' || (piece_no + 1) ELSE 'd' || id END AS id, md5(piece) AS text_md5, was_long AS is_sub_chunk,
         CASE WHEN was_long THEN 'd' || id ELSE '' END AS parent, length(piece)::INTEGER AS char_count FROM part_pieces""",
    "part_pieces",
)
def secondary(spark, sf_dir):
    chunks = docs(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        "text",
        F.struct(
            F.length("text").alias("char_count"),
            F.lit(False).alias("is_sub_chunk"),
            F.lit(None).cast("string").alias("parent_chunk_id"),
        ).alias("metadata"),
    )
    return chunking.secondary_chunks(chunks, 800).select(
        "id",
        F.md5("text").alias("text_md5"),
        "metadata.is_sub_chunk",
        F.coalesce("metadata.parent_chunk_id", F.lit("")).alias("parent"),
        "metadata.char_count",
    )


# --- model answers ---------------------------------------------------------------------------------

view(
    "answers",
    """SELECT doc_id, doc_id % 4 AS kind, lang, source, text FROM documents""",
)


def answers(spark, sf_dir):
    """Model answers about each document: fenced, raw, malformed, or no JSON at all."""
    kind = F.col("doc_id") % 4
    first = F.to_json(
        F.struct(
            F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
            F.col("text").alias("text"),
            F.struct(F.col("lang").alias("h1_section"), F.array("source").alias("topics"), F.lit(True).alias("contains_commands")).alias("metadata"),
        )
    )
    third = F.to_json(F.struct(F.concat(F.lit(" "), "source").alias("text"), F.lit("none").alias("metadata")))
    body = F.concat(F.lit("[\n"), first, F.lit(', {"id": "x", "text": "  "}, 5, '), third, F.lit("\n ]"))
    answer = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("Answer: "), body))
        .when(kind == 2, F.concat(F.lit("```json\n[ "), first, F.lit(", \n]\n```")))
        .otherwise(F.lit("I cannot do that."))
    )
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("source"), answer.alias("answer"), "text")


view(
    "model_chunks",
    f"""SELECT doc_id, 'c' || doc_id AS id, trim(text, {_SPACE}) AS text, lang AS h1, source AS topics, true AS commands, 0 AS chunk_index FROM answers WHERE kind IN (0, 1) AND trim(text, {_SPACE}) <> ''
       UNION ALL SELECT doc_id, 'vlm_chunk_docs/' || doc_id || '_3', source, '', '', false, 3 FROM answers WHERE kind IN (0, 1)""",
    "answers",
)


@query(
    "model_json_parse",
    "SELECT doc_id, id, md5(text) AS text_md5, chunk_index FROM model_chunks",
    "model_chunks",
)
def model_json_parse(spark, sf_dir):
    found = chunking.model_chunks(answers(spark, sf_dir).drop("text"), "answer", "source")
    return found.select("doc_id", "id", F.md5("text").alias("text_md5"), "metadata.chunk_index")


@query(
    "chunk_enhance",
    """SELECT doc_id, id, h1, topics, commands AS contains_commands, false AS is_code_block, contains(text, '`') AS contains_code_elements, 'content' AS chunk_type,
         length(text)::INTEGER AS char_count, true AS vlm_processed FROM model_chunks""",
    "model_chunks",
)
def chunk_enhance(spark, sf_dir):
    found = chunking.model_chunks(answers(spark, sf_dir).drop("text"), "answer", "source")
    return found.select(
        "doc_id",
        "id",
        F.coalesce("metadata.h1_section", F.lit("")).alias("h1"),
        F.array_join("metadata.topics", "|").alias("topics"),
        *[f"metadata.{c}" for c in ("contains_commands", "is_code_block", "contains_code_elements", "chunk_type", "char_count", "vlm_processed")],
    )


view(
    "fallback_base",
    f"""SELECT doc_id * 10 + chunk_index AS id, text AS t FROM model_chunks
       UNION ALL SELECT doc_id * 10 + 9, text FROM answers WHERE kind IN (2, 3) AND trim(text, {_SPACE}) <> ''""",
    "model_chunks answers",
)
_split_views("fallback", "fallback_base", 700, 175)


@query(
    "chunk_fallback",
    f"""SELECT id // 10 AS doc_id, id % 10 <> 9 AS vlm_processed, count(*) AS chunks, sum(length(trim(piece, {_SPACE})))::BIGINT AS chars
       FROM fallback_pieces GROUP BY 1, 2""",
    "fallback_pieces",
)
def chunk_fallback(spark, sf_dir):
    found = chunking.chunks_or_fallback(answers(spark, sf_dir), "doc_id", "text", "source", "answer", 700)
    return found.groupBy("doc_id", "metadata.vlm_processed").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "chunk_union",
    """SELECT 'md' AS kind, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM md_chunks
       UNION ALL SELECT 'model', count(*), sum(length(text))::BIGINT FROM model_chunks""",
    "md_chunks model_chunks",
)
def chunk_union(spark, sf_dir):
    """Chunks of two sources in one table; fields one side lacks are null there."""
    listed = chunking.model_chunks(answers(spark, sf_dir).drop("text"), "answer", "source").withColumn("kind", F.lit("model"))
    parsed = md_chunks(spark, sf_dir).withColumns({"kind": F.lit("md"), "part": F.lit(1)})
    both = parsed.unionByName(listed, allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


# --- index -----------------------------------------------------------------------------------------------


def _index_path(spark, sf_dir):
    path = scratch_path(spark, "index")
    rows = docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), "text", F.struct("lang", "source").alias("metadata")
    )
    index_store.write_index(rows, path, metadata_fields=("lang", "source"))
    return path


@query(
    "index_config",
    "SELECT 'hashed-trigrams' AS embedding_model_id, 'lang,source' AS metadata_fields, count(*) AS num_documents, 64 AS embedding_dimension FROM documents",
)
def index_config(spark, sf_dir):
    found = index_store.read_config(spark, _index_path(spark, sf_dir))
    return found.select(
        "embedding_model_id", F.array_join("metadata_fields", ",").alias("metadata_fields"), "num_documents", "embedding_dimension"
    )


@query("index_integrity", "SELECT count(*) AS documents, count(*) AS vectors, true AS sound FROM documents")
def index_integrity(spark, sf_dir):
    return index_store.integrity(spark, _index_path(spark, sf_dir))


@query("index_status", "SELECT 'exists_not_loaded' AS status, count(*) AS num_documents, 64 AS embedding_dimension, 'does_not_exist' AS elsewhere FROM documents")
def index_status(spark, sf_dir):
    path = _index_path(spark, sf_dir)
    found, elsewhere = index_store.status(spark, path), index_store.status(spark, f"{path}-none")
    row = (found["status"], found["num_documents"], found["embedding_dimension"], elsewhere["status"])
    return spark.createDataFrame([row], "status string, num_documents long, embedding_dimension int, elsewhere string")


# --- help --------------------------------------------------------------------------------------------------

view(
    "term_queries",
    """SELECT * FROM (VALUES ('pii', 'handling PII'), ('pii', 'sensitive data policy'), ('pii', 'data privacy'),
         ('sensitive', 'data sensitivity levels'), ('sensitive', 'confidential information rules'),
         ('modernbert i/o', 'input output validation'), ('modernbert i/o', 'API request format'), ('modernbert i/o', 'model validation'),
         ('colbert', 'content sensitivity classification'), ('colbert', 'text analysis policy'),
         ('vlm', 'image content policy'), ('vlm', 'video analysis rules'), ('vlm', 'multimodal validation'),
         ('length limit', 'text length restrictions'), ('length limit', 'payload size limits'),
         ('required field', 'mandatory fields'), ('required field', 'API data requirements'),
         ('format validation', 'data format rules'), ('format validation', 'pattern matching requirements')) v(term, q)""",
)
view(
    "violations",
    """SELECT request_id, policy, unnest(string_split(violations, '|')) AS violation FROM validated
       WHERE violations <> '' AND policy IN ('basicgate', 'strictgate', 'mediagate')""",
    "validated",
)
view(
    "keyword_queries",
    r"""SELECT request_id, policy, violation, CASE WHEN len(w) > 0 THEN 'how to fix ' || array_to_string(w[1:3], ' ') ELSE 'guidelines for ''' || substr(lower(violation), 1, 30) || '...''' END AS q FROM
         (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(violation), '\b[a-zA-Z]{4,}\b'))) AS w FROM violations v)
       WHERE NOT EXISTS (SELECT 1 FROM term_queries t WHERE contains(lower(violation), t.term))""",
    "violations term_queries",
)
view(
    "help_queries",
    """SELECT request_id, policy, q, row_number() OVER (PARTITION BY request_id ORDER BY q) AS no FROM
         (SELECT request_id, policy, t.q FROM violations v JOIN term_queries t ON contains(lower(v.violation), t.term)
          UNION SELECT request_id, policy, q FROM keyword_queries
          UNION SELECT request_id, policy, 'understanding policy: ' || substr(CASE policy WHEN 'basicgate' THEN 'Length limits on both texts of a request.'
             WHEN 'strictgate' THEN 'Caller identity and class lists on both texts.' ELSE 'Attached images, their derived text, lengths and identity.' END, 1, 50) FROM violations)""",
    "violations term_queries keyword_queries",
)


def rejected(spark, sf_dir):
    return validated(spark, sf_dir).filter("overall_status = 'REJECT_POLICY_VIOLATION'")


# Assistance differs by policy here so that all result forms occur.
HELP_POLICIES = {
    **views.POLICIES,
    "BasicGate": {**views.POLICIES["BasicGate"], "documentation_assistance": {"enabled": True}},
    "StrictGate": {
        **views.POLICIES["StrictGate"],
        "documentation_assistance": {"enabled": True, "index_path": "docs", "max_suggestions_per_query": 2, "max_total_suggestions": 4},
    },
}


@query("help_queries", "SELECT request_id, no::INTEGER AS no, q AS query FROM help_queries WHERE no <= CASE policy WHEN 'mediagate' THEN 4 ELSE 3 END", "help_queries")
def help_queries(spark, sf_dir):
    asked = help.with_help_queries(rejected(spark, sf_dir), views.POLICIES)
    rows = asked.select("request_id", F.posexplode("queries_used").alias("no", "query"))
    return rows.withColumn("no", F.col("no") + 1)


@query(
    "help_keywords",
    "SELECT request_id, count(*) AS violations, string_agg(q, '; ' ORDER BY q) AS queries FROM keyword_queries GROUP BY 1",
    "keyword_queries",
)
def help_keywords(spark, sf_dir):
    """Queries made of words, for violations without a known term."""
    rows = rejected(spark, sf_dir).select("request_id", "violation_reasons")
    plain = F.filter("violation_reasons", lambda v: F.size(help.term_queries(v)) == 0)
    made = rows.select("request_id", F.array_sort(F.transform(plain, help.keyword_query)).alias("q"))
    return made.filter(F.size("q") > 0).select(
        "request_id", F.size("q").cast("long").alias("violations"), F.array_join("q", "; ").alias("queries")
    )


view(
    "text_grams",
    """SELECT key, dim, count(*)::DOUBLE AS x FROM (SELECT key, (unicode(c[i]) * 961 + unicode(c[i + 1]) * 31 + unicode(c[i + 2])) % 64 AS dim
         FROM (SELECT key, c, unnest(range(1, len(c) - 1)) AS i FROM
           (SELECT key, string_split(' ' || lower(t) || ' ', '') AS c FROM
             (SELECT 'd' || doc_id AS key, text AS t FROM documents WHERE text <> '' UNION SELECT 'q' || q, q FROM help_queries WHERE no <= 4)))) GROUP BY 1, 2""",
    "help_queries",
)
view(
    "gram_units",
    "SELECT g.key, g.dim, g.x / l.len AS x FROM text_grams g JOIN (SELECT key, sqrt(sum(x * x)) AS len FROM text_grams GROUP BY 1) l ON l.key = g.key",
    "text_grams",
)
view(
    "hits",
    """SELECT q[2:] AS query, d[2:] AS id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d[2:]) AS rank FROM
         (SELECT a.key AS q, b.key AS d, round(sum(a.x * b.x), 10) AS score FROM gram_units a JOIN gram_units b ON a.dim = b.dim
          WHERE a.key LIKE 'q%' AND b.key LIKE 'd%' GROUP BY 1, 2) QUALIFY rank <= 3""",
    "gram_units",
)
view(
    "suggested",
    """SELECT request_id, id, max(score) AS score, count(*) OVER (PARTITION BY request_id) AS relevant,
         row_number() OVER (PARTITION BY request_id ORDER BY max(score) DESC, id) AS rank, any_value(total) AS total
       FROM (SELECT h.request_id, x.id, x.score, 4 AS total FROM help_queries h JOIN hits x ON x.query = h.q
             WHERE h.no <= CASE policy WHEN 'mediagate' THEN 4 ELSE 3 END AND x.score >= CASE policy WHEN 'mediagate' THEN 0.15 ELSE 0.1 END AND h.policy <> 'basicgate' AND x.rank <= 2)
       GROUP BY request_id, id""",
    "help_queries hits",
)


def document_index(spark, sf_dir):
    """Whole documents as an index; the source is the first heading."""
    rows = docs(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    metadata = F.struct(
        F.col("source").alias("h1_section"),
        F.when(F.col("lang") == "en", F.col("lang")).otherwise(nothing).alias("h2_section"),
        F.lit(False).alias("is_code_block"),
        F.lit(False).alias("contains_commands"),
        F.lit("content").alias("chunk_type"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.lit(False).alias("vlm_processed"),
    )
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), "text", metadata.alias("metadata"), embed_text(F.col("text")).alias("embedding")
    )


def suggestions(spark, sf_dir):
    return help.suggest(rejected(spark, sf_dir), HELP_POLICIES, document_index(spark, sf_dir))


@query(
    "help_suggestions",
    """SELECT request_id, rank::INTEGER AS rank, s.id AS document_id, round(score, 6) AS score, d.source || CASE d.lang WHEN 'en' THEN ': en' ELSE '' END AS title,
         md5(CASE WHEN length(d.text) > 500 THEN substr(d.text, 1, 500) || '...' ELSE d.text END) AS preview_md5
       FROM suggested s JOIN documents d ON d.doc_id::VARCHAR = s.id WHERE rank <= total""",
    "suggested",
)
def help_suggestions(spark, sf_dir):
    return suggestions(spark, sf_dir).select(
        "request_id",
        "rank",
        "suggestion.document_id",
        F.round("suggestion.relevance_score", 6).alias("score"),
        "suggestion.title",
        F.md5("suggestion.content_preview").alias("preview_md5"),
    )


@query(
    "help_counts",
    "SELECT request_id, any_value(relevant) AS relevant, count(*) AS shown FROM suggested WHERE rank <= total GROUP BY 1",
    "suggested",
)
def help_counts(spark, sf_dir):
    return suggestions(spark, sf_dir).groupBy("request_id").agg(
        F.max("relevant").alias("relevant"), F.count("*").alias("shown")
    )


@query(
    "help_outcome",
    """SELECT request_id, true AS attempted, CASE policy WHEN 'basicgate' THEN 'Documentation RAG index path not configured.'
         WHEN 'strictgate' THEN 'suggestions' ELSE 'Documentation RAG index at ''gone'' not available or failed to load.' END AS outcome
       FROM (SELECT DISTINCT request_id, policy FROM violations)""",
    "violations",
)
def help_outcome(spark, sf_dir):
    policies = {
        **HELP_POLICIES,
        "MediaGate": {**views.POLICIES["MediaGate"], "documentation_assistance": {"enabled": True, "index_path": "gone"}},
    }
    turned_down = rejected(spark, sf_dir)
    found = help.suggest(turned_down, HELP_POLICIES, document_index(spark, sf_dir))
    counts = found.groupBy("request_id").agg(F.max("relevant").alias("relevant"), F.count("*").alias("shown"))
    told = help.outcome(help.with_help_queries(turned_down, policies), counts, ["docs"])
    return told.select("request_id", F.col("documentation_assistance_attempted").alias("attempted"), "outcome")


@query(
    "suggestion_title",
    """SELECT 'fallback_chunk_docs/' || doc_id || '_' || chunk_index AS id, CASE WHEN coalesce(h2, '') <> '' THEN coalesce(h1, 'None') || ': ' || h2 ELSE h1 END AS title FROM md_chunks""",
    "md_chunks",
)
def suggestion_title(spark, sf_dir):
    return md_chunks(spark, sf_dir).select("id", help.suggestion_title(F.col("id"), F.col("metadata")).alias("title"))


@query(
    "suggestion_format",
    """SELECT 'fallback_chunk_docs/' || doc_id || '_' || chunk_index AS document_id, coalesce(h1, 'Documentation') AS primary_section, coalesce(h2, '') AS secondary_section,
         md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS preview_md5, 'docs/' || doc_id AS source_url, contains_commands FROM md_chunks""",
    "md_chunks",
)
def suggestion_format(spark, sf_dir):
    record = help.suggestion(F.col("id"), help.preview(F.col("text")), F.col("metadata"), F.lit(0.0))
    rows = md_chunks(spark, sf_dir).select(record.alias("s"))
    return rows.select(
        "s.document_id", "s.primary_section", "s.secondary_section", F.md5("s.content_preview").alias("preview_md5"),
        "s.source_url", "s.tags.contains_commands",
    )


# --- single-model calls and small texts -------------------------------------------------------------------


@query(
    "direct_classify",
    """SELECT request_id, CASE WHEN trim(output_text, ' ' || chr(10)) = '' THEN '''text'' field required.' ELSE '' END AS error,
         trim(output_text, ' ' || chr(10)) <> '' AS classified FROM requests""",
    "requests",
)
def direct_classify(spark, sf_dir):
    """Blank texts give an error row, never a failed job."""
    found = classify_texts(views.requests(spark, sf_dir), "output_text", "result")
    return found.select(
        "request_id",
        F.coalesce("result.error", F.lit("")).alias("error"),
        (F.col("result.confidence") > 0).alias("classified"),
    )


view(
    "asked_grams",
    """SELECT key, dim, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS x FROM
         (SELECT key, (unicode(c[i]) * 961 + unicode(c[i + 1]) * 31 + unicode(c[i + 2])) % 64 AS dim, count(*)::DOUBLE AS x FROM
           (SELECT key, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT key, string_split(' ' || lower(t) || ' ', '') AS c FROM
             (SELECT 'd' || doc_id AS key, text AS t FROM documents WHERE text <> '' UNION ALL SELECT 'q' || request_id, output_text FROM requests WHERE output_text <> ''))) GROUP BY 1, 2)""",
    "requests",
)


@query(
    "direct_retrieve",
    """SELECT q[2:]::BIGINT AS query_id, d[2:] AS id, round(score, 6) AS score, rank::INTEGER AS rank, '' AS error FROM
         (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d[2:]) AS rank FROM
           (SELECT a.key AS q, b.key AS d, round(sum(a.x * b.x), 10) AS score FROM asked_grams a JOIN asked_grams b ON a.dim = b.dim
            WHERE a.key LIKE 'q%' AND b.key LIKE 'd%' GROUP BY 1, 2)) WHERE rank <= 5
       UNION ALL SELECT request_id, '', -1.0, -1, '''query'' field required.' FROM requests WHERE output_text = ''""",
    "requests asked_grams",
)
def direct_retrieve(spark, sf_dir):
    """Each answer as a query for the five nearest documents; unanswered turns give an error row."""
    asked = views.requests(spark, sf_dir).select(F.col("request_id").alias("query_id"), F.col("output_text").alias("query"))
    found = api.retrieve(asked, document_index(spark, sf_dir))
    return found.select(
        "query_id",
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce(F.round("score", 6), F.lit(-1.0)).alias("score"),
        F.coalesce("rank", F.lit(-1)).alias("rank"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "text_stats",
    """SELECT doc_id, regexp_matches(text, '\\p{L}') AS has_letters, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM documents""",
)
def text_stats(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", has_letters(F.col("text")).alias("has_letters"), word_count(F.col("text")).cast("long").alias("words")
    )


@query(
    "window_parse",
    """SELECT event_id, (user_id + 1) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds FROM events""",
)
def window_parse(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhd"]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat((F.col("user_id") + 1).cast("string"), unit)
    return views.events(spark, sf_dir).select("event_id", duration_seconds(text).alias("seconds"))
