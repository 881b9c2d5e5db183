"""One query per operator over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import burst_trie, deleted_interpolation, html_crf, license_scan, lsh_forest, quality_kn, repair_tokens, secret_cnn, spelling_fst, store, toxic_crf, trie_bpe, warc, wu_manber


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kn.judge(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = store.work_folder(spark, "warc")
    return warc.read(spark, root, warc.write(table(spark, sf_dir, "pages"), root))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.find(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = store.work_folder(spark, "token-ids")
    manifest = repair_tokens.write(table(spark, sf_dir, "documents"), root, tokenizer_path())
    return repair_tokens.read(spark, root, manifest)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_fst.variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_crf.score(docs, toxic_crf.fit(docs, table(spark, sf_dir, "labels")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_main_text": op5_main_text,
    "op6_lm_scores": op6_lm_scores,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_ids": op9_token_ids,
    "op10_bpe": op10_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_trie": op13_conversation_trie,
}

CHECK_SQL = {
    "op2_warc": warc.SQL,
    "op8_near_duplicates": lsh_forest.SQL,
    "op7_decontamination": wu_manber.SQL,
    "op11_spelling_variants": spelling_fst.SQL,
    "op13_conversation_trie": burst_trie.SQL,
}
