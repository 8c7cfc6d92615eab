"""The queries over this subpackage's operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import conversation_trie, line_dedup


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # whole texts: smaller batches than the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.tokens import length_histogram

    return length_histogram(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sstable import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.line_dedup import passage_dedup

    return passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op3_near_vectors": op3_near_vectors,
    "op2_packing": op2_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_token_shards": op8_token_shards,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op10_line_passages": op10_line_passages,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op10_line_dedup": line_dedup.ORACLES["line_dedup"],
    "op10_line_passages": line_dedup.ORACLES["passage_dedup"],
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM q WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT q.page_id, q.payload_bytes, q.payload_digest,
               CASE WHEN keeper IS NOT NULL AND keeper <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper <> q.page_id THEN keeper END AS refers_to
        FROM q LEFT JOIN k USING (payload_digest, payload_bytes)
    """,
}
