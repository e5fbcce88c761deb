"""Registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidemill.llm import bpe, contamination, language, packing, prefixes, quality, ranked, repeats, secrets, simhash, toxicity, url_rules, vectors
from guidemill.llm.common import held_out
from guidemill.sources.tables import read_table

THRESHOLD = 0.7
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def vocabulary_files() -> tuple[str, str, str]:
    """Tokenizer file, its ranks and the split pattern of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_secrets(read_table(spark, folder, "documents")))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids."""
    return packing.pack_documents(docs, *vocabulary_files()).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read_table(spark, folder, "documents"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, url_rules.RULE_SCHEMA)
    return url_rules.judge_urls(read_table(spark, folder, "pages"), rules).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    profiles = language.language_profiles(docs, ~held)
    return language.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(read_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def _predicted(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.train_and_score(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), ~held_out(F.col("id"), 4, 2))
    return _predicted(scored, 4, 2)


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), ~held_out(F.col("id"), 3, 1))
    return _predicted(scored, 3, 1)


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.kept_digest(repeats.remove_repeats(read_table(spark, folder, "documents")))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.digest_columns(contamination.mark_contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")))


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")).withColumnRenamed("id", "doc_id")


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, ids = prefixes.share_openings(prefixes.number_turns(read_table(spark, folder, "conversations")))
    return prefixes.ends_digest(*prefixes.prefix_trie(prefixes.sequences(turns, ids, ["section", "pos"])))


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary_files()[0]
    encoded = bpe.encode_documents(read_table(spark, folder, "documents").select("doc_id", "text"), path)
    packed = encoded.select("doc_id", "ids", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return bpe.decode_documents(packed, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def llm_queries() -> dict[str, tuple]:
    """Name to (query, SQL or None)."""
    from guidemill.llm.sql import DECONTAMINATION, PREFIX_TRIE, RANKED_SEARCH, SUBSTRING_DEDUP, URL_FILTER

    return {
        "op1_secret_scan": (secret_scan, None), "op2_packing": (packing_, None), "op3_url_filter": (url_filter, URL_FILTER), "op4_simhash": (simhash_groups, None),
        "op5_language": (language_id, None), "op6_near_vectors": (near_vectors, None), "op7_quality": (quality_scores, None), "op8_toxicity": (toxicity_scores, None),
        "op9_substring_dedup": (substring_dedup, SUBSTRING_DEDUP), "op10_decontamination": (decontamination, DECONTAMINATION),
        "op11_ranked_search": (ranked_search, RANKED_SEARCH), "op12_conversation_trie": (conversation_trie, PREFIX_TRIE), "op13_bpe": (bpe_round_trip, None), "pipeline": (pipeline, None)}
