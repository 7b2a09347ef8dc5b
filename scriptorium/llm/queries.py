"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, chat_format, divergence, exact_dedup, minhash, mixing, ngram_join, pii, quality_model, quality_rules, suffix_tree, url_filters, whitening
from scriptorium.llm.shared import documents


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sainte-Laguë mix of all sources."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk recipes of all documents."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 5-word shingles are similar: components, and the links of each."""
    return ngram_join.ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.personal_data(documents(spark, sf_dir)).drop("found")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and weighted vocabulary over all urls."""
    return url_filters.url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents by the ranks of a public tokenizer."""
    return bpe.encode_documents(documents(spark, sf_dir), *tokenizer(), with_ids=False)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled rows that are not held out."""
    return quality_model.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a suffix tree, and the unigram base."""
    return suffix_tree.suffix_tree_scores(documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold another template's marks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat_format.digests(chat_format.format_turns(turns.unionByName(odd)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning over all documents."""
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the components of their covariance, each of variance 1."""
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("deviation_exact")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by buckets of their signatures, confirmed on whole sets."""
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart, and the terms that each uses more than its language."""
    return divergence.divergence(documents(spark, sf_dir))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_url_filters": op5_url_filters,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_model": op7_quality_model,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_chat_format": op9_chat_format,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op1_mixing": mixing.oracle(),
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_url_filters": url_filters.oracle(),
    "op9_chat_format": chat_format.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
