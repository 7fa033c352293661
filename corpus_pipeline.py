"""The corpus pipeline: language ID, near-dedup, PII, source mixing and BPE encoding, each over all that the one before kept.

Null texts, texts without a letter and texts in no language that was learned go in the first stage, which fills null languages;
where no row has a language, none goes. Of equal rows one stays; null ids and sources are kept as they are; very long texts pass
whole; of equal hashes the lower id comes first; an empty table gives an empty table; other columns pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, dedup, language, mixing, pii
from corpusloom.llm.common import cut, documents

TOKENIZER = "word_bpe_49k.json"


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language that the profiles know; others with a null language get the one told."""
    return language.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return dedup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target says, in the order of training."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded text of every document of the mix."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language_id", tell_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: SQL can't express gamma draws, profile distances or merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
