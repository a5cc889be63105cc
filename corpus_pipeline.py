"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads
it again for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import op1_mix, op3_jaccard, op4_bpe, op5_dedup, op6_quality
from corvane.llm.common import discard, kept, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned decision list rejects go."""
    return op6_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the winner stays."""
    return op5_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more, the one with the smallest id stays."""
    return op3_jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op1_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and the digest of the text that they decode to."""
    tokenizer = op4_bpe.default_tokenizer()
    encoded = op4_bpe.encode(docs, tokenizer, ["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))
    return op4_bpe.decode(encoded, tokenizer).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe_tokens", tokens)]

#: A learned decision list and a tokenizer have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage and the operators in it have written goes when its result is there."""
    docs, others = table(spark, sf_dir, "documents"), kept()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(but=(*others, kept()[-1]))
    return docs
