"""A corpus from `documents`, in five stages: reject toxic texts, keep one of each group of near duplicates, replace
personal data, mix the sources to target weights, encode as pieces. Each stage is written as Parquet and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hingeworks.llm import dedup, mixing, pieces, pii, toxicity
from hingeworks.llm.common import cut, cuts_so_far, drop_cuts_since


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, learned from `labels`."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more: SimHash links and shared prefixes, checked on the sets."""
    return dedup.one_of_each(docs, width=5, similarity=0.8)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text."""
    done = pii.replaced(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("__entities") > 0, F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, round_trip of each text of the mix."""
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic_filter),
    ("simhash_dedup", near_dedup),
    ("pii_surrogates", replace_pii),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained scores, digests and piece lattices are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), cuts_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
            drop_cuts_since(before, docs)
    return docs
