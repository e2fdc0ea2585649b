"""From raw documents to token rows: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of `documents`; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, langid, pieces, pii
from tallyloom.llm.queries import TOKENIZERS, held_out
from tallyloom.session import materialise, small_batches

#: No stage can be said in SQL as a whole: models and signatures are learnt.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is ambiguous."""
    small_batches(spark)
    named = langid.identify(docs, langid.fit(docs, ~held_out()))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id.

    The shingles are five words and the threshold is 0.8. Of rows equal in id and text one stays;
    rows that only share that id stay, as do rows without an id.
    """
    groups = jaccard.JaccardJoin(docs, width=5, num=80, den=100).members()
    key = ["doc_id", "row_digest"]
    stay = groups.where("doc_id = component_id").select("doc_id", F.col("digest").alias("row_digest")).distinct()
    rows = docs.withColumn("row_digest", F.xxhash64("text"))
    # the join deals the rows by the very key that repeats are dropped by
    kept = rows.join(stay, key, "left_semi").dropDuplicates(key)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, personal data replaced by its kind and the length counted anew."""
    return pii.redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trip of every document."""
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
