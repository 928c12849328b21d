"""The corpus pipeline: five operators in a row, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.bpe import bpe_tokens
from helixframe.llm.common import forget_at_end, set_aside, shared_folder, table
from helixframe.llm.mixing import mixed_documents
from helixframe.llm.near_copies import near_components
from helixframe.llm.pii import redacted_documents
from helixframe.llm.quality_rules import quality_rules
from helixframe.llm.simhash import deduplicated

#: SQL can't express XXH64 fingerprints, components or byte-pair merges.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts and texts of fewer than 50 words go; very long ones are judged whole; equal rows have one verdict and
    stay or go together; a ratio equal to the threshold stays. An empty table stays empty. Columns of any name pass.
    """
    renamed, restored = set_aside(docs, ("doc_id", "text"))
    return restored(quality_rules(renamed, table(spark, sf_dir, "labels")).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the least id.

    Candidates are SimHash's, found by the pigeonring filter, and MinHash's; the whole sets decide.

    Null and empty texts are copies of each other; very long texts are compared whole; ties of ids go to the least text hash,
    then the least other columns; of repeated rows one stays. Null ids come last. An empty table stays empty. Columns of any
    name pass.
    """
    return deduplicated(docs, near_components)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows.

    A null text stays null and an empty one empty; very long texts are searched whole; overlapping spans become one; repeated
    rows are treated alike. An empty table stays empty. Columns of any name pass.
    """
    return redacted_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null and empty texts have size 0 and are taken with the epochs of their source, if it has words; very long texts are taken
    whole or not; ties go by id; of equal rows that the cut divides, as many are taken as fit. An empty table stays empty.
    Columns of any name pass.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the decoded bytes' hash.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows are encoded each. An empty table
    stays empty. Other columns than doc_id, lang and source go.
    """
    got = bpe_tokens(docs.select("doc_id", "lang", "source", "text"))
    return got.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "decoded_ok")


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        forget_at_end(spark, f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
