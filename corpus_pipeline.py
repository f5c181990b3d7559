"""The corpus pipeline: quality rules, near duplicates, secrets, the mix of sources and byte-level BPE, in this order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, minhash, mixing, quality, queries, secrets
from lattica.llm._shared import load, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; repeated rows and null ids are judged by their text; an empty table stays empty, and other
    columns, whatever their names, pass through.
    """
    return quality.quality_filter(docs, load(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows with a null id all stay, equal ids and texts are one document, of an id with several texts those alone go whose group
    keeps another document; an empty table stays empty, and other columns pass through.
    """
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked.

    Null and empty texts stay as they are, as do repeated rows and null ids; n_chars follows the new text, other columns pass
    through.
    """
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document has as many rows as the mix takes it, none to three.

    A null source is one of its own, a null text has no words; rows that share id, source and text share a decision; an empty
    table stays empty, and other columns pass through.
    """
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row, with the digests of the ids and of what they decode to.

    A null or empty text has no ids and the digest of nothing; every row has its row; other columns are not read.
    """
    return bpe.bpe_digests(docs, public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", quality_stage), ("minhash_dedup", dedup_stage), ("secret_scan", secrets_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]
#: The forest, the sketches and the cube method have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
