"""A corpus pipeline of five operators: what each stage decides takes effect on the documents that the next one reads.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``, whatever extra columns it has;
the last returns the tokens. The output of each stage is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowkeel.llm import bpe, minhash, mixing, quality, secrets
from rowkeel.llm.common import table
from rowkeel.sources.staging import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go.

    A null or empty text is scored like others; null ids and repeated rows are rows like others, extra columns stay, an empty table stays
    empty; without labels every row stays.
    """
    return quality.kept(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8), of those with the smallest id one.

    Rows without words are linked with nothing and stay; extra columns stay with their row; an empty table stays empty.
    """
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no row goes.

    A null text stays null; equal texts are scanned once; null ids, repeated rows and extra columns stay; an empty table stays empty.
    """
    return secrets.without_secrets(docs, secrets.Ledger(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a row comes once per copy that the mix takes.

    A null source is a source of its own, the last; a null text has no words; extra columns stay; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded; the digest of the decoded ids shows that nothing was lost.

    A null text is the empty text and has no tokens; null ids and repeated rows give rows like others; an empty table gives none.
    """
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "source"], with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL can express neither a trained network nor an automaton.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
