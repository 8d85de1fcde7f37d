"""The stages of the corpus pipeline.

Each stage takes (spark, docs, folder), works on all rows it gets and returns rows with the columns of
``documents``; the last returns token ids. ``run`` writes each stage's rows to the shared folder and reads
them back as the next one's.

A null text is the empty text for every stage; where a stage does not change it, it stays null. Very long texts
are read whole. Rows with a null id stay unless a stage rejects their text; of rows that are near copies the
smallest id stays, of equal ids one row by a digest of the whole row, and rows that are equal stay once. Further
columns, whatever their names, come along up to the last stage. Without rows every stage returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from staylens.llm import mixing, pieces, quality, secrets, simhash
from staylens.session import staged

# The weights of the sources, repeating by code point.
SOURCE_WEIGHTS = (5, 2, 1)
MODEL = "piece_bpe_32k.model"

# Neither groups of near copies nor the fair queue can be stated in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays, that of the smallest id."""
    return simhash.one_per_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced in the texts that hold them; all documents stay."""
    ledger = secrets.update_ledger(docs, secrets.new_ledger(spark))
    return secrets.redact(docs, ledger)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents stay as often as the mix takes them, by default in as many words as there are."""
    return mixing.repeated(
        docs, lambda sources: mixing.code_point_weights(sources, SOURCE_WEIGHTS)
    )


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document that is left: doc_id, ids, n_tokens."""
    return pieces.encoded(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
