"""A corpus pipeline: filter by quality, drop near copies, cut repeated passages, redact, pack.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
returns a DataFrame; run() writes each stage's result as Parquet in the shared folder and reads it
again.  All stages but the last return the columns of documents, n_chars being the text's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.boosting import keep_good
from graphloom.llm.frames import frozen, table
from graphloom.llm.packing import pack
from graphloom.llm.passages import remove_repeats
from graphloom.llm.pii import redact
from graphloom.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees don't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return keep_one(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that stand elsewhere too."""
    return _documents(remove_repeats(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _documents(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("PII", private_data),
    ("packing", packing),
]
#: SQL can't express the trees, the field or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = frozen(stage(spark, docs, sf_dir))
    return docs
