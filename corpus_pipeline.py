"""From raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftgauge.llm.decontamination import without_contaminated
from liftgauge.llm.piece_codec import encoded
from liftgauge.llm.pii import masked
from liftgauge.llm.quality import keep_good
from liftgauge.llm.simhash import first_of_each
from liftgauge.llm.tables import table
from liftgauge.session import Store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return masked(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the text they decode to, and digests of both."""
    return encoded(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Fingerprints, the random field and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote for itself goes when its result is written, that result when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        label = name.replace(" ", "-")
        result = Store(spark, label)
        with Store(spark, f"{label}-work"):
            docs = result.written(stage(spark, docs, sf_dir), label)
        if before is not None:
            before.close()
        before = result
    return docs
