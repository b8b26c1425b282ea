"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftgauge.llm.decontamination import contamination
from liftgauge.llm.licences import scan_licences
from liftgauge.llm.oracle import ORACLE_SQL  # noqa: F401  for the entry module
from liftgauge.llm.piece_codec import encoded
from liftgauge.llm.pii import find_spans
from liftgauge.llm.quality import quality_table
from liftgauge.llm.ranked_search import ranked
from liftgauge.llm.repeats import without_repeats
from liftgauge.llm.resampling import resampled
from liftgauge.llm.sharding import shard_table
from liftgauge.llm.simhash import near_copies
from liftgauge.llm.substring_dedup import without_repeated_passages
from liftgauge.llm.tables import table
from liftgauge.llm.url_filter import judge_urls, unwanted_hosts
from liftgauge.llm.warc import archived


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_table(table(spark, folder, "documents"), 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_spans(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judge_urls(pages, unwanted_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"), keep_text=True)


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_table(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_passages(table(spark, folder, "documents"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_sharding, op3_pii, op4_url_filter, op5_sentencepiece, op6_warc,
              op7_repeats, op8_licences, op9_quality, op10_simhash, op11_ranked_search, op12_substring_dedup, op13_resampling)
}
