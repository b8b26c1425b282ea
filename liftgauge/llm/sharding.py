"""Shards that all hold the same mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.llm.tables import numbered

SEED = 20240501


def interleaved_shards(rows: DataFrame, shards: int, source: str = "source", key: str = "doc_id",
                       seed: int = SEED) -> DataFrame:
    """Add `shard` and `slot` by proportional stratified interleaving.

    Rows are shuffled by a seeded hash of the key and ranked within their source; sorting all rows by
    (rank + 1/2) / (rows of the source) spreads every source evenly, and equal cuts of that order are the
    shards. Counts of shards differ by one at most, gaps in `slot` do not occur.

    A null source is a source of its own; null keys and repeated rows take places of their own; an empty
    table gives no rows. Further columns are carried; `_source`, `_mixed`, `_rank`, `_share`, `_place`
    are taken for the work and must not be in `rows`.
    """
    seeded = rows.withColumns({
        # The marker keeps a null source apart from a source with an empty name.
        "_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
        "_mixed": F.xxhash64(F.lit(seed), F.col(key)),
    })
    ranked = numbered(seeded, ["_source", "_mixed", key], "_rank", "shard-ranks", within=["_source"])
    sizes = seeded.groupBy("_source").agg(F.count("*").alias("_of"))
    shares = ranked.join(sizes, "_source").withColumn("_share", (F.col("_rank") + 0.5) / F.col("_of")).drop("_of")
    placed = numbered(shares, ["_share", "_source", "_mixed", key], "_place", "shard-places")
    total = rows.count()
    shard = F.expr(f"int((_place * {shards}L) div {max(total, 1)}L)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first)
        .drop("_source", "_mixed", "_rank", "_share", "_place")
    )


def shard_table(documents: DataFrame, shards: int = 24) -> DataFrame:
    """The documents' ids, sizes and checksums with their shards; the text itself is not moved.

    A null text has 0 bytes and the checksum 0 of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id", F.col("source"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"))
    return interleaved_shards(rows, shards).withColumn("grown_shard", F.lit(None).cast("int"))
