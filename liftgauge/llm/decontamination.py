"""Find passages of benchmark items in documents by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.llm.text_bytes import Words, slices
from liftgauge.session import written

SHINGLE = 5
#: The filter of benchmark shingles has 64-bit words for at least so many bits a shingle, from 1 MB up to 128 MB.
#: A fuller one lets more shingles pass to the join, which decides in any case.
SHINGLE_BITS = 16
LEAST_WORDS = 1 << 17
MOST_WORDS = 1 << 24


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n, shingles): each window once for each item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, raw, at in slices(batch.column("text")):
                words = Words(raw, at)
                rows = {"item_id": [], "words": [], "n": [], "shingles": []}
                hashes = {}
                for k in range(1, SHINGLE + 1):
                    index, h = words.shingles(k)
                    hashes[k] = dict(zip(index.tolist(), h.tolist(), strict=True))
                for t in range(len(at) - 1):
                    begin, count = int(words.first[t]), int(words.count[t])
                    if not count:
                        continue
                    spelled = [words.word(i) for i in range(begin, begin + count)]
                    size = min(window, count)
                    k = min(SHINGLE, size)
                    for s in range(count - size + 1):
                        rows["item_id"].append(ids[first + t])
                        rows["words"].append(" ".join(spelled[s:s + size]))
                        rows["n"].append(size)
                        rows["shingles"].append([hashes[k][begin + s + j] for j in range(size - k + 1)])
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                    ("item_id", pa.int64()), ("words", pa.string()), ("n", pa.int32()),
                    ("shingles", pa.list_(pa.int64()))]))

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "item_id long, words string, n int, shingles array<long>").distinct()


def filter_words(shingles: int) -> int:
    """64-bit words of the filter for so many shingles, a power of two."""
    needed = -(-shingles * SHINGLE_BITS // 64)
    return min(max(LEAST_WORDS, 1 << max(needed - 1, 0).bit_length()), MOST_WORDS)


def shingle_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap, as large as the number of rows asks for, with a bit for each hash in column h."""
    size = filter_words(hashes.count())
    bits = hashes.groupBy(F.pmod("h", F.lit(size)).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 58) AS INT))")).alias("bits"))
    got = bits.toPandas()
    out = np.zeros(size, np.int64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _passes(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = filter_bits[h % len(filter_bits)].view(np.uint64)
    return (word >> (h.view(np.uint64) >> np.uint64(58))) & np.uint64(1) == 1


def shingle_counts(documents: DataFrame, filter_bits) -> DataFrame:
    """(h, n): how often the shingles that pass the filter stand in all documents."""
    def count(batches):
        for batch in batches:
            for _, raw, at in slices(batch.column("text")):
                words, bits = Words(raw, at), filter_bits.value
                passed = [h[_passes(bits, h)] for _, h in map(words.shingles, range(1, SHINGLE + 1))]
                h, n = np.unique(np.concatenate(passed), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return documents.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def candidates(documents: DataFrame, filter_bits, window: int) -> DataFrame:
    """For every document a row with its number of words (h null), and a row for each shingle that passes
    with its place `at` and the words around it, from `start` on."""
    def find(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for first, raw, at in slices(batch.column("text")):
                words, bits = Words(raw, at), filter_bits.value
                places, hashes = [], []
                for k in range(1, SHINGLE + 1):
                    index, h = words.shingles(k)
                    passed = _passes(bits, h)
                    places.append(index[passed])
                    hashes.append(h[passed])
                place, h = np.concatenate(places), np.concatenate(hashes)
                text = words.text[place]
                begin, end = words.first[text], words.first[text + 1]
                left = np.maximum(begin, place - window)
                right = np.minimum(end, place + window)
                around = [
                    [words.word(j) for j in range(a, b)] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
                texts = np.arange(len(at) - 1)
                none = pa.nulls(len(texts))
                doc = pa.array(np.concatenate((texts, text)) + first)
                yield pa.RecordBatch.from_arrays([
                    ids.take(doc), keys.take(doc),
                    pa.array(np.concatenate((words.count, words.count[text])).astype(np.int64)),
                    pa.concat_arrays([none.cast(pa.int64()), pa.array(h)]),
                    pa.concat_arrays([none.cast(pa.int64()), pa.array((place - begin).astype(np.int64))]),
                    pa.concat_arrays([none.cast(pa.int64()), pa.array((left - begin).astype(np.int64))]),
                    pa.concat_arrays([none.cast(pa.list_(pa.string())), pa.array(around, pa.list_(pa.string()))]),
                ], names=["doc_id", "text_key", "n_words", "h", "at", "start", "around"])

    rows = documents.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(
        find, "doc_id long, text_key long, n_words long, h long, at long, start long, around array<string>")


def contamination(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated for every row of `documents`.

    A window is found whole or not at all, so of its shingles in the order of their rarity (count in
    all documents, then hash) one is the necessary prefix. It is looked up in the documents; its offset in the
    window and the document's length bound where the window can begin; the words themselves decide.

    Null and empty texts have no words. Items without words have no window; repeated items count once by
    item_id. Repeated rows are judged each. An empty benchmark leaves every document clean.
    """
    context = documents.sparkSession.sparkContext
    windows = written(item_windows(items, window), "item-windows")
    distinct = windows.select("words", "n", "shingles").distinct()
    shingles = distinct.select("words", "n", F.posexplode("shingles").alias("offset", "h"))
    counts = shingle_counts(documents, context.broadcast(shingle_filter(shingles)))
    prefix = written(
        shingles.join(counts.withColumnRenamed("n", "seen"), "h")  # what no document has can't be found
        .groupBy("words", "n").agg(
            F.min(F.struct("seen", "h", "offset")).alias("rarest"), F.count("*").alias("present"))
        .where(F.col("present") == F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1)
        .select("words", "n", "rarest.h", "rarest.offset"),
        "window-prefixes")
    found = written(candidates(documents, context.broadcast(shingle_filter(prefix)), window), "window-candidates")
    begin = F.col("at") - F.col("offset")
    hits = (
        found.where("h IS NOT NULL").join(prefix, "h").withColumn("begin", begin)
        .where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice("around", (F.col("begin") - F.col("start") + 1).cast("int"), F.col("n")), " ")
               == F.col("words"))
        .select("doc_id", "text_key", "begin", "n", "words")
    )
    key = ["doc_id", "text_key"]
    hit_words = (
        hits.select(*key, F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("place"))
        .distinct().groupBy(*key).agg(F.count("*").alias("n_hit")))
    hit_items = (
        hits.select(*key, "words").distinct().join(windows.select("item_id", "words"), "words")
        .select(*key, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items")))
    # A grouping takes null ids as equal, which a join on the names would not.
    none = F.lit(None)
    result = (
        hit_words.select(*key, "n_hit", none.cast("array<string>").alias("items"))
        .unionByName(hit_items.select(*key, none.cast("long").alias("n_hit"), "items"))
        .groupBy(*key).agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "n_hit", "items"))
    return found.where("h IS NULL").join(
        result, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left",
    ).select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a window of any item; rows with a null id are judged like others."""
    bad = contamination(documents, items, window).where("contaminated").select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    return documents.join(
        bad, documents["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(documents["text"]) == F.col("_key")),
        "left_anti")
