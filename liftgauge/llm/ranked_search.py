"""Ranked lexical search: Block-Max MaxScore over an index in shards, their best rows merged on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftgauge.llm.text_bytes import Words, slices
from liftgauge.session import scratch_path, written

#: Postings in a block, and in a shard (one document may have more).
BLOCK = 128
SHARD_POSTINGS = 1 << 19
SHARDS_A_FILE = 4
#: Documents that a query looks at before the bound rises for the first time; each next range is twice as long.
FIRST_RANGE = 256
#: Terms of queries that are sent to the shards at once.
QUERY_TERMS = 1 << 18
NO_ID = -(1 << 63)

BLOCKS = np.dtype([("first", "<i4"), ("last", "<i4"), ("at", "<i8"), ("count", "u1"), ("doc_width", "u1"),
                   ("tf_width", "u1"), ("max_tf", "<i4"), ("least_length", "<i4")])
#: The columns of a shard: their numbers go as bytes, which neither Spark nor Arrow has to take apart.
ARRAYS = {"terms": np.dtype("<u8"), "dfs": np.dtype("<i4"), "first_block": np.dtype("<i4"), "doc_ids": np.dtype("<i8"),
          "lengths": np.dtype("<i4"), "blocks": BLOCKS, "payload": np.dtype("u1")}
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{name} binary" for name in ARRAYS)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for `count[0]` places, and so on."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def packed(hashes: np.ndarray, docs: np.ndarray, tfs: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> dict:
    """The index row of one shard. Documents are numbered by their ids, so a smaller number wins a tie.

    A block keeps the distances between its documents and their counts in as few bytes as its largest needs, and, in
    the open, its first and last document, its largest count and its shortest document.
    """
    by_id = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    docs, lengths = number[docs], lengths[by_id]
    order = np.lexsort((docs, hashes))
    hashes, docs, tfs = hashes[order], docs[order], tfs[order]
    heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    dfs = np.diff(np.append(heads, len(hashes)))
    inner = (np.arange(len(hashes)) - np.repeat(heads, dfs)) % BLOCK
    starts = np.flatnonzero(inner == 0)
    counts = np.diff(np.append(starts, len(hashes)))
    steps = np.diff(docs, prepend=0)
    steps[starts] = 0
    blocks = np.zeros(len(starts), BLOCKS)
    blocks["first"], blocks["last"], blocks["count"] = docs[starts], docs[starts + counts - 1], counts
    blocks["doc_width"] = _width(np.maximum.reduceat(steps, starts))
    blocks["max_tf"] = np.maximum.reduceat(tfs, starts)
    blocks["tf_width"] = _width(blocks["max_tf"])
    blocks["least_length"] = np.minimum.reduceat(lengths[docs], starts)
    size = counts * (blocks["doc_width"].astype(np.int64) + blocks["tf_width"])
    blocks["at"] = np.cumsum(size) - size
    payload = np.zeros(size.sum() + 4, np.uint8)
    of = np.repeat(np.arange(len(starts)), counts)
    at = blocks["at"][of]
    for values, width, begin in ((steps, "doc_width", at),
                                 (tfs, "tf_width", at + counts[of] * blocks["doc_width"][of].astype(np.int64))):
        wide = blocks[width][of].astype(np.int64)
        place = begin + inner * wide
        for byte in range(int(wide.max())):
            some = wide > byte
            payload[place[some] + byte] = values[some] >> 8 * byte & 255
    arrays = {"terms": hashes[heads], "dfs": dfs, "first_block": np.append(np.searchsorted(starts, heads), len(starts)),
              "doc_ids": ids[by_id], "lengths": lengths, "blocks": blocks, "payload": payload}
    return {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())} | {
        name: array.astype(ARRAYS[name]).tobytes() for name, array in arrays.items()}


def unpacked(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
    """One of the ARRAYS of a row of the index."""
    return np.frombuffer(batch.column(name)[at].as_buffer(), ARRAYS[name])


def index(documents: DataFrame) -> DataFrame:
    """The written index: a row for each shard, of whole documents. It holds no figure of the whole corpus, so shards
    of more documents can be added.

    Words are known by 64 bits of hash.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = postings = 0

        def shard() -> pa.RecordBatch:
            nonlocal rows, postings
            row = packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            rows = postings = 0
            return pa.RecordBatch.from_pydict({name: pa.array([value]) for name, value in row.items()})

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for first, raw, at in slices(batch.column("text")):
                words = Words(raw, at)
                order = np.lexsort((words.hash, words.text))
                h, text = words.hash[order], words.text[order]
                heads = np.flatnonzero(np.concatenate((
                    [True] * bool(len(h)), (h[1:] != h[:-1]) | (text[1:] != text[:-1]))))
                n = len(at) - 1
                held.append((h[heads], (text[heads] + rows).astype(np.int32), np.diff(np.append(heads, len(h))).astype(np.int32),
                             ids[first:first + n], words.count))
                rows += n
                postings += len(heads)
                if postings >= SHARD_POSTINGS:
                    yield shard()
        if postings:
            yield shard()

    path = scratch_path(documents.sparkSession, "search-index")
    documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, INDEX).write.option(
        "maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
    return documents.sparkSession.read.schema(INDEX).parquet(path)


class Shard:
    """One row of the index, opened for search. `size` is (documents with words, words) of the whole corpus."""

    def __init__(self, row: dict[str, np.ndarray], size: tuple[int, int]):
        self.terms, self.ids, self.blocks, self.payload = (row[name] for name in ("terms", "doc_ids", "blocks", "payload"))
        self.first_block, lengths = row["first_block"].astype(np.int64), row["lengths"].astype(np.int64)
        self.size = size
        self.norm = self._norm(lengths)
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.first_block))
        self.owner = of
        self.by_first, self.by_last = (of << 32) + self.blocks["first"], (of << 32) + self.blocks["last"]
        self.most = impact(self.blocks["max_tf"].astype(np.int64), self._norm(self.blocks["least_length"].astype(np.int64)))
        self.opened = 0

    def _norm(self, length: np.ndarray) -> np.ndarray:
        return 100 - 75 + 75 * length * self.size[0] // self.size[1]

    def open(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `which`, document, impact) of every posting in the blocks `which`."""
        self.opened += len(which)
        block = self.blocks[which]
        count = block["count"].astype(np.int64)
        of = np.repeat(np.arange(len(which)), count)
        inner = _runs(np.zeros(len(which), np.int64), count)

        def read(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
            wide = width.astype(np.int64)[of]
            place = begin[of] + inner * wide
            out = self.payload[place].astype(np.int64)
            for byte in range(1, int(wide.max(initial=1))):
                some = wide > byte
                out[some] += self.payload[place[some] + byte].astype(np.int64) << 8 * byte
            return out

        steps = np.cumsum(read(block["at"], block["doc_width"]))
        begins = np.cumsum(count) - count
        docs = block["first"].astype(np.int64)[of] + steps - steps[begins][of]
        tfs = read(block["at"] + count * block["doc_width"], block["tf_width"])
        return of, docs, impact(tfs, self.norm[docs])

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the `top` best with a score above 0, ties to the smaller number.

        Lists are put in the order of their bounds. Those whose bounds together do not pass the score to beat are not
        essential: a document in none of the others cannot win. What the essential lists of a range of documents give is
        added up; then, from the largest bound down, a candidate is met with the block of a non-essential list that
        could hold it, and dropped unopened if even the block's maximum is too little.
        """
        place = np.searchsorted(self.terms, terms)
        here = (place < len(self.terms)) & (weights > 0)
        here[here] = self.terms[place[here]] == terms[here]
        place, weights = place[here], weights[here]
        winners, scores, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not len(place):
            return winners, scores
        begin, end = self.first_block[place], self.first_block[place + 1]
        which = _runs(begin, end - begin)
        bounds = weights * np.maximum.reduceat(self.most[which], np.cumsum(end - begin) - (end - begin))
        order = np.argsort(bounds, kind="stable")
        place, weights, bounds = place[order], weights[order], np.cumsum(bounds[order])
        low, step = 0, FIRST_RANGE
        while low < len(self.ids):
            high = min(low + step, len(self.ids))
            easy = int(np.searchsorted(bounds, beat, "right"))
            if easy == len(place):
                break
            lists = place[easy:] << 32
            begin, end = np.searchsorted(self.by_last, lists + low), np.searchsorted(self.by_first, lists + high)
            many = np.maximum(end - begin, 0)
            of, docs, gain = self.open(_runs(begin, many))
            inside = (docs >= low) & (docs < high)
            total = np.zeros(high - low, np.int64)
            np.add.at(total, docs[inside] - low, (np.repeat(weights[easy:], many)[of] * gain)[inside])
            rest = int(bounds[easy - 1]) if easy else 0
            found = np.flatnonzero((total > 0) & (total + rest > beat))
            total = total[found]
            found += low
            for at in range(easy - 1, -1, -1):
                if not len(found):
                    break
                rest = int(bounds[at - 1]) if at else 0
                block = np.searchsorted(self.by_last, (place[at] << 32) + found)
                block = np.minimum(block, len(self.owner) - 1)
                meets = (self.owner[block] == place[at]) & (self.blocks["first"][block] <= found) & (
                    self.blocks["last"][block] >= found)
                keep = total + np.where(meets, weights[at] * self.most[block], 0) + rest > beat
                found, total, block, meets = found[keep], total[keep], block[keep], meets[keep]
                if meets.any():
                    _, docs, gain = self.open(np.unique(block[meets]))
                    there = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    total += np.where(docs[there] == found, weights[at] * gain[there], 0)
                keep = total + rest > beat
                found, total = found[keep], total[keep]
            winners, scores = np.concatenate((winners, found)), np.concatenate((scores, total))
            first = np.lexsort((winners, -scores))[:top]
            winners, scores = winners[first], scores[first]
            beat = int(scores[-1]) if len(scores) == top else 0
            low, step = high, step * 2
        return winners, scores


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: grows with its count, falls with the document's length."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, h, times): the terms of all different texts of an item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for first, raw, at in slices(batch.column("text")):
                words = Words(raw, at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(words.text + first)), pa.array(words.hash.view(np.int64))], names=["item_id", "h"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    return rows.mapInArrow(work, "item_id long, h long").groupBy("item_id", "h").agg(F.count("*").alias("times"))


@dataclass(frozen=True)
class Queries:
    """Some items with their terms, all weighed by the whole corpus."""

    items: list
    begins: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def weighed(rows: list, shards: DataFrame, documents: int) -> Queries:
    """Queries from rows of `query_terms`; the number of documents of each term comes from all shards."""
    asked = np.unique(np.array([r["h"] for r in rows], np.int64))
    sent = shards.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value.view(np.uint64)
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                own, dfs = unpacked(batch, "terms", at), unpacked(batch, "dfs", at)
                place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                total += np.where(own[place] == wanted, dfs[place], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some]), pa.array(total[some])], names=["h", "n"])

    df = {r["h"]: r["n"] for r in shards.select("terms", "dfs").mapInArrow(count, "h long, n long").groupBy("h").agg(
        F.sum("n").alias("n")).collect()}
    rows = sorted((r for r in rows if r["h"] in df), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0))
    items, begins = [], []
    for at, row in enumerate(rows):
        if not at or row["item_id"] != rows[at - 1]["item_id"]:
            items.append(row["item_id"])
            begins.append(at)
    return Queries(items, np.array([*begins, len(rows)]), np.array([r["h"] for r in rows], np.int64), np.array(
        [r["times"] * term_weight(documents, df[r["h"]]) for r in rows], np.int64))


def shard_heaps(shards: DataFrame, queries: Queries, size: tuple[int, int], top: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's best rows for each query."""
    sent = shards.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard({name: unpacked(batch, name, at) for name in batch.schema.names}, size)
                items, docs, scores = [], [], []
                for n, item in enumerate(asked.items):
                    part = slice(asked.begins[n], asked.begins[n + 1])
                    found, score = shard.best(asked.terms[part].view(np.uint64), asked.weights[part], top)
                    items += [item] * len(found)
                    docs.append(shard.ids[found])
                    scores.append(score)
                ids = pa.array(np.concatenate([*docs, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()), ids, pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]))],
                    names=["item_id", "doc_id", "score"])

    columns = ["terms", "first_block", "doc_ids", "lengths", "blocks", "payload"]
    return shards.select(*columns).mapInArrow(work, "item_id long, doc_id long, score long").withColumn(
        "doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def ranked(documents: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the `top` documents with the highest score above 0.

    Null and empty texts have no terms; they are not among the documents counted. Items without terms, or with none
    that a document has, get no rows. Rows of one item_id are one item with the terms of all its different texts;
    a null item_id is an item too. Repeated documents are ranked each; a null doc_id comes first at a tie. Only
    doc_id and text, item_id and text are read. Queries go to the shards in blocks of about QUERY_TERMS terms
    (an item's terms stay together), so any number of items can be asked; each shard answers with `top` rows a query.
    """
    spark = documents.sparkSession
    shards = index(documents)
    size = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    terms = written(query_terms(items), "search-queries")
    heaps = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if size[0]:
        blocks = max(1, math.ceil(terms.count() / QUERY_TERMS))
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        for block in range(blocks):
            queries = weighed(dealt.where(F.col("block") == block).collect(), shards, size[0])
            heaps = heaps.unionByName(shard_heaps(shards, queries, tuple(size), top))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")
