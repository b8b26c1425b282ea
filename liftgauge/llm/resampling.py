"""Draw the documents that are most like a target, by importance weights of hashed word windows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from liftgauge.llm.tables import numbered
from liftgauge.session import written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Characters in a piece of a long text, and in the pieces whose chunks are pooled.
PIECE = 1 << 20
POOLED = 1 << 22
#: Rows whose features are held at once.
ROWS = 2048
#: What stands between words: the ASCII characters that are neither digits nor lower-case letters.
BETWEEN = Split(Regex(r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"), "removed")


class Pool:
    """The distinct chunks between blanks of some texts, each pre-tokenised once.

    A word never holds a blank, so the words of a text are those of its chunks in turn. `words` are windows of offset
    pairs cut from the pool's text; `spans` says which of them a chunk has.
    """

    def __init__(self, pieces: list[str], buckets: int):
        known: dict[str, int] = {}
        add = known.setdefault
        self.chunks = [np.array([add(c, len(known)) for c in piece.split(" ")], np.int64) for piece in pieces]
        # bytes.lower touches A-Z alone.
        text = " ".join(known).encode().lower().decode()
        pairs = BETWEEN.pre_tokenize_str(text)
        self.words = [word for word, _ in pairs]
        self.buckets = np.fromiter((zlib.crc32(w.encode()) % buckets for w in self.words), np.int32, len(pairs))
        starts = np.fromiter((pair[0] for _, pair in pairs), np.int64, len(pairs))
        begins = np.concatenate(([0], np.cumsum(np.fromiter((len(c) + 1 for c in known), np.int64, len(known)))))
        self.first = np.searchsorted(starts, begins)

    def places(self, piece: int) -> np.ndarray:
        """For each word of a piece in its order the place in `words`."""
        chunks = self.chunks[piece]
        begin, count = self.first[chunks], self.first[chunks + 1] - self.first[chunks]
        before = np.cumsum(count) - count
        return np.repeat(begin - before, count) + np.arange(count.sum())


def cut(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end at blanks."""
    at = 0
    while len(text) - at > PIECE:
        blank = text.find(" ", at + PIECE)
        if blank < 0:
            break
        yield text[at:blank]
        at = blank + 1
    yield text[at:]


def features(texts: list[str | None], buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all runs of 1 to `longest` words) of each text in turn."""
    pending: list[tuple[int, str]] = []
    held = 0

    def solved() -> Iterator[tuple[int, np.ndarray]]:
        pool = Pool([piece for _, piece in pending], buckets)
        for at, (n, _) in enumerate(pending):
            yield n, pool, pool.places(at)

    def pieces() -> Iterator[tuple[int, Pool, np.ndarray]]:
        nonlocal held
        for n, text in enumerate(texts):
            for piece in cut(text or ""):
                pending.append((n, piece))
                held += len(piece)
                if held >= POOLED:
                    yield from solved()
                    pending.clear()
                    held = 0
        yield from solved()

    now, words, found, tail = 0, 0, [], []
    for n, pool, places in pieces():
        if n != now:
            yield words, np.concatenate(found)
            now, words, found, tail = n, 0, [], []
        words += len(places)
        found.append(pool.buckets[places])
        if longest > 1:
            run = tail + [pool.words[i] for i in places.tolist()]
            found.append(np.fromiter(
                (zlib.crc32(" ".join(run[end - k:end]).encode()) % buckets
                 for end in range(len(tail) + 1, len(run) + 1) for k in range(2, min(longest, end) + 1)), np.int32))
            tail = run[-(longest - 1):]
    if texts:
        yield words, np.concatenate(found)


def with_features(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(doc_id, n_words, found): the buckets of all features of every row that has doc_id and text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                got = list(features(batch.column("text").to_pylist(), buckets, longest))
                ends = np.cumsum([0, *(len(f) for _, f in got)])
                values = pa.array(np.concatenate([f for _, f in got]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)],
                    names=["doc_id", "n_words", "found"])

    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, n_words long, found array<int>")


def histogram(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features all rows have in each bucket; a task sends `buckets` sums at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("found").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = featured.select("found").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floor of 1000 times the log of its share in the target over that in the corpus."""
    size = len(corpus)
    all_corpus, all_target = int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_corpus + size) / ((s + 1) * (all_target + size))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(featured: DataFrame, gain) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of each row's features."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            ends = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy())))
            total = np.concatenate(([0], np.cumsum(gain.value[found.flatten().to_numpy()])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(ends)),
                 pa.array(total[ends[1:]] - total[ends[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"])

    return featured.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def luck(key: Column, seed: int) -> Column:
    """A Gumbel draw of the key, in thousandths: the same for the same seed, wherever it is made."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
              longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of `documents`; `target` has a column text.

    Features are all runs of 1 to `longest` words. Drawn are `percent` in a hundred of the rows with `least_words`
    words, those with the highest scores; a score is the weight and a Gumbel draw, so this is sampling
    without replacement by importance. Ties go to the smaller doc_id.

    Null and empty texts have no features and weight 0. A null doc_id is drawn for like an empty one and
    comes before others at a tie; repeated rows are rows of their own with equal scores. An empty target
    gives gains by the corpus alone, an empty table no rows. Other columns are not read. Only the histograms, of
    `buckets` numbers each, come to the driver.
    """
    featured = written(with_features(documents, buckets, longest), "resampling-features")
    wanted = with_features(target.select(F.lit(None).alias("doc_id"), "text"), buckets, longest)
    gain = documents.sparkSession.sparkContext.broadcast(
        gains(histogram(featured, buckets), histogram(wanted, buckets)))
    scored = written(
        weighed(featured, gain).withColumns({
            "score": F.col("weight") + luck(F.col("doc_id"), seed),
            "_late": (F.col("n_words") < least_words).cast("int"),
        }).withColumn("_low", -F.col("score")), "resampling-scores")
    enough = scored.where("_late = 0").count()
    placed = numbered(scored, ["_late", "_low", "doc_id"], "_place", "resampling-places")
    drawn = (F.col("_late") == 0) & (F.col("_place") < percent * enough // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("_place") + 1)).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank")
