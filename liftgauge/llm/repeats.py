"""Remove repeated byte strings from all documents, by suffix arrays over what may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import closing
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.llm.lyndon_suffixes import suffix_array
from liftgauge.llm.text_bytes import mix, powers, slices
from liftgauge.session import Store, written

GRAM = 32
BLOCK = 64
ARRAY_BYTES = 1 << 16
#: Bytes of text hashed at once, so that the arrays over them stay in a core's cache.
SLICE = 1 << 16
#: Of one core in a suffix array; a core with more is counted window by window.
CORE_PIECES = ARRAY_BYTES // (2 * BLOCK)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_PLACE = np.uint64((1 << 32) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    """As `powers`, those for a slice of usual length computed once."""
    return _held(base)[:n] if n <= SLICE + 1 else powers(base, n)


@cache
def _held(base: int) -> np.ndarray:
    return powers(base, SLICE + 1)


class Rolled:
    """Hashes of any byte strings of an array, each in constant time."""

    def __init__(self, raw: np.ndarray):
        self.sums = []
        for base in _BASES:
            rolled = (raw.astype(np.uint64) + np.uint64(1)) * _powers(base, len(raw))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(rolled, dtype=np.uint64))))
        self.inverse = [_powers(i, len(raw) + 1) for i in _INVERSES]

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total = self.sums[which]
        h = (total[end] - total[start]) * self.inverse[which][start]
        return mix(h ^ mix((end - start).astype(np.uint64)))

    def grams(self, size: int, which: int) -> np.ndarray:
        """As `of`, of all strings of `size` bytes."""
        total = self.sums[which]
        h = (total[size:] - total[:-size]) * self.inverse[which][:len(total) - size]
        return mix(h ^ mix(np.array([size], np.uint64)))


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window the place of its smallest gram hash, the leftmost of equals; equal windows have the same.

    The upper halves of the hashes are compared, with the place below them, so one minimum finds both.
    """
    grams = width - GRAM + 1
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if grams > span:
        least = np.minimum(least[:len(least) - (grams - span)], least[grams - span:])
    return (least & _PLACE).astype(np.int64)


def runs(documents: DataFrame, width: int) -> DataFrame:
    """Runs of windows with one anchor: (doc_id, text_key, s, e, a, key, c1, c2), bytes s to e + width.

    A run's hash c1, c2 is of all its bytes, its key of its anchor.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for first, raw, at in slices(batch.column("text"), SLICE):
                if len(raw) < width:
                    continue
                rolled = Rolled(raw)
                hashes = rolled.grams(GRAM, 0)
                anchor = anchors(hashes, width)
                head = np.concatenate(([True], anchor[1:] != anchor[:-1]))
                head[at[:-1][at[:-1] < len(head)]] = True
                s = np.flatnonzero(head)
                text = np.searchsorted(at, s, "right") - 1
                e = np.minimum(np.append(s[1:], len(head)) - 1, at[text + 1] - width)
                inside = s <= e
                s, e, text = s[inside], e[inside], text[inside]
                doc = pa.array(text + first)
                begin = at[text]
                out = [s - begin, e - begin, anchor[s] - begin, hashes[anchor[s]].view(np.int64),
                       rolled.of(s, e + width, 0).view(np.int64), rolled.of(s, e + width, 1).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(doc), keys.take(doc), *(pa.array(x.astype(np.int64)) for x in out)],
                    names=["doc_id", "text_key", "s", "e", "a", "key", "c1", "c2"])

    return _rows(documents).mapInArrow(
        work, "doc_id long, text_key long, s long, e long, a long, key long, c1 long, c2 long")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))


def pieces(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted runs cut at every BLOCK from the anchor: (c1, c2, w, core, left, right).

    The bytes that all windows of a block have in common are its core, kept as a digest with the block's place;
    `left` and `right` are the piece's bytes before and after it. Windows that may be equal share a core.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, needed in zip(batch.column("text"), batch.column("needed"), strict=True):
                raw = (text.as_py() or "").encode()
                for run in needed.as_py():
                    s, e, a = run["s"], run["e"], run["a"]
                    block = (s - a) // BLOCK
                    while a + block * BLOCK <= e:
                        begin = a + block * BLOCK
                        w0, w1 = max(s, begin), min(e, begin + BLOCK - 1)
                        core = hashlib.blake2b(
                            raw[begin + BLOCK - 1:begin + width], digest_size=16, salt=str(block).encode()).digest()
                        rows.append((run["c1"], run["c2"], w0 - s, core, raw[w0:begin + BLOCK - 1],
                                     raw[begin + width:w1 + width]))
                        block += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                names=["c1", "c2", "w", "core", "left", "right"])

    needed = wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("s", "e", "a", "c1", "c2")).alias("needed"))
    needed = needed.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    texts = _rows(documents)
    joined = texts.join(needed, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["text_key"] == F.col("_key")))
    return joined.select("text", "needed").mapInArrow(
        work, "c1 long, c2 long, w long, core binary, left binary, right binary").distinct()


def repeated_starts(contents: list[str], width: int) -> list[list[int]]:
    """For each string the starts of its windows that also start elsewhere in the strings."""
    symbols: list[int] = []
    begins = []
    for n, content in enumerate(contents):
        begins.append(len(symbols))
        symbols += [ord(c) + len(contents) for c in content]
        symbols.append(n)  # ends differ, so that no match goes past one
    owner = np.repeat(np.arange(len(contents)), [len(c) + 1 for c in contents])
    order = np.array(suffix_array(symbols), np.int64)
    at = order - np.array(begins)[owner[order]]
    room = np.array([len(c) for c in contents])[owner[order]] - at >= width
    at, who = at[room], owner[order[room]]
    out: list[list[int]] = [[] for _ in contents]
    before, counted = "", False
    for i in range(len(at)):
        window = contents[who[i]][at[i]:at[i] + width]
        if window == before:
            if not counted:
                out[who[i - 1]].append(int(at[i - 1]))
            out[who[i]].append(int(at[i]))
            counted = True
        else:
            before, counted = window, False
    return out


def hot_cores(cut: DataFrame) -> DataFrame:
    """The cores of over CORE_PIECES different pieces, so at most one for every CORE_PIECES pieces."""
    return cut.select("core", "piece").distinct().groupBy("core").agg(F.count("*").alias("m")).where(
        F.col("m") > CORE_PIECES).select("core")


def counted(distinct: DataFrame) -> DataFrame:
    """(core, piece, low, high) as `contested` says, by a count of every single window, so that any number of
    pieces may share a core. A window is known by its place round the core and 128 bits of hash.
    """
    left, right = F.octet_length("left"), F.octet_length("right")
    windows = distinct.withColumn("low", F.explode(F.sequence(F.lit(0), left + right + 1 - BLOCK))).withColumn(
        "body", F.concat(F.expr("substring(left, low + 1)"),
                         F.expr(f"substring(right, 1, low + {BLOCK - 1} - octet_length(left))")),
    ).select(
        "core", "piece", "low", F.xxhash64("core", left - F.col("low"), "body").alias("h1"),
        F.xxhash64("body", left - F.col("low"), "core").alias("h2"))
    several = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    # Spark takes the windows to be as small as the pieces they come from, so it would broadcast them.
    starts = windows.join(several.hint("merge"), ["h1", "h2"]).groupBy("core", "piece").agg(
        F.sort_array(F.collect_set(F.col("low").cast("long"))).alias("at"))
    edge = lambda step: F.filter("at", lambda x: ~F.array_contains("at", x + step))
    return starts.select("core", "piece", F.explode(F.arrays_zip(edge(-1).alias("low"), edge(1).alias("high"))).alias("run")).select(
        "core", "piece", "run.low", "run.high")


def contested(cut: DataFrame) -> DataFrame:
    """(core, piece, low, high): runs of windows that are in several different pieces of one core.

    Suffix arrays find them, of at most CORE_PIECES pieces of one core; cores with more go to `counted`. In the strings that are sorted a core is one sign of its own, so a window is BLOCK signs long: the core
    and BLOCK - 1 bytes on both its sides together.
    """
    rows = cut.select("core", "piece", "left", "right")
    hot = written(hot_cores(cut), "hot-cores")
    distinct = rows.join(hot, "core", "left_anti").dropDuplicates(["core", "piece"])
    shared = rows.join(hot, "core", "left_semi").dropDuplicates(["core", "piece"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        cores = size = 0

        def close() -> None:
            nonlocal cores, size
            if len(group) > 1:
                for core, piece, left, right in group:
                    held.append((core, piece, left.decode("latin-1") + chr(256 + cores) + right.decode("latin-1")))
                    size += len(left) + len(right) + 1
                cores += 1
            group.clear()

        def solved() -> pa.RecordBatch:
            nonlocal cores, size
            rows = []
            for (core, piece, _), starts in zip(held, repeated_starts([h[2] for h in held], BLOCK), strict=True):
                ordered = np.sort(np.array(starts, np.int64))
                cuts = np.flatnonzero(np.diff(ordered) > 1) + 1
                rows += [(core, piece, int(part[0]), int(part[-1])) for part in np.split(ordered, cuts) if len(part)]
            held.clear()
            cores = size = 0
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                names=["core", "piece", "low", "high"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                    if size > ARRAY_BYTES:
                        yield solved()
                group.append(row)
        close()
        if held:
            yield solved()

    dealt = distinct.repartition("core").sortWithinPartitions("core").select("core", "piece", "left", "right")
    return dealt.mapInArrow(work, "core binary, piece long, low long, high long").unionByName(counted(shared))


def repeated_spans(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, spans): start and end of what is covered by strings of `width` bytes that start elsewhere too."""
    # What only leads to the next tables goes as soon as they are written.
    with closing(Store(documents.sparkSession, "repeat-runs")) as store:
        every = store.written(runs(documents, width), "repeat-runs")
        # A string that starts twice has its anchor twice, so a run whose key is alone has nothing to lose.
        twice = store.written(every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "repeat-keys")
        found = written(every.join(twice, "key"), "repeat-shared")
    with closing(Store(documents.sparkSession, "repeat-pieces")) as store:
        contents = store.written(found.groupBy("key", "c1", "c2").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "s", "e", "a")).alias("one")), "repeat-contents")
        several = contents.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        asked = contents.join(several, "key", "left_semi")
        cut = store.written(
            pieces(documents, asked.select("one.*", "c1", "c2"), width)
            .withColumn("piece", F.xxhash64("left", F.lit("core"), "right")), "repeat-pieces")
        # All windows go of a content in several places and of a piece in several contents; the suffix arrays find the rest.
        whole = contents.where("n > 1").select("c1", "c2", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
        counts = cut.groupBy("core", "piece").agg(
            F.count("*").alias("n"), F.first(F.octet_length("left") + F.octet_length("right") + 1 - BLOCK).alias("last"))
        shared = counts.where("n > 1").select(
            "core", "piece", F.lit(0).cast("long").alias("low"), F.col("last").cast("long").alias("high"))
        some = cut.select("c1", "c2", "w", "core", "piece").join(shared.union(contested(cut)), ["core", "piece"]).select(
            "c1", "c2", (F.col("w") + F.col("low")).alias("low"), (F.col("w") + F.col("high")).alias("high"))
        parts = written(whole.union(some).groupBy("c1", "c2").agg(
            F.bool_or(F.col("high").isNull()).alias("all"), F.collect_set(F.struct("low", "high")).alias("parts"),
        ).select("c1", "c2", F.when(F.col("all"), F.filter("parts", lambda p: p["high"].isNull())).otherwise(
            F.col("parts")).alias("parts")), "repeat-parts")
    # Both sides are written tables, so that Spark can split a content which very many documents share.
    return (
        found.select("doc_id", "text_key", "s", "e", "c1", "c2").join(parts, ["c1", "c2"])
        .select("doc_id", "text_key", F.transform("parts", lambda p: F.struct(
            (F.col("s") + p["low"]).alias("s"),
            (F.coalesce(F.col("s") + p["high"], F.col("e")) + width).alias("end"))).alias("spans"))
        .groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def without_repeats(documents: DataFrame, width: int = 400, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept, for every row.

    A byte goes if a string of `width` bytes over it also starts anywhere else in the input, in the same document
    too; overlaps count. Null is the empty text. Texts shorter than `width` stay whole. Repeated rows are
    repeats of each other. What is kept may cut characters: the digest is of its bytes, in `kept` cut ones are replaced.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept string" if keep_text else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["end"]) for x in spans.as_py() or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                cuts = [0, *(x for span in merged for x in span), len(raw)]
                kept = b"".join(raw[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2))
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                             kept.decode(errors="replace") if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[:5 + keep_text], names=names[:5 + keep_text])

    spans = repeated_spans(documents, width).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = _rows(documents)
    joined = rows.join(
        spans, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["text_key"] == F.col("_key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(work, schema)
