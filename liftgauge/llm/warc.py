"""Write pages as WARC archives, read them back, and merge their indexes into capture histories."""

from __future__ import annotations

import base64
import gzip
import io
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from itertools import pairwise
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgauge.session import scratch_path, written

RECORDS_PER_FILE = 1000
#: Pages of more characters of HTML get an archive each, so that no archive outgrows what one row can hold.
LARGE_PAGE = 1 << 18
#: Entries of the index that a partition merges, about, and entries of a run that are unpacked at once.
RANGE_ENTRIES = 200_000
BLOCK_ENTRIES = 512
END = "\r\n\r\n"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: The made-up capture times of the pages repeat after so many ids, so that any id has one.
SECONDS = 1 << 31
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("url_key string, captured string, page_id long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), payload_digest (base32 SHA-1), payload_bytes, first (see `records`)."""
    def digest(batches):
        import hashlib

        for batch in batches:
            payloads = [(x.as_py() or "").encode() for x in batch.column("html")]
            digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("html"), pa.array(digests, pa.string()),
                 pa.array([len(p) for p in payloads], pa.int64())],
                names=["page_id", "url", "html", "payload_digest", "payload_bytes"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(
        digest, "page_id long, url string, html string, payload_digest string, payload_bytes long")


def record(page_id, url, html, digest, size, first, least) -> str:
    """One record without its end mark. A revisit names its response and leaves the payload out."""
    revisit = size >= least and first is not None and page_id != first
    block = "" if revisit else HTTP_HEAD + (html or "")
    captured = (EPOCH + timedelta(seconds=(page_id or 0) % SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """A record for every row, as gzipped WARC files under `path`: a thousand small pages or one large page each.

    Of equal payloads of `least` bytes or more the one with the smallest page_id is the response; rows that share
    that id are responses all. Rows without an id among rows with ids are revisits. The first ids are
    summed before the shuffle and joined back by digest, which Spark splits where many pages are alike.
    """
    digests = with_digests(pages)
    first = written(
        digests.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "first-captures")

    def write(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([record(*row, least) for row in rows], pa.string())], names=["value"])

    large = F.coalesce(F.length(F.col("html").cast("string")) > LARGE_PAGE, F.lit(False))
    for some, records in ((~large, RECORDS_PER_FILE), (large, 1)):
        joined = with_digests(pages.where(some)).join(first, ["payload_digest", "payload_bytes"], "left").select(
            "page_id", "url", "html", "payload_digest", "payload_bytes", "first")
        joined.mapInArrow(write, "value string").write.mode("append").option("lineSep", END).option(
            "compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; blocks are read by their length, whatever they contain."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield head, block


def url_key(url: str) -> str:
    """Host parts from the top domain down, then the path and query; empty for no URL."""
    rest = url.partition("://")[2]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0] if rest else ""


def _entry(head: dict[str, str], block: bytes) -> tuple:
    import hashlib

    page = lambda name: int(x) if (x := head.get(name, "")[len("<urn:page:"):-1]) else None
    size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":  # what was written is what counts
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], page("WARC-Record-ID"), size, digest,
            head["WARC-Type"], page("WARC-Refers-To"))


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, INDEX columns): every archive gives one run, sorted by URL key, time and page."""
    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))
                entries = sorted((_entry(*x) for x in parsed(stream)), key=_order)
                columns = list(zip(*entries, strict=True)) or [()] * 7
                yield _batch(columns, [name.as_py()] * len(entries))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(read, f"run string, {INDEX}")


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def _batch(columns, runs=None) -> pa.RecordBatch:
    arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]
    names = list(_NAMES)
    if runs is not None:
        arrays, names = [pa.array(runs, pa.string()), *arrays], ["run", *names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


class PackedRun(Sequence):
    """A sorted run kept in Arrow's columns; read from front to back it unpacks one block at a time."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches)
        self.start, self.block = 0, []

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, i: int) -> tuple:
        if not self.start <= i < self.start + len(self.block):
            self.start = i - i % BLOCK_ENTRIES
            columns = self.table.slice(self.start, BLOCK_ENTRIES).columns
            self.block = list(zip(*(c.to_pylist() for c in columns), strict=True))
        return self.block[i - self.start]


def loser_tree_merge(runs: Sequence[Sequence[tuple]], order=_order) -> Iterator[tuple]:
    """Merge sorted runs. Inner nodes hold the loser of their match, so each step replays one path only."""
    k = len(runs)
    if not k:
        return
    at = [0] * k

    def head(r: int) -> tuple:
        # A run at its end comes after all others; equal entries come in the order of the runs.
        return (1, (), r) if at[r] >= len(runs[r]) else (0, order(runs[r][at[r]]), r)

    heads = [head(r) for r in range(k)]
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] < heads[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while not heads[best][0]:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = head(best)
        node = (best + k) // 2
        while node:
            if heads[losers[node]] < heads[best]:
                losers[node], best = best, losers[node]
            node //= 2


def capture_histories(runs: DataFrame, size: int) -> DataFrame:
    """All `size` entries in one order by URL key, time and page, over the partitions of the result and within them.

    Each partition takes a range of keys from every run, as a run each, and merges them. The ranges are as many as
    keep a partition at about RANGE_ENTRIES entries. They are cut by page and run as well, so that the captures of one
    URL may fill many partitions. A partition holds its entries packed and unpacks a block of each run.
    """
    def merge(batches):
        by_run: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column("run")
            cut = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
            for begin, end in pairwise([0, *cut.tolist(), batch.num_rows]):
                if end > begin:
                    part = batch.slice(begin, end - begin)
                    by_run.setdefault(names[begin].as_py(), []).append(part.select(_NAMES))
        out: list[tuple] = []
        for entry in loser_tree_merge([PackedRun(parts) for parts in by_run.values()]):
            out.append(entry)
            if len(out) == 8192:
                yield _batch(list(zip(*out, strict=True)))
                out = []
        if out:
            yield _batch(list(zip(*out, strict=True)))

    order = ["url_key", "captured", "page_id"]
    least = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-size // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(ranges, *order, "run").sortWithinPartitions("run", *order)
    return dealt.mapInArrow(merge, INDEX)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write `pages` as archives in the shared folder, read them back, and give the merged index.

    Null html is an empty payload, null URLs have an empty key and come first. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, least)
    # Kept, as cutting the ranges reads the entries before they are dealt.
    runs = written(capture_runs(spark, path), "capture-runs")
    return capture_histories(runs, runs.count())
