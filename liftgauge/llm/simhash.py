"""Groups of near copies: SimHash fingerprints joined by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgauge.session import written

SHINGLE = 3
SEED = 42
FAN_OUT = 16
PAIRS_AT_ONCE = 1 << 20
_COUNTED = 1 << 14


def fingerprint(text: str | None) -> int:
    """64 bits, each set if over half the shingles' XXH64 have it; 0 without words."""
    # bytes.lower touches A-Z only, and bytes.split cuts at 0x20 and 0x09 to 0x0D.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE + 1)
    sums = np.zeros(64, np.int64)
    for first in range(0, last, _COUNTED):
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE]), SEED)
             for i in range(first, min(first + _COUNTED, last))], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * sums > last), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) for every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    rows = documents.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, text_key long, fp long")


def _cut(mask: int, parts: int) -> list[int]:
    """Split the set bits of a mask into `parts` masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts:len(bits) * (i + 1) // parts]) for i in range(parts)]


def route_masks(distance: int) -> list[int]:
    """Masks of which one at least agrees for any two prints within `distance` bits.

    Cut into distance + 1 parts, one part agrees; its complement is cut again, and once more. What shares
    a route differs in under 2^20 ways at distance 2, which bounds a group for any data.
    """
    masks = [0]
    for _ in range(3):
        masks = [m | part for m in masks for part in _cut(~m & (1 << 64) - 1, distance + 1)]
    return sorted(set(masks))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray code: each bit is the parity of itself and the higher ones."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def near_pairs(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of prints in Gray order that differ in `distance` bits at most.

    A node holds FAN_OUT nodes of the level below, its mask the bits they all share and its pattern those
    bits. Going down, a pair of nodes drops out, with all below it, once the bits in which their patterns differ exceed
    the distance; a child's masks include its parent's, so the differences only add up.
    """
    levels = [(prints, np.full(len(prints), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        heads = np.arange(0, len(pattern), FAN_OUT)
        same = np.bitwise_and.reduceat(mask, heads) & ~(
            np.bitwise_or.reduceat(pattern, heads) ^ np.bitwise_and.reduceat(pattern | ~mask, heads))
        levels.append((np.bitwise_or.reduceat(pattern, heads) & same, same))
    work = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = PAIRS_AT_ONCE // FAN_OUT**2
    while work:
        level, a, b = work.pop()
        if level == 0:
            yield a, b
            continue
        if len(a) > step:
            work += [(level, a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
            continue
        pattern, mask = levels[level - 1]
        below = np.arange(FAN_OUT)
        left = np.broadcast_to((a[:, None] * FAN_OUT + below)[:, :, None], (len(a), FAN_OUT, FAN_OUT)).ravel()
        right = np.broadcast_to((b[:, None] * FAN_OUT + below)[:, None, :], (len(b), FAN_OUT, FAN_OUT)).ravel()
        keep = (right < len(pattern)) & ((left < right) if level == 1 else (left <= right))
        left, right = left[keep], right[keep]
        differ = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
        keep = differ <= distance
        if keep.any():
            work.append((level - 1, left[keep], right[keep]))


def roots(prints: np.ndarray, distance: int) -> np.ndarray:
    """For each print the index of its group's first, links within the array alone."""
    root = np.arange(len(prints))
    for a, b in near_pairs(prints, distance):
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            # The roots take the smaller name too, so that earlier blocks of pairs stay joined.
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            root = root[root]
            if (root[a] == root[b]).all() and (root == root[root]).all():
                break
    return root


def star_links(prints: DataFrame, distance: int) -> DataFrame:
    """(u, v), u > v: links from each print to the first of its group on some route, at most one a route."""
    masks = [F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("shared"))
             for i, m in enumerate(route_masks(distance))]
    routed = prints.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(F.array(*masks)).alias("r"))
    keyed = routed.select(F.col("r.route").alias("route"), F.col("r.shared").alias("shared"), "rank", "fp")

    def linked(route, shared, fp):
        cut = np.flatnonzero((route[1:] != route[:-1]) | (shared[1:] != shared[:-1])) + 1
        begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
        us, vs = [], []
        for s in np.flatnonzero(ends - begins > 1):
            group = fp[begins[s]:ends[s]]
            root = roots(group.view(np.uint64), distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            us.append(np.maximum(group[moved], group[root[moved]]))
            vs.append(np.minimum(group[moved], group[root[moved]]))
        join = lambda xs: pa.array(np.concatenate([*xs, np.zeros(0, np.int64)]))
        return pa.RecordBatch.from_arrays([join(us), join(vs)], names=["u", "v"])

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("route", "shared", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            route, shared, fp = now
            # The last group may go on in the next batch.
            same = (route == route[-1]) & (shared == shared[-1])
            cut = len(fp) - int(same[::-1].argmin() if not same.all() else len(fp))
            if cut:
                yield linked(route[:cut], shared[:cut], fp[:cut])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield linked(*held)

    dealt = keyed.repartition("route", "shared").sortWithinPartitions("route", "shared", "rank")
    return dealt.mapInArrow(work, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node, by alternating large and small stars until nothing moves.

    What is joined back to the edges of a node is a written table and not the grouping of the same shuffle, so
    that Spark can split the edges of a hub over many tasks.
    """
    edges, before = written(links, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large-stars")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(
            small.union(down.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")


def grouped(documents: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, text_key, fp, root, component_id for every row; rows of one group have one root."""
    prints = written(fingerprints(documents), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(star_links(nodes, distance))
    named = written(
        nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")),
        "roots")
    names = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    labels = named.select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_copies(documents: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, text_key, fingerprint, component_id for every row.

    Documents whose fingerprints differ in `distance` bits at most are linked; a component is named by its
    smallest doc_id. Null and empty texts have fingerprint 0 and are linked like others. Equal fingerprints
    are one node of the search, so copies cost one row each. A component of null ids only has a null name.
    Repeated rows keep a row each; an empty table gives none.
    """
    return grouped(documents, distance).select(
        "doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(documents: DataFrame, distance: int = 2) -> DataFrame:
    """One document of each group, that with the smallest id; repeated rows of it are one document.

    In a group without ids it is the text with the smallest key.
    """
    rows = grouped(documents, distance)
    named = rows.where("doc_id = component_id")
    nameless = (
        rows.where("component_id IS NULL").groupBy("root").agg(F.min("text_key").alias("text_key"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text_key"))
    keep = named.select("doc_id", "text_key").unionByName(nameless).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    single = documents.withColumn("_own", F.xxhash64("text")).dropDuplicates(["doc_id", "_own"])
    kept = single.join(keep, single["doc_id"].eqNullSafe(F.col("_doc")) & (single["_own"] == F.col("_key")), "left_semi")
    return kept.drop("_own")
