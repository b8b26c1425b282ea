"""Remove passages that an earlier document has too, by suffix automata of bounded shards of passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.llm.text_bytes import NOT_SPACE, SAME, Words, mix, powers, slices
from liftgauge.session import written

GRAM = 8
#: Windows in a passage at most, so that a document of one repeated word is many equal passages.
LONGEST_RUN = 512
#: Words of passages in one automaton; a group of passages with more is dealt anew in blocks of fewer windows.
SHARD_WORDS = 1 << 16
BLOCKS = (8, 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class Passages:
    """The windows of `width` words in some texts, each with its anchor: the leftmost least of its hashes of GRAM words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, width: int):
        self.words = words = Words(raw, at, SAME, NOT_SPACE)
        self.width = width
        self.sums, self.inverse = [], []
        for base, back in zip(_BASES, _INVERSES, strict=True):
            rolled = words.hash * powers(base, len(words.hash))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(rolled, dtype=np.uint64))))
            self.inverse.append(powers(back, len(words.hash) + 1))
        size = min(GRAM, width)
        place = np.arange(max(0, len(words.hash) - size + 1))
        grams = self.hash(place, place + size, 0)
        anchor, span, wanted = place, 1, width - size + 1

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(grams[a] <= grams[b], a, b)

        while span * 2 <= wanted:
            anchor = least(anchor[:-span], anchor[span:])
            span *= 2
        if span < wanted:
            anchor = least(anchor[:len(anchor) - (wanted - span)], anchor[wanted - span:])
        window = np.arange(len(anchor))
        self.inside = words.text[window] == words.text[window + width - 1] if len(window) else window == 1
        self.anchor, self.key = anchor, grams[anchor]

    def hash(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total = self.sums[which]
        return mix((total[end] - total[start]) * self.inverse[which][start] ^ mix((end - start).astype(np.uint64)))

    def runs(self, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run in one text over which all of `same` stay equal."""
        if not self.inside.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = self.words.text[:len(self.inside)]
        changes = [x[1:] != x[:-1] for x in (text, *same)]
        head = self.inside & np.concatenate(([True], np.logical_or.reduce([*changes, ~self.inside[:-1]])))
        last = self.inside & np.concatenate((head[1:] | ~self.inside[1:], [True]))
        return np.flatnonzero(head), np.flatnonzero(last)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, key) of the runs with one key, of LONGEST_RUN windows at most."""
        first, last = self.runs(self.key)
        parts = (last - first) // LONGEST_RUN + 1
        of = np.repeat(np.arange(len(first)), parts)
        first = first[of] + LONGEST_RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        return first, np.minimum(first + LONGEST_RUN - 1, last[of]), self.key[first]

    def blocks(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, key) of the runs whose windows lie in one block of `size` places before one anchor.

        The key is that of the words which all windows of the block share, and of its place. Equal windows have it alike.
        """
        window = np.arange(len(self.anchor))
        block = (self.anchor - window) // size
        first, last = self.runs(self.anchor, block)
        anchor, block = self.anchor[first], block[first]
        core = anchor - block * size
        key = self.hash(core, core - size + 1 + self.width, 0)
        return first, last, mix(key ^ mix(block.astype(np.uint64) + np.uint64(1)))

    def rows(self, cut: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(text, [first and last window in the text, key, two hashes of all words]) of runs."""
        first, last, key = cut
        text = self.words.text[first]
        begin = self.words.first[text]
        return text, [(first - begin).astype(np.int64), (last - begin).astype(np.int64), key.view(np.int64),
                      *(self.hash(first, last + self.width, n).view(np.int64) for n in (0, 1))]


RUN = ["s", "e", "key", "c1", "c2"]


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))


def passages(rows: DataFrame, width: int, block: int | None = None) -> DataFrame:
    """The runs of all windows in `text`, each row's with its other columns; with `block` those of such blocks."""
    carried = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(c) for c in carried]
            for first, raw, at in slices(batch.column("text")):
                found = Passages(raw, at, width)
                text, values = found.rows(found.blocks(block) if block else found.cut())
                of = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(of) for c in others), *map(pa.array, values)], names=[*carried, *RUN])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried), *(f"{c} long" for c in RUN)])
    return rows.mapInArrow(work, schema)


def bodies(texts: DataFrame, wanted: str, columns: list[str], width: int) -> DataFrame:
    """Each struct of the array `wanted` in a row of its own, with the words of its windows as `text`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                words = (batch.column("text")[at].as_py() or "").encode().split()
                runs = batch.column(wanted)[at].values.flatten()
                named = dict(zip(columns, runs, strict=True))
                text = [b" ".join(words[s:e + width]) for s, e in zip(
                    named["s"].to_pylist(), named["e"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*runs, pa.array(text, pa.binary()).cast(pa.string())], names=[*columns, "text"])

    return texts.select("text", wanted).mapInArrow(work, ", ".join(f"{c} long" for c in columns) + ", text string")


class Automaton:
    """The suffix automaton of some word sequences. `least` is the smallest document in which a state's words stand."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [0]
        for words, document in sequences:
            state = 0
            for word in words:
                state = self._grown(state, word, document)
        # Words of a state's link end wherever those of the state do; the longer states come first.
        for state in sorted(range(1, len(self.to)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def _state(self, to: dict[int, int], link: int, length: int, least: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.to) - 1

    def _grown(self, last: int, word: int, document: int) -> int:
        """The state of the last one's words and `word`, made if it is new."""
        to, link, length = self.to, self.link, self.length
        there = to[last].get(word)
        if there is not None and length[there] == length[last] + 1:
            if document < self.least[there]:
                self.least[there] = document
            return there
        new = None if there is not None else self._state({}, 0, length[last] + 1, document)
        state = last
        while state >= 0 and word not in to[state]:
            to[state][word] = new
            state = link[state]
        if state >= 0:
            there = to[state][word]
            if length[there] != length[state] + 1:
                copy = self._state(dict(to[there]), link[there], length[state] + 1, self.least[there])
                link[there] = copy
                while state >= 0 and to[state].get(word) == there:
                    to[state][word] = copy
                    state = link[state]
                there = copy
            if new is None:
                if document < self.least[there]:
                    self.least[there] = document
                return there
            link[new] = there
        return new

    def owners(self, words: list[int], width: int) -> Iterator[tuple[int, int]]:
        """(first word, smallest document) of every window of the words that stands in the automaton's sequences.

        The words go through once; `matched` is the length of the longest match that ends at a word.
        """
        to, link, length = self.to, self.link, self.length
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in to[state]:
                state = link[state]
                matched = length[state]
            if word in to[state]:
                state = to[state][word]
                matched += 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if matched >= width:
                yield at - width + 1, self.least[state]


def solved(groups: list[tuple], width: int) -> pa.RecordBatch:
    """(c1, c2, low, high, owner) of some passages: runs of windows with one smallest document."""
    known: dict[str, int] = {}
    sequences = [([known.setdefault(w, len(known)) for w in text.split(" ")], document)
                 for _, _, _, document, text in groups]
    automaton = Automaton(sequences)
    rows = []
    for (_, c1, c2, _, _), (words, _) in zip(groups, sequences, strict=True):
        low = high = owner = None
        for at, least in automaton.owners(words, width):
            if owner == least and at == high + 1:
                high = at
                continue
            if owner is not None:
                rows.append((c1, c2, low, high, owner))
            low = high = at
            owner = least
        if owner is not None:
            rows.append((c1, c2, low, high, owner))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=OWNED)


OWNED = ["c1", "c2", "low", "high", "owner"]


def owned(pieces: DataFrame, width: int, blocks: tuple[int, ...]) -> DataFrame:
    """(c1, c2, low, high, owner) for different passages (key, c1, c2, doc_id, text): who has their windows first.

    Equal windows have equal keys, so the passages of a key are looked through together, many keys in one automaton.
    Where a key has more than SHARD_WORDS words of passages, as at the edges of a passage in very many documents, these are cut
    into blocks with longer shared words as their keys, equal ones taken together; a block of one window is one passage.
    """
    counted = pieces.withColumn("n", F.size(F.split("text", " ")))
    hot = written(
        counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_WORDS).select("key"), "dedup-hot")
    cool = pieces
    parts = []
    if blocks:
        cool = pieces.join(hot, "key", "left_anti")
        cut = written(
            passages(pieces.join(hot, "key", "left_semi").select(
                F.col("c1").alias("of1"), F.col("c2").alias("of2"), "doc_id", "text"), width, blocks[0]), "dedup-blocks")
        whole = cut.groupBy("key", "c1", "c2").agg(F.min(F.struct("doc_id", "of1", "of2", "s", "e")).alias("one"))
        texts = pieces.withColumnsRenamed({"c1": "of1", "c2": "of2"}).join(
            whole.groupBy("one.of1", "one.of2").agg(
                F.collect_list(F.struct("one.s", "one.e", "key", "c1", "c2", "one.doc_id")).alias("wanted")), ["of1", "of2"])
        smaller = written(bodies(texts, "wanted", ["s", "e", "key", "c1", "c2", "doc_id"], width).drop("s", "e"), "dedup-pieces")
        below = written(owned(smaller, width, blocks[1:]), "dedup-owned")
        parts.append(cut.select("of1", "of2", "s", "c1", "c2").join(below, ["c1", "c2"]).select(
            F.col("of1").alias("c1"), F.col("of2").alias("c2"), (F.col("s") + F.col("low")).alias("low"),
            (F.col("s") + F.col("high")).alias("high"), "owner"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield solved(held, width)
                    held, words = [], 0
                held.append(row)
                words += row[4].count(" ") + 1
        if held:
            yield solved(held, width)

    dealt = cool.repartition("key").sortWithinPartitions("key").select("key", "c1", "c2", "doc_id", "text")
    out = dealt.mapInArrow(work, ", ".join(f"{c} long" for c in OWNED))
    for part in parts:
        out = out.unionByName(part)
    return out


def repeated_spans(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, spans): from which word to before which stand windows that a smaller doc_id has too."""
    found = written(passages(_rows(documents).where("doc_id IS NOT NULL"), width), "dedup-runs")
    several = written(
        found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"),
        "dedup-keys")
    shared = written(found.join(several, "key"), "dedup-shared")
    contents = shared.groupBy("key", "c1", "c2").agg(F.min(F.struct("doc_id", "text_key", "s", "e")).alias("one"))
    wanted = contents.groupBy(F.col("one.doc_id").alias("_doc"), F.col("one.text_key").alias("_key")).agg(
        F.collect_list(F.struct("one.s", "one.e", "key", "c1", "c2", "one.doc_id")).alias("wanted"))
    rows = _rows(documents).dropna(subset=["doc_id"])
    texts = rows.join(wanted, (rows["doc_id"] == F.col("_doc")) & (rows["text_key"] == F.col("_key")))
    pieces = written(
        bodies(texts, "wanted", ["s", "e", "key", "c1", "c2", "doc_id"], width).drop("s", "e")
        .dropDuplicates(["key", "c1", "c2"]), "dedup-passages")
    owners = written(owned(pieces, width, BLOCKS), "dedup-owners")
    return (
        shared.select("doc_id", "text_key", "s", "c1", "c2").join(owners, ["c1", "c2"]).where("owner < doc_id")
        .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(
            (F.col("s") + F.col("low")).alias("s"), (F.col("s") + F.col("high") + width).alias("end"))).alias("spans")))


def without_repeated_passages(documents: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for every row.

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id; windows are
    those of the input. `kept` is what is left, joined by blanks. Null is the empty text; texts of fewer words stay
    whole. Rows of one doc_id do not take from each other, repeated rows lose the same; a row with a null
    doc_id is neither smaller nor greater than others, so it loses and takes nothing. Other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                kept, done = [], 0
                for s, e in sorted((x["s"], x["end"]) for x in spans.as_py() or ()):
                    kept += words[done:max(s, done)]
                    done = max(done, e)
                kept += words[done:]
                joined = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    spans = repeated_spans(documents, width).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = _rows(documents)
    joined = rows.join(spans, (rows["doc_id"] == F.col("_doc")) & (rows["text_key"] == F.col("_key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
