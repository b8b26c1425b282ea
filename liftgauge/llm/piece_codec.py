"""Exact SentencePiece BPE encoding by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: No piece of the vocabulary has a blank after another character, so no merge crosses these cuts.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED_CHUNK = 64
CACHE_ENTRIES = 1 << 18


def _keep(cache: dict[str, tuple[int, ...]], text: str, ids: tuple[int, ...]) -> None:
    """Remember the ids of a short text; a full cache starts over."""
    if len(text) <= CACHED_CHUNK:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[text] = ids


class PieceCodec:
    """Encodes with the vocabulary of a model file.

    At every place the longest piece is tried first; it stays if it is compatible with the piece before, that is
    if merging the text of both gives just these two. Else the next shorter piece is tried; where none is left,
    the place is marked as failed and the piece before is tried shorter. A place fails once, so the
    work is linear in the text.
    """

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.vocab_size()
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        plain = [i for i in range(n) if not (
            lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in plain}
        self.id = {piece: i for i, piece in self.piece.items()}
        self.score = {piece: lib.get_score(i) for i, piece in self.piece.items()}
        self.single = {c for piece in self.id for c in piece}
        self.beside = {piece[k:k + 2] for piece in self.id for k in range(len(piece) - 1)}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id) or self.single - self.id.keys():
            raise ValueError("a vocabulary with pieces over several words, or characters without a piece, is not read")
        self.words = ahocorasick.Automaton()
        for piece in self.id:
            self.words.add_word(piece, len(piece))
        self.words.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in self.id}
        self.written = list(map(str, range(n)))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._parts: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the adjacent pair with the best piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score[both], -i) for i in range(len(parts) - 1) if (both := parts[i] + parts[i + 1]) in self.id),
                default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self._pairs:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            self._pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return self._pairs[key]

    def pieces(self, run: str) -> list[str]:
        """The pieces of a run of characters that all have pieces."""
        longest = [1] * len(run)
        for end, size in self.words.iter(run):
            start = end - size + 1
            longest[start] = max(longest[start], size)
        failed = bytearray(len(run) // 8 + 1)
        out: list[str] = []
        at, piece = 0, run[:longest[0]]
        while True:
            before = out[-1] if out else ""
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(before, piece):
                out.append(piece)
                if end == len(run):
                    return out
                at, piece = end, run[end:end + longest[end]]
            elif (shorter := self.shorter[piece]) is not None:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # the place 0 never fails: plain merging is one way through
                at -= len(piece)
                # The same piece ends at the failed place, so the next round shortens it.

    def _encoded(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk, cut between any two characters that no piece has side by side: no merge crosses there."""
        ids: list[int] = []
        start = 0
        for i in range(1, len(chunk) + 1):
            if chunk[i - 1:i + 1] in self.beside and i < len(chunk):
                continue
            part, start = chunk[start:i], i
            known = self._parts.get(part)
            if known is None:
                # A character without a piece stands beside no other, so it is a part of its own.
                known = tuple(map(self.id.__getitem__, self.pieces(part))) if part[0] in self.single else tuple(
                    map(self.bytes.__getitem__, part.encode()))
                _keep(self._parts, part, known)
            ids += known
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, without begin or end; none for an empty text."""
        if not text:
            return []
        ids: list[int] = []
        for chunk in _CHUNK.findall(SPACE + text.replace(" ", SPACE)):
            known = self._chunks.get(chunk)
            if known is None:
                known = self._encoded(chunk)
                _keep(self._chunks, chunk, known)
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """One codec for each Python worker."""
    return PieceCodec(model)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(documents: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded, for every row.

    Null is taken as the empty text, which has no ids and decodes to the empty text. Every row is encoded by
    itself: repeated rows and null ids keep their rows. No shuffle.
    """
    path = str(model or public_model())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text in batch.column("text"):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                row = (len(ids), hashlib.sha256(",".join(map(coder.written.__getitem__, ids)).encode()).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest(), ids if keep_ids else None, decoded if keep_ids else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                      pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, schema)
