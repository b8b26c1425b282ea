"""Personal data: fixed patterns, and spans added by a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TOKEN = re.compile(r"\S+")
#: Tokens of a line that are scored at once.
CHAIN_TOKENS = 4096
BATCH_CELLS = 1 << 16
SHAPES_CACHED = 1 << 18

#: The labelled table: text with [kind ...] around personal data.
LABELLED = (
    "please write to [email anna.berg@mail.example.org] about the plan",
    "contact [email j.doe at example dot com] or call the office",
    "mail [email sam at mail dot example dot org] today",
    "the address [email info@site.example] is read every day",
    "the server [ip 10.20.30.40] was down for an hour",
    "from [ip 192.168.1.20] and [ip 172.16.5.9] came the requests",
    "card [card 4111 1111 1111 1111] was charged twice",
    "pay with [card 5500000000000004] before noon",
    "number [card 4012-8888-8888-1881] has expired",
    "call [phone +1 (212) 555-0100] after lunch",
    "ring [phone +44 20 7946 0958] or write a letter",
    "tel [phone (212) 555-0199] for the front desk",
    "phone [phone 555-867-5309] is not in use",
    "the year 1999 and the year 2024 were wet",
    "there were 12 apples, 350 pears and 1,200 plums",
    "version 2.0 of the text came out in 2012",
    "Chapter 3 begins on page 45.",
    "We met at noon. The weather was fine!",
    "Licensed under the Apache License, Version 2.0.",
    "THE END!! OF!! THE!! LINE!!",
    "a dot com firm at the edge of the town",
    "look at the dot on the map",
    "| one | two | three |",
    "le prix est de 300 euros par mois",
    "der Zug um 17:45 kam zu spät",
    "la casa está en el número 25",
    "it costs $300 & more, up 5% at 10:30",
    "see items 1-5 and 10-12 of part 7",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns that pass their checks; a failing match is dropped and not tried again."""
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _emails(text)]
    found += [("ip", start, end) for start, end in _ips(text)]
    for m in PATTERNS["card"].finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PATTERNS["phone"].finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern: of each chain of numbers with single dots between, every four in turn."""
    for chain in _DOTTED.finditer(text):
        runs = list(_DIGITS.finditer(text, chain.start(), chain.end()))
        for first in range(0, len(runs) - 3, 4):
            if all(_byte(run.group()) for run in runs[first:first + 4]):
                yield runs[first].start(), runs[first + 3].end()


# Possessive, so that a run of digits is gone through once.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")


def _byte(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches, looked for from each `@`: its local part is the whole run of allowed characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _ALLOWED:
            start -= 1
        match = PATTERNS["email"].match(text, start) if start < at else None
        if match:
            yield match
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


_ALLOWED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TAGS = ("O", *(f"{p}-{kind}" for kind in KINDS for p in "BI"))


def shape(token: str) -> str:
    """Letters as x or X, digits as 9, other signs as they are; runs are cut after four."""
    out = "".join("9" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)


def token_features(token: str) -> list[str]:
    s = shape(token)
    digits = sum(c in "0123456789" for c in token)
    core = token.strip(".,;:!?()[]\"'#*$%&|<>").lower()
    return [
        f"shape={re.sub(r'(.)\1+', r'\1', s)}", f"digits={min(digits, 4) if digits < 14 else 14}",
        f"at={'@' in token}", f"plus={token[:1] == '+'}", f"dots={min(token.count('.'), 3)}",
        f"dashes={min(token.count('-'), 2)}",
        f"word={core}" if core in ("at", "dot", "call", "mail", "phone", "tel", "card", "com") else "word=",
        f"plain={core.isalpha()}",
    ]


class Field:
    """Weights of a linear chain: of tag and feature for the token and its neighbours, and of adjacent tags."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self._known: dict[str, np.ndarray] = {}

    def parts(self, token: str) -> np.ndarray:
        """What a token adds to its neighbour on the left, to itself, and to its neighbour on the right."""
        known = self._known.get(token)
        if known is None:
            rows = [[self.names[f"{at}:{f}"] for f in token_features(token) if f"{at}:{f}" in self.names] for at in (1, 0, -1)]
            known = np.stack([self.emit[r].sum(axis=0) for r in rows])
            if len(self._known) >= SHAPES_CACHED:
                self._known.clear()
            self._known[token] = known
        return known

    def scores(self, tokens: list[str]) -> np.ndarray:
        parts = np.stack([self.parts(t) for t in tokens])
        out = parts[:, 1].copy()
        out[:-1] += parts[1:, 0]
        out[1:] += parts[:-1, 2]
        return out

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many chains at once, those of like length together."""
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        first = 0
        while first < len(order):
            last, width = first, 0
            while last < len(order) and (last - first + 1) * len(chains[order[last]]) <= max(BATCH_CELLS, width):
                width = max(width, len(chains[order[last]]))
                last += 1
            last = max(last, first + 1)
            some = order[first:last]
            for i, tags in zip(some, self._viterbi([chains[i] for i in some]), strict=True):
                out[i] = tags
            first = last
        return out

    def _viterbi(self, chains: list[np.ndarray]) -> Iterator[np.ndarray]:
        lengths = np.array([len(c) for c in chains])
        width, tags = lengths.max(), len(TAGS)
        padded = np.zeros((len(chains), width, tags), np.float32)
        for row, c in zip(padded, chains, strict=True):
            row[:len(c)] = c
        back = np.zeros((len(chains), width, tags), np.int8)
        best, final = padded[:, 0], np.zeros((len(chains), tags), np.float32)
        final[lengths == 1] = best[lengths == 1]
        for t in range(1, width):
            ways = best[:, :, None] + self.move
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + padded[:, t]
            final[lengths == t + 1] = best[lengths == t + 1]
        path = np.zeros((len(chains), width), np.int8)
        now, rows = final.argmax(axis=1), np.arange(len(chains))
        for t in range(width - 1, -1, -1):
            inside = t < lengths
            path[inside, t] = now[inside]
            now = np.where(inside & (t > 0), back[rows, t, now], now)
        for row, n in zip(path, lengths, strict=True):
            yield row[:n]


def labelled_tokens(line: str) -> tuple[list[str], list[int]]:
    tokens, tags, kind, fresh = [], [], None, False
    for token in line.split():
        if token[0] == "[" and token[1:] in KINDS:
            kind, fresh = token[1:], True
            continue
        ends = token.endswith("]") and kind is not None
        tokens.append(token[:-1] if ends else token)
        tags.append(TAGS.index(f"{'B' if fresh else 'I'}-{kind}") if kind else 0)
        fresh = False
        kind = None if ends else kind
    return tokens, tags


@lru_cache(maxsize=1)
def trained(rounds: int = 150, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Fit to LABELLED by gradient ascent of the penalised likelihood; the same weights each time."""
    data = [labelled_tokens(line) for line in LABELLED]
    names: dict[str, int] = {}
    rows = []
    for tokens, _ in data:
        features = [token_features(t) for t in tokens]
        rows.append([[names.setdefault(f"{at}:{f}", len(names)) for at in (-1, 0, 1) if 0 <= i + at < len(tokens)
                      for f in features[i + at]] for i in range(len(tokens))])
    # Names carry the place of the token seen from the tagged one.
    emit, move = np.zeros((len(names), len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    squares = [np.full_like(emit, 1e-8), np.full_like(move, 1e-8)]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        g_emit, g_move = -ridge * emit, -ridge * move
        for (_, tags), features in zip(data, rows, strict=True):
            score, n = np.stack([emit[r].sum(axis=0) for r in features]), len(tags)
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = score[0]
            for t in range(1, n):
                ahead[t] = score[t] + soft(ahead[t - 1][:, None] + move, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = soft(move + score[t + 1] + behind[t + 1], 1)
            total = soft(ahead[-1], 0)
            chance = np.exp(ahead + behind - total)
            for t in range(n):
                off = -chance[t]
                off[tags[t]] += 1
                np.add.at(g_emit, features[t], off)
                if t:
                    g_move -= np.exp(ahead[t - 1][:, None] + move + score[t] + behind[t] - total)
                    g_move[tags[t - 1], tags[t]] += 1
        for weights, gradient, square in ((emit, g_emit, squares[0]), (move, g_move, squares[1])):
            square += gradient**2
            weights += rate * gradient / np.sqrt(square)
    return Field(names, emit.astype(np.float32), move.astype(np.float32))


def lines(text: str) -> Iterator[re.Match]:
    return re.finditer(r"[^\n]+", text)


def long_chain(field: Field, text: str, line: re.Match) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and tags of all tokens of a line of any length, as one chain.

    Scores are made for CHAIN_TOKENS at a time and the best way to each tag is carried on, so only a byte for each token and
    tag is held for the way back. A tag sees all of the line, as in a short one.
    """
    bounds, backs, best = [], [], None
    tokens = TOKEN.finditer(text, line.start(), line.end())
    before, now = None, [m for _, m in zip(range(CHAIN_TOKENS), tokens)]
    while now:
        after = [m for _, m in zip(range(CHAIN_TOKENS), tokens)]
        context = ([before] if before else []) + now + after[:1]
        begin = 1 if before else 0
        scores = field.scores([m.group() for m in context])[begin:begin + len(now)]
        back = np.zeros((len(now), len(TAGS)), np.int8)
        for t, score in enumerate(scores):
            if best is None:
                best = score.astype(np.float64)
            else:
                ways = best[:, None] + field.move
                back[t] = ways.argmax(axis=0)
                best = ways.max(axis=0) + score
        # Only the differences count.
        best = best - best.max()
        bounds.append(np.array([m.span() for m in now], np.int64))
        backs.append(back)
        before, now = now[-1], after
    places = np.concatenate(bounds)
    tags = np.zeros(len(places), np.int8)
    tag, at = int(best.argmax()), len(places)
    for back in reversed(backs):
        for row in back[::-1]:
            at -= 1
            tags[at] = tag
            tag = int(row[tag])
    return places[:, 0], places[:, 1], tags


def believable(kind: str, body: str) -> bool:
    """The checks of the base, which an added span has to pass too; emails may be spelled out."""
    if kind == "email":
        return "@" in body or spelled_out(body)
    if kind == "ip":
        parts = body.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", body)
    if re.search(r"[^0-9 ().+-]", body):
        return False
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def spelled_out(line: str) -> bool:
    """Whether the word `at` stands before the word `dot`, with something between."""
    first = re.search(r"\bat\b", line)
    return first is not None and _DOT.search(line, first.end() + 1) is not None


_DOT = re.compile(r"\bdot\b")


def may_hold(line: str) -> bool:
    """False where no span could pass `believable`, so that decoding the line could add nothing."""
    return "@" in line or len(re.findall("[0-9]", line)) >= 4 or spelled_out(line)


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field tags in every text; signs around a span are left out of it."""
    where, scores, out = [], [], [[] for _ in texts]

    def flush() -> None:
        for (n, starts, ends), tags in zip(where, field.decode(scores), strict=True):
            if tags.any():
                out[n] += _spans(texts[n], starts, ends, tags)
        where.clear()
        scores.clear()

    held = 0
    for n, text in enumerate(texts):
        for line in lines(text):
            if not may_hold(line.group()):
                continue
            tokens = [m for _, m in zip(range(CHAIN_TOKENS + 1), TOKEN.finditer(text, line.start(), line.end()))]
            if len(tokens) > CHAIN_TOKENS:
                out[n] += _spans(text, *long_chain(field, text, line))
            elif tokens:
                where.append((n, [m.start() for m in tokens], [m.end() for m in tokens]))
                scores.append(field.scores([m.group() for m in tokens]))
                held += len(tokens)
                if held >= BATCH_CELLS:
                    flush()
                    held = 0
    flush()
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def _spans(text: str, starts: Sequence[int], ends: Sequence[int], tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Believable spans of tagged tokens."""
    for at in _begins(tags):
        kind = TAGS[tags[at]][2:]
        last = at
        while last + 1 < len(tags) and TAGS[tags[last + 1]] == f"I-{kind}":
            last += 1
        start, end = int(starts[at]), int(ends[last])
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if believable(kind, text[start:end]):
            yield kind, start, end


def _begins(tags: np.ndarray) -> list[int]:
    """Places of tagged tokens at which no span goes on."""
    out, inside, previous = [], "", -2
    for at in np.flatnonzero(tags).tolist():
        name = TAGS[tags[at]]
        goes_on = name[0] == "I" and name[2:] == inside and at - 1 == previous
        if not goes_on:
            out.append(at)
        inside, previous = name[2:], at
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def with_added(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans all stay; an added one counts where it meets no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, int)
    out = list(base)
    for span in added:
        before = int(np.searchsorted(starts, span[2]))  # base spans that begin before the end
        if not before or ends[before - 1] <= span[1]:
            out.append(span)
    return out


def find_spans(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with `carry` only `_row` and `masked`.

    Counts are of base spans. Null is the empty text. Rows are worked on by themselves, without a shuffle:
    repeated rows and null ids keep their rows. The weights are a few kilobytes, whatever the data.
    """
    context = documents.sparkSession.sparkContext
    weights = trained()
    sent = context.broadcast((weights.names, weights.emit, weights.move))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                texts = [x.as_py() or "" for x in batch.column("text")]
                base = [base_spans(t) for t in texts]
                spans = [with_added(*x) for x in zip(base, field_spans(field, texts), strict=True)]
                if carry:
                    values = [None if not x.is_valid else mask(t, s)
                              for x, t, s in zip(batch.column("text"), texts, spans, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_row"), pa.array(values, pa.string())], names=["_row", "masked"])
                    continue
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                     pa.array([joined(s) for s in spans], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    text = F.col("text").cast("string").alias("text")
    if carry:
        rows = documents.select(F.struct("*").dropFields("text").alias("_row"), text)
        return rows.mapInArrow(work, f"_row {rows.schema['_row'].dataType.simpleString()}, masked string")
    rows = documents.select(F.col("doc_id").cast("long"), text)
    return rows.mapInArrow(
        work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that meet are replaced together."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def masked(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked in `text`; n_chars, where there, follows the new text."""
    found = find_spans(documents, carry=True)
    columns = [F.col("masked").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns]
    out = found.select(*columns)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
