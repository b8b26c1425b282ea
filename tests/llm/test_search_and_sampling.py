"""Ranked search, substring dedup and resampling against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from liftgauge.llm import ranked_search, resampling, substring_dedup
from liftgauge.llm.oracle import ORACLE_SQL

rnd = random.Random(11)
VOCABULARY = [a + b for a in ("ba", "Re", "É", "tho", "x1", "zu") for b in ("n", "st", "lo", "é", "li", "", "mm", "k9")]
SCHEMA = "doc_id long, text string, lang string, found string, score long, rank string, h long, key string, s long, wanted string"
FIND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def sentence(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


BASE = [sentence(130) for _ in range(4)]
TEXTS = [None, "", " \n\t", "one", "!!", "same " * 700, "a b " * 400, *BASE, *BASE[:2], BASE[0].upper(), sentence(40_000)]
for _ in range(60):
    TEXTS.append(f"{sentence(rnd.randint(0, 30))}\n{' '.join(rnd.choice(BASE).split()[rnd.randint(0, 40):rnd.randint(60, 130)])}, {sentence(20)}\t{rnd.choice(BASE)}")
TEXTS += [" ".join([*BASE[2].split()[:100], rnd.choice(VOCABULARY), *BASE[2].split()[rnd.randint(98, 104):]]) for _ in range(12)]
ROWS = [(None if i % 17 == 9 else i - 20, t, "en", "f", 1, "r", 2, "k", 3, "w") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[8], ROWS[8], ROWS[30], (-12, sentence(70), *ROWS[0][2:]), (None, BASE[0], *ROWS[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def plainly_ranked(rows, items, top):
    terms = [(doc, FIND(lower(text))) for doc, text in rows]
    size, words = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    out = {}
    for item, texts in items.items():
        asked = [t for text in texts for t in FIND(lower(text))]
        scores = []
        for doc, w in terms:
            tf, m = Counter(w), 100 - 75 + 75 * len(w) * size // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in asked if tf[t])
            if score:
                scores.append((-score, doc is not None, doc or 0))
        if scores:
            out[item] = [(doc if known else None, -low) for low, known, doc in sorted(scores)[:top]]
    return out


ITEMS = [(1, BASE[0][:300]), (2, "one"), (3, None), (4, "!! --"), (5, sentence(12)), (6, "ban rest ban nowhere"), (1, BASE[0][:300]),
         (1, "x1lo x1lo"), (None, sentence(30)), *((10 + i, sentence(rnd.randint(1, 60))) for i in range(25))]


def test_ranked_search(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame([(*x, "e") for x in ITEMS], "item_id long, text string, rank string")
    by_item = defaultdict(set)
    for item, text in ITEMS:
        by_item[item].add(text or "")
    want = plainly_ranked([r[:2] for r in ROWS], by_item, 10)
    for terms_at_once in (1 << 18, 400):
        monkeypatch.setattr(ranked_search, "QUERY_TERMS", terms_at_once)
        rows = ranked_search.ranked(docs, items).collect()
        got = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["rank"]):
            got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert got == want and all([r["rank"] for r in rows if r["item_id"] == i] == [] or sorted(
            r["rank"] for r in rows if r["item_id"] == i) == list(range(1, len(want[i]) + 1)) for i in want)
    assert ranked_search.ranked(empty, items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def a_shard(documents):
    import pyarrow as pa

    hashes, docs, tfs = (np.array(x) for x in zip(*((t, d, n) for d, doc in enumerate(documents) for t, n in doc.items()), strict=True))
    lengths = np.array([sum(d.values()) for d in documents])
    row = ranked_search.packed(hashes.astype(np.uint64), docs, tfs, np.arange(len(documents)) * 3 - 5, lengths)
    batch = pa.RecordBatch.from_pydict({name: pa.array([value]) for name, value in row.items()})
    return ranked_search.Shard(
        {name: ranked_search.unpacked(batch, name, 0) for name in ranked_search.ARRAYS}, (len(documents), int(lengths.sum())))


def test_bounds_reject_blocks_unopened_and_lose_nothing():
    documents = [{1: rnd.choice([1, 1, 1, 300, 70_000]), **{t: rnd.randint(1, 3) for t in range(2, 30) if rnd.random() < 0.6}}
                 for _ in range(20_000)]
    for d in [*range(0, 400, 20), 9_000, 17_000]:
        documents[d][40] = 1
    shard = a_shard(documents)
    everything = np.arange(len(shard.blocks))
    of, docs, gain = shard.open(everything)
    term = shard.owner[of]
    for terms in ([1], [1, 5], [2, 3, 4, 9], list(range(1, 25)), [77], [3, 77], [2, 40]):
        weights = np.array([1, 6000] if 40 in terms else [rnd.choice([1, 10, 400, 6000]) for _ in terms])
        total = np.zeros(len(documents), np.int64)
        for t, w in zip(terms, weights, strict=True):
            if t != 77:
                here = shard.terms[term] == t
                total[docs[here]] += w * gain[here]
        want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s)[:10]
        shard.opened = 0
        found, scores = shard.best(np.array(terms, np.uint64), weights, 10)
        assert [(-s, d) for d, s in zip(found.tolist(), scores.tolist(), strict=True)] == want
        if 40 in terms:
            lists = shard.owner[np.isin(shard.terms[shard.owner], terms)]
            assert 0 < shard.opened < len(lists) / 5


def plainly_deduplicated(rows, width):
    least = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - width + 1):
            if doc is not None:
                key = tuple(w[i:i + width])
                least[key] = min(least.get(key, doc), doc)
    out = Counter()
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = {i + j for i in range(len(w) - width + 1) if doc is not None and least[tuple(w[i:i + width])] < doc for j in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


@pytest.mark.parametrize("shard_words", [1 << 16, 400])
def test_substring_dedup(docs, empty, monkeypatch, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    got = Counter(tuple(r) for r in substring_dedup.without_repeated_passages(docs).collect())
    assert got == plainly_deduplicated([r[:2] for r in ROWS], 50)
    assert substring_dedup.without_repeated_passages(empty).count() == 0


def test_substring_dedup_of_a_passage_in_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2000)
    passage = sentence(70)
    rows = [(i, f"{sentence(12)} u{i} {'l ' * (i % 5)}{passage} {'r ' * (i % 3)}v{i} {sentence(12)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in substring_dedup.without_repeated_passages(df).collect())
    assert got == plainly_deduplicated(rows, 50)
    small = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "x b c y", "b c", "b c d", "a"])], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring_dedup.without_repeated_passages(small, width=2).collect()}
    assert got == {0: "a b c d", 1: "x y", 2: "", 3: "", 4: "a"}


def test_automaton_finds_the_first_owner():
    for _ in range(300):
        sequences = [([rnd.randint(0, 2) for _ in range(rnd.randint(0, 25))], rnd.randint(0, 6)) for _ in range(rnd.randint(1, 6))]
        automaton = substring_dedup.Automaton(sequences)
        width = rnd.randint(1, 5)
        least = {}
        for words, doc in sequences:
            for i in range(len(words) - width + 1):
                key = tuple(words[i:i + width])
                least[key] = min(least.get(key, doc), doc)
        asked = [rnd.randint(0, 3) for _ in range(60)]
        assert list(automaton.owners(asked, width)) == [
            (i, least[tuple(asked[i:i + width])]) for i in range(len(asked) - width + 1) if tuple(asked[i:i + width]) in least]


def test_long_texts_do_not_stall(spark):
    texts = ["y" * 3_000_000, "w " * 400_000, " " * 2_000_000, sentence(150_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    assert [r.n_removed for r in substring_dedup.without_repeated_passages(df).orderBy("doc_id").collect()] == [0] * 4
    items = spark.createDataFrame([(1, texts[3][:200] + " w")], "item_id long, text string")
    assert {r.doc_id for r in ranked_search.ranked(df, items).collect()} == {1, 3}
    assert [r.n_features for r in resampling.resampled(df, items).orderBy("doc_id").collect()][:3] == [1, 400_000, 0]
    assert time.monotonic() - began < 120


def plainly_resampled(rows, target, percent, least_words, longest, buckets, seed):
    def features(text):
        w = FIND(lower(text))
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)

    own = [(doc, *features(text)) for doc, text in rows]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for text in target for b in features(text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc, f, words in own:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, row in enumerate(able[:percent * len(able) // 100]):
        row[5] = place + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("longest", "piece"), [(1, 1 << 20), (3, 1 << 20), (3, 64)])
def test_resampling(spark, docs, empty, monkeypatch, longest, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    texts = [BASE[0], None, "", sentence(30)]
    target = spark.createDataFrame([(t, "x") for t in texts], "text string, found string")
    got = Counter(tuple(r) for r in resampling.resampled(docs, target, percent=37, longest=longest, buckets=500).collect())
    assert got == plainly_resampled([r[:2] for r in ROWS], texts, 37, 20, longest, 500, 2024)
    assert resampling.resampled(empty, target).count() == 0
    assert resampling.resampled(docs, target.limit(0)).count() == len(ROWS)
    want = [(len(f), sorted(f)) for f in ([zlib.crc32(" ".join(w[i:i + k]).encode()) % 500 for k in range(1, longest + 1)
                                          for i in range(len(w) - k + 1)] for w in (FIND(lower(t)) for t in TEXTS[:30]))]
    assert [(len(f), sorted(f.tolist())) for _, f in resampling.features(TEXTS[:30], 500, longest)] == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = __spark_entry__.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == order(
        want.select(*(duckdb.ColumnExpression(c) for c in sorted(want.columns))).fetchall())
