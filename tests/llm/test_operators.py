"""Every operator against a plain brute-force version, with nulls, empty and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from plain import kept_by_exact_quantiles
from liftgauge.llm import decontamination, licences, pii, piece_codec, quality, repeats, sharding, simhash, url_filter, warc
from liftgauge.llm.lyndon_suffixes import suffix_array

rnd = random.Random(7)
WORDS = [a + b for a in ("ba", "re", "É", "Tho", "x") for b in ("n", "st", "1", "é", "li")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, kept string"


def sentence(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = [sentence(120) for _ in range(5)]
TEXTS = [None, "", " \n\t", "one", "a" * 1200, "ab " * 500, *BASE, *BASE[:2], BASE[0].upper()]
for _ in range(40):
    TEXTS.append(f"{sentence(rnd.randint(0, 30))}\n{rnd.choice(BASE)[:rnd.randint(50, 700)]}\n{sentence(20)} {rnd.choice(BASE)}")
for _ in range(8):
    TEXTS.append(" ".join([*BASE[2].split()[:118], rnd.choice(WORDS)]))
TEXTS += ["write to a.b@c.example.org, call +1 (212) 555-0100 or 212-555-0177\nip 10.0.0.1 and 999.1.1.1 card 4111 1111 1111 1111",
          "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. And more.", "x" * 50_000 + " 1" * 900]
ROWS = [(i, t, rnd.choice(["en", None]), rnd.choice(["a", "a", "a", "b", None, ""]), 1, "r", "k", "z")
        for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_suffix_array():
    for _ in range(500):
        s = [rnd.randint(0, rnd.choice([1, 2, 6])) for _ in range(rnd.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_decontamination(spark, docs, empty):
    items = [(1, BASE[0][:300]), (2, "one"), (3, None), (4, "!!"), (5, sentence(12)), (6, "ban rest x1"), (7, "a" * 1200), (1, BASE[0][:300])]
    found = by_id(decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for item, text in items:
        w = find(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    for doc, text, *_ in ROWS:
        w, hit, names = find(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i:i + n])]
        r = found[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(docs, none).collect())
    assert decontamination.contamination(empty, none).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard_table(docs.union(docs), 24).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    mixed = Counter((r.shard, r.source) for r in rows)
    for source, total in Counter(r.source for r in rows).items():
        assert all(abs(mixed[s, source] - total / 24) <= 2 for s in range(24))
    assert sharding.shard_table(empty).count() == 0


def test_personal_data(docs, empty):
    def plain(text):
        out = []
        for kind, pattern in pii.PATTERNS.items():
            for m in pattern.finditer(text):
                digits = re.sub(r"\D", "", m.group())
                good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                        "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
                out += [(kind, m.start(), m.end())] * good
        return out

    found = by_id(pii.find_spans(docs))
    for doc, text, *_ in ROWS:
        assert found[doc].base_sha256 == hashlib.sha256(pii.joined(plain(text or "")).encode()).hexdigest()
    one = next(r for r in found.values() if r.n_email)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1) and one.spans.count("phone") == 2
    assert pii.masked(docs).columns == docs.columns
    assert not any("4111" in (r.text or "") for r in pii.masked(docs).collect())
    assert pii.find_spans(empty).count() == 0


def test_field_tags_held_out_words():
    field = pii.trained()
    for text, want in (("please call (415) 555-2671 now", 1), ("in 1998 about 3500 people came", 0)):
        assert len(pii.field_spans(field, [text])[0]) == want


def test_urls(spark):
    urls = ["http://A.net/x", "https://www.b.example.net/en/1?q", "http://example.net/de/", "x.net/", None, "", "http://net",
            "http://q.example.com/de/5#t", "http://w.org/fr/", "http://www.pills.example.org/a.html", "http://m.pills.example.org/a/?x",
            "http://badexample.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = by_id(url_filter.judge_urls(pages, url_filter.unwanted_hosts(pages)), "page_id")
    assert [found[i].rule for i in range(12)] == ["net/", "example.net/en/", "net/", None, None, None, None, "example.com/de/",
                                                  "org/fr/", None, None, None]
    assert [i for i in range(12) if found[i].verdict == "block"] == [0, 2, 7, 9, 10]
    assert (found[0].host, found[1].path, found[6].host, found[6].path) == ("a.net", "/en/1", "net", "")
    assert all(r.verdict for r in url_filter.judge_urls(pages, url_filter.unwanted_hosts(pages.limit(0))).collect())


def test_urls_are_listed_one_by_one(spark):
    """One of two pages of a host is listed, whatever the host is called; rules stand above the list."""
    pages = spark.createDataFrame(
        [(i, f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}h{i % 50}.example.com/p{i // 50}{('.html', '', '/', '?q=1')[i % 4]}")
         for i in range(2000)] + [(2000, "http://h1.example.net/p1"), (2001, "http://h2.org/fr/x"), (2002, None)],
        "page_id long, url string")
    wanted = {(h, p) for h in range(50) for p in range(40) if (h * 7 + p) % 2}
    keys = [(f"h{h}.example.com/p{p}",) for h, p in sorted(wanted)] * 2 + [(None,), ("h1.example.net/p1",), ("h2.org/fr/x",)]
    listed = spark.createDataFrame(keys, "key string")
    found = by_id(url_filter.judge_urls(pages, listed), "page_id")
    assert all(found[i].listed == ((i % 50, i // 50) in wanted) and found[i].verdict == ("block" if found[i].listed else "allow")
               for i in range(2000))
    assert [(found[i].listed, found[i].verdict) for i in (2000, 2001, 2002)] == [(True, "block"), (True, "allow"), (False, "allow")]
    hosts = spark.createDataFrame([("http://www.free-bets.example.com/a.html",), ("http://better.example.com/a",), ("casino",), (None,)], "url string")
    assert [r.key for r in url_filter.unwanted_hosts(hosts).collect()] == ["free-bets.example.com/a"]
    assert url_filter.unwanted_hosts(hosts, ()).count() == 0 == url_filter.judge_urls(pages.limit(0), listed).count()


def test_encoding(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=str(piece_codec.public_model()))
    found = by_id(piece_codec.encoded(docs, keep_ids=True))
    for doc, text, *_ in ROWS:
        ids = library.encode(text or "")
        assert (found[doc].ids, found[doc].decoded) == (ids, library.decode(ids))
    coder = piece_codec.codec(str(piece_codec.public_model()))
    pieces = list(coder.id)
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))).replace("▁", rnd.choice(" ▁")) + rnd.choice(["", "\n é😀", "  "])
        assert coder.encode(text) == library.encode(text)


def test_archives(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n", "x" * 70_000, "<p>é</p>"]
    rows = [(i, None if i == 2 else f"http://h{i % 2}.example.org/ü {i % 3}", x) for i, x in enumerate(html)]
    out = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    for r in out:
        payload = (html[r.page_id] or "").encode()
        first = min(i for i, x in enumerate(html) if (x or "") == (html[r.page_id] or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    keys = [(r.url_key, r.captured) for r in out]
    assert len(out) == len(rows) and keys == sorted(keys)


def test_loser_tree():
    for k in range(6):
        lists = [sorted(("u", f"{rnd.randint(0, 9)}", rnd.randint(0, 9)) for _ in range(rnd.randint(0, 8))) for _ in range(k)]
        assert list(warc.loser_tree_merge(lists)) == sorted(x for part in lists for x in part)


def test_repeats(docs, empty):
    raw = [(doc, (text or "").encode()) for doc, text, *_ in ROWS]
    seen = Counter(t[i:i + 400] for _, t in raw for i in range(len(t) - 399))
    found = by_id(repeats.without_repeats(docs))
    for doc, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), len(t) - len(kept), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert repeats.without_repeats(empty).count() == 0


def test_licences(docs, empty):
    found = by_id(licences.scan_licences(docs))
    assert {r.licences for r in found.values()} == {"", "Apache-2.0,MIT"} and len(found) == len(ROWS)
    assert licences.scan_licences(empty).count() == 0


def test_quality(docs, empty):
    found = by_id(quality.quality_table(docs))
    for doc, text, *_ in ROWS:
        w, at = re.findall(r"[^\x20\x09-\x0D]+", text or ""), {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i:i + 5]), []).append(i)
        repeated = {p + j for places in at.values() if len(places) > 1 for p in places for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_table(empty).count() == 0


def test_near_copies(docs, empty):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {doc: plain(text) for doc, text, *_ in ROWS}
    root = {doc: doc for doc in prints}
    for _ in prints:
        for a in prints:
            root[a] = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
    for doc, r in by_id(simhash.near_copies(docs)).items():
        assert (r.fingerprint, r.component_id) == (f"{prints[doc]:016x}", root[doc])
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == set(root.values())
    assert simhash.near_copies(empty).count() == 0


def test_index_finds_every_near_pair():
    base = np.array([rnd.getrandbits(64) for _ in range(60)], np.uint64)
    bits = [np.uint64(1) << np.uint64(b) for b in range(64)]
    prints = np.unique(np.array([rnd.choice(base) ^ rnd.choice(bits) ^ rnd.choice(bits) for _ in range(500)], np.uint64))
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(prints, 2) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert got == want
    masks = simhash.route_masks(2)
    assert all(any(not (int(prints[i]) ^ int(prints[j])) & m for m in masks) for i, j in want)


def test_registered_and_pipeline(spark):
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_quality_limits_follow_the_data(spark):
    folder = "/root/testdata/sf0.01"
    labels, documents = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("labels", "documents"))
    measured = quality.quality_table(documents).join(labels, "doc_id", "left").where("NOT base_failed").collect()
    clean = [r.kept for r in measured if r.quality == 1 and r.toxic == 0]
    tables = [r.kept for r in measured if 0.05 < r.n_symbols / r.word_chars < 0.15 and r.n_symbols > 2]
    assert len(clean) > 200 and sum(clean) >= 0.995 * len(clean)
    assert len(tables) > 20 and sum(tables) <= 0.05 * len(tables)
    # A source in which signs are usual keeps them.
    usual = [(i, " ".join(["cost", f"${i}", *sentence(20 + i % 30).split()[i % 9:]]) + " $" * (i % 4), "en", "s") for i in range(400)]
    kept = by_id(quality.quality_table(spark.createDataFrame(usual, "doc_id long, text string, lang string, source string")))
    assert sum(r.kept for r in kept.values()) > 390


def test_quality_limits_against_exact_quantiles(spark):
    """`kept` of texts judged by limits from exact quantiles; sketches are exact up to their accuracy's rows."""
    rows = []
    for i in range(900):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["a"] * 6 + ["b", "", None])
        body = " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "#", "x" * rnd.randint(0, 12)]) for _ in range(rnd.randint(8, 60)))
        rows.append((i, body + rnd.choice(["", "\nsame line", "\nsame line\nsame line\nsame line"]) + " |" * rnd.choice([0, 0, 1, 9]), lang, source))
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, "w " * 9, "xx", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    table = {r.doc_id: r for r in quality.with_measures(df).collect()}
    found = by_id(quality.quality_table(df))
    want = kept_by_exact_quantiles(table)
    assert {i: r.kept for i, r in found.items()} == want
    assert 50 < sum(not k for k in want.values()) < 600


def test_rows_without_an_id(spark):
    schema = "doc_id long, text string"
    near = " ".join(BASE[1].split()[::-1])
    items = spark.createDataFrame([(1, BASE[0])], "item_id long, text string")
    rows = [(None, BASE[0]), (None, BASE[0]), (None, near), (None, near), (7, near + " "), (None, BASE[3]), (None, BASE[3] + "\n"), (8, BASE[4])]
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = [r for r in decontamination.contamination(df, items).collect() if r.contaminated]
    assert [(r.doc_id, r.n_hit, r.n_items) for r in found] == [(None, 120, 1)] * 2
    left = decontamination.without_contaminated(df, items).collect()
    assert Counter(r.text for r in left) == Counter(t for _, t in rows if t != BASE[0])
    firsts = simhash.first_of_each(df).collect()
    assert sorted((r.doc_id or 0, r.text.split()) for r in firsts) == sorted(
        [(0, BASE[0].split()), (7, near.split()), (0, BASE[3].split()), (8, BASE[4].split())])


def test_licences_as_they_are_found(spark):
    mit, bsd, gpl = (licences.SENTENCES[i] for i in (13, 14, 12))
    wrap = lambda text, head="": "\n".join(head + line for line in textwrap.wrap(text, 60))
    cases = {
        "Copyright (c) 2020 A. B.\n" + wrap(mit) + "\n\nThe above copyright notice": "MIT",
        mit + " The above": "MIT",
        wrap(bsd, " * ") + "\n * 1. Redistributions of": "BSD",
        bsd + " 1. Redistributions": "BSD",
        wrap(gpl, "# "): "GPL-3.0-or-later",
        gpl + " This program is": "GPL-3.0-or-later",
        "Some words. " + wrap('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                              "in compliance with the License.", "// "): "Apache-2.0",
        "#" * 900 + " Released under the MIT License. " + "#" * 900: "MIT",
        "This is not " + mit: "",
        f"{licences.SENTENCES[5]}\n{licences.SENTENCES[6]}": "GPL-3.0-or-later",
        f"{licences.SENTENCES[5]}\nSome words. {licences.SENTENCES[3]}\n{licences.SENTENCES[6]}": "GPL-3.0-or-later,MIT",
        f"{licences.SENTENCES[5]}\nA b.\n{licences.SENTENCES[5]}\n{licences.SENTENCES[6]}": "GPL-3.0-only,GPL-3.0-or-later",
        licences.SENTENCES[5]: "GPL-3.0-only",
        "This work is licensed under the GNU General Public License, version 3 or 4.": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = by_id(licences.scan_licences(df))
    assert [found[i].licences for i in range(len(cases))] == list(cases.values())


def licences_by_brute_force(text, sentences, rules):
    """Every wording compared with the words from every edge on; rules by loops over the identifiers."""
    plain = re.sub(r"\n|[;:!?.](?=\s|$)", "\x01", (text or "").replace("\x01", " ").lower())
    plain = re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", plain)
    words, edges = [], set()
    for part in plain.split("\x01"):
        edges.add(len(words))
        words += re.findall(r"(?:[^\W_]|\.)+", part)
    edges.add(len(words))
    spans = set()
    for i, wording in sentences.items():
        norm = re.findall(r"(?:[^\W_]|\.)+", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", wording.lower()))
        spans |= {(a, a + len(norm), i) for a in edges if words[a:a + len(norm)] == norm and a + len(norm) in edges}
    ids = [i for a, b, i in sorted(spans) if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in spans)]
    out, left = set(), list(ids)
    for name, rule in sorted(rules, key=lambda r: -len(r[1])):
        used, state = [], []
        for at, i in enumerate(left):
            if i == rule[len(state)]:
                state.append(at)
            if len(state) == len(rule):
                used, state = used + state, []
                out.add(name)
        left = [i for at, i in enumerate(left) if at not in used]
    return ",".join(map(str, ids)), ",".join(sorted(out))


def test_licences_against_brute_force(spark, docs):
    wrap = lambda text, head="": "\n".join(head + line for line in textwrap.wrap(text, rnd.randint(25, 90)))
    wordings = list(licences.SENTENCES.values())
    texts = list(wordings)
    for _ in range(150):
        parts = [rnd.choice([rnd.choice(wordings), wrap(rnd.choice(wordings), rnd.choice(["", "# ", " * ", "1. "])), sentence(3),
                             rnd.choice(wordings)[:rnd.randint(5, 90)]]) for _ in range(rnd.randint(1, 9))]
        texts.append(rnd.choice(["\n", " ", "\n\n", ". "]).join(parts))
    texts += [None, "", "\x01", wordings[4] + "\x01" + wordings[5], "\n".join(wordings[13:17]), "\n".join(wordings[13:16]), " ".join(wordings[30:32])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = by_id(licences.scan_licences(df))
    for i, text in enumerate(texts):
        assert (found[i].sentence_ids, found[i].licences) == licences_by_brute_force(text, licences.SENTENCES, licences.RULES), text
    assert [found[len(texts) - n].licences for n in (3, 2, 1)] == ["BSD-3-Clause", "BSD-2-Clause", "Zlib"]
    single = {i: name for name, ids in licences.RULES if len(ids) == 1 for i in ids}
    assert all(found[i - 1].licences == single.get(i, "") for i in licences.SENTENCES)
    # Other tables, also a small and an empty one; repeated rows and rows without an id.
    other = {7: "ba n one", 8: "Some words here; and there."}
    rows = spark.createDataFrame([(None, "x.\nSome words here\nand there"), (None, "x.\nSome words here\nand there"), (1, "some words here and")], df.schema)
    assert sorted(r.licences for r in licences.scan_licences(rows, other, (("X", (8,)),)).collect()) == ["", "X", "X"]
    assert {r.n_sentences for r in licences.scan_licences(docs, {}, ()).collect()} == {0}


def test_licences_in_long_texts(spark):
    five, six = licences.SENTENCES[5], licences.SENTENCES[6]
    texts = [f"{six}\n" + f"{five}\n" * 30_000, "this program is " * 200_000, "this program is\n" * 100_000, "x" * 3_000_000, f"{five}\n{six}\n" * 10_000]
    began = time.time()
    found = by_id(licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)))
    assert [found[i].licences for i in range(5)] == ["GPL-3.0-only", "", "", "", "GPL-3.0-or-later"]
    assert [found[i].n_sentences for i in (0, 4)] == [30_001, 20_000] and time.time() - began < 60


def test_field_spans_in_lines_of_any_length():
    field, n = pii.trained(), pii.CHAIN_TOKENS
    for body in ("tel (212) 555-0199 for the front desk", "mail sam at mail dot example dot org today",
                 "mail sam at mail " + "dot x " * 300 + "dot org today"):
        alone = pii.field_spans(field, [body])[0]
        assert alone
        for cut in (n, 2 * n):
            for before in {cut - len(body.split()), cut - 3, cut - 2, cut - 1, cut, cut + 1}:
                filler = "word " * before
                text = filler + body + " word" * 3000
                assert pii.field_spans(field, [text])[0] == [(k, s + len(filler), e + len(filler)) for k, s, e in alone]
    assert pii.shape("a" * 70 + "-1") == "xxxx-9"
    # A long line is tagged as one chain would be.
    tokens = [rnd.choice(["call", "+44", "20", "7946", "0958", "at", "dot", "mail", "x", "4111", "1111"]) for _ in range(9000)]
    text = " ".join(tokens)
    starts, ends, tags = pii.long_chain(field, text, next(pii.lines(text)))
    assert [text[s:e] for s, e in zip(starts, ends, strict=True)] == tokens
    scores = field.scores(tokens).astype(float)
    worth = lambda way: scores[np.arange(len(way)), way].sum() + field.move[way[:-1], way[1:]].sum(dtype=float)
    assert worth(tags) >= worth(field.decode([field.scores(tokens)])[0]) - 1e-6


def test_hostile_texts_are_gone_through_once(spark):
    texts = {
        "0" * 5000 + ".0.0.1": "ip", "1" * 1_000_000: "", "1." * 300_000: "ip " * 75_000, "at-" * 350_000: "", "at-" * 100_000 + "dot-" * 100_000: "",
        "000000192.168.0.1.5.6.7.8.9": "ip ip", "256.1.1.1.1.1.1.1": "ip", "@" * 500_000: "", "a@" * 300_000: "", "+1-" * 300_000: "",
        "a@b." * 200_000: "", "1 " * 100_000: "", "x" * 1_000_000: "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.monotonic()
    found = by_id(pii.find_spans(df))
    assert time.monotonic() - began < 120
    for i, want in enumerate(texts.values()):
        assert found[i].n_ip == want.split().count("ip"), list(texts)[i][:40]
    pattern = pii.PATTERNS["ip"]
    for _ in range(3000):
        text = "".join(rnd.choice("0125.. a") for _ in range(rnd.randint(0, 40)))
        plain = [(m.start(), m.end()) for m in pattern.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert list(pii._ips(text)) == plain
        line = "".join(rnd.choice(["at", "dot", " ", "-", "x"]) for _ in range(rnd.randint(0, 9)))
        assert pii.spelled_out(line) == (re.search(r"\bat\b.+\bdot\b", line) is not None)


def test_archives_of_any_ids(spark):
    ids = [10**12, -(10**12), None, 0, 2**62, -(2**63), 7, None]
    rows = [(i, f"http://h.example/{n % 2}", "same" if n % 2 else f"page {n}") for n, i in enumerate(ids)]
    schema = "page_id long, url string, html string"
    out = warc.archived(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.page_id for r in out) == Counter(ids)
    same = [r for r in out if r.payload_bytes == 4]
    smallest = min(i for n, i in enumerate(ids) if n % 2 and i is not None)
    assert [r.page_id for r in same if r.record_type == "response"] == [smallest] == [-(2**63)]
    assert all(r.refers_to == smallest for r in same if r.record_type == "revisit")
    assert warc.archived(spark.createDataFrame([], schema)).count() == 0


def test_repeats_of_a_core_with_very_many_surroundings(spark):
    passage = BASE[0].encode().decode()[:420]
    texts = [f"{rnd.random()} {sentence(6)} {'ab'[i % 2] * (i % 9)}{passage}{'yz'[i % 2] * (i % 7)} {sentence(6)} {rnd.random()}"
             for i in range(1400)]
    raw = [t.encode() for t in texts]
    seen = Counter(t[i:i + 400] for t in raw for i in range(len(t) - 399))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = by_id(repeats.without_repeats(df))
    for doc, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert found[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()
    words = [(b"core", n, bytes([n % 5]) * 63, n.to_bytes(2, "big") * 4) for n in range(1, 3 * repeats.CORE_PIECES)]
    cut = spark.createDataFrame(words, "core binary, piece long, left binary, right binary")
    assert repeats.hot_cores(cut).count() == 1
    few = cut.where(F.col("piece") < 40)
    assert sorted(repeats.counted(few).collect()) == sorted(repeats.contested(few).collect()) != []


def test_anchors_of_repeats_are_cheap_and_leftmost():
    raw = np.frombuffer(rnd.randbytes(9000) + b"ab" * 900 + b"\0" * 900 + rnd.randbytes(50000), np.uint8)
    rolled, starts = repeats.Rolled(raw), np.arange(len(raw) - repeats.GRAM + 1)
    hashes = rolled.grams(repeats.GRAM, 0)
    assert (hashes == rolled.of(starts, starts + repeats.GRAM, 0)).all()
    grams = 400 - repeats.GRAM + 1
    upper = (hashes >> np.uint64(32)).tolist()
    found = repeats.anchors(hashes, 400)
    assert len(found) == len(raw) - 399
    for i in range(0, len(found), 7):
        assert found[i] == min(range(i, i + grams), key=lambda p: (upper[p], p))

    def gathered():
        at, span = np.arange(len(hashes)), 1
        while span * 2 <= grams:
            at = np.where(hashes[at[:-span]] <= hashes[at[span:]], at[:-span], at[span:])
            span *= 2

    def seconds(work):
        took = []
        for _ in range(9):
            begin = time.process_time()
            work()
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(lambda: repeats.anchors(hashes, 400)) < seconds(gathered) / 2


def test_repeats_of_texts_around_a_slice(spark):
    """Slices end between texts, and a text may be longer than one."""
    long = rnd.randbytes(repeats.SLICE).hex()
    texts = [long, "", None, long[-500:], "x" + long[:399], sentence(9), long[repeats.SLICE - 300:repeats.SLICE + 300],
             *(sentence(90) for _ in range(300)), long[700:1200]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = by_id(repeats.without_repeats(df))
    size = 2 * repeats.SLICE
    assert (found[0].n_removed, found[0].n_spans) == (1600, 3)
    assert found[0].kept_sha256 == hashlib.sha256(
        (long[:700] + long[1200:repeats.SLICE - 300] + long[repeats.SLICE + 300:size - 500]).encode()).hexdigest()
    assert [found[i].n_removed for i in (1, 2, 3, 4, 5, 6, len(texts) - 1)] == [0, 0, 500, 0, 0, 600, 500]
    first = repeats.runs(df, 400).where("doc_id = 0").agg(F.min("s"), F.max("e"), F.sum(F.col("e") - F.col("s") + 1)).first()
    assert tuple(first) == (0, size - 400, size - 399)


def test_windows_of_hot_cores_are_not_broadcast(spark):
    words = [(b"core", n, bytes([n % 5]) * 63, n.to_bytes(2, "big") * 31) for n in range(1, 600)]
    cut = spark.createDataFrame(words, "core binary, piece long, left binary, right binary")
    found = repeats.counted(repeats.written(cut, "few-pieces"))
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_repeats_keep_no_table_that_is_done_with(spark, docs, monkeypatch):
    closed, close = [], repeats.Store.close
    monkeypatch.setattr(repeats.Store, "close", lambda store: (closed.append(store.path), close(store)))
    assert repeats.without_repeats(docs).count() == len(ROWS)
    assert ["repeat-runs" in closed[0], "repeat-pieces" in closed[1]] == [True, True] and len(closed) == 2
    assert not any(os.path.exists(path.removeprefix("file:")) for path in closed)
