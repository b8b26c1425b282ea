"""Find licences by their sentences.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sentences as the licences word them, and the licences as ordered sentences.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "you may not use this file except in compliance with the License.",
    3: "Released under the MIT License.",
    4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    5: "This work is licensed under the GNU General Public License, version 3.",
    6: "either version 3 of the License, or (at your option) any later version.",
    7: "Licensed under CC BY-NC 4.0.",
    8: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    9: "Redistribution and use in source and binary forms, with or without modification, are permitted",
    10: "Licensed under CC BY 4.0.",
    11: "Licensed under the Apache License, Version 2.0 (the License);",
    12: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    13: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    14: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    15: "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    16: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    17: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    18: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    19: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation.",
    20: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
    21: "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    22: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    23: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    24: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    25: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.",
    26: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide.",
    27: "This is free and unencumbered software released into the public domain.",
    28: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    29: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    30: "Distributed under the Boost Software License, Version 1.0.",
    31: "This software is provided 'as-is', without any express or implied warranty.",
    32: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
    33: "This work is licensed under the GNU General Public License, version 2.",
    34: "either version 2 of the License, or (at your option) any later version.",
}
RULES = (
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (11, 2)),
    ("MIT", (3,)),
    ("MIT", (4,)),
    ("GPL-3.0-only", (5,)),
    ("GPL-3.0-or-later", (5, 6)),
    ("CC-BY-NC-4.0", (7,)),
    ("CC-BY-NC-4.0", (8,)),
    ("BSD", (9,)),
    ("CC-BY-4.0", (10,)),
    ("GPL-3.0-or-later", (12,)),
    ("MIT", (13,)),
    ("BSD", (14,)),
    ("BSD-2-Clause", (14, 15, 16)),
    ("BSD-3-Clause", (14, 15, 16, 17)),
    ("GPL-2.0-or-later", (18,)),
    ("GPL-2.0-only", (19,)),
    ("LGPL-2.1-or-later", (20,)),
    ("LGPL-3.0-or-later", (21,)),
    ("AGPL-3.0-or-later", (22,)),
    ("MPL-2.0", (23,)),
    ("ISC", (24,)),
    ("0BSD", (25,)),
    ("CC0-1.0", (26,)),
    ("Unlicense", (27,)),
    ("CC-BY-4.0", (28,)),
    ("CC-BY-SA-4.0", (29,)),
    ("BSL-1.0", (30,)),
    ("Zlib", (31, 32)),
    ("GPL-2.0-only", (33,)),
    ("GPL-2.0-or-later", (33, 34)),
)


def normalised(sentence: Column) -> Column:
    """Lower case, runs of anything but letters, digits and dots inside numbers as one blank."""
    plain = F.regexp_replace(F.lower(sentence), r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}.]+", " "))


EDGE = "\x01"
#: A sentence is looked up by its first words.
HEAD_WORDS = 3
#: A table of at most so many sentences is sent to every executor.
SENT_SENTENCES = 10_000


def edged(text: Column) -> Column:
    """The normal form of a whole text, with EDGE for a blank where a line or a sentence ends, and round it."""
    plain = F.translate(F.lower(text), EDGE, " ")
    plain = F.regexp_replace(plain, r"\n|[;:!?.](?=\s|$)", EDGE)
    plain = F.regexp_replace(plain, r"(?<![0-9])\.|\.(?![0-9])", " ")
    plain = F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}.{EDGE}]+", " ")
    return F.concat(F.lit(EDGE), F.regexp_replace(plain, f" ?{EDGE}[ {EDGE}]*|^ | $", EDGE), F.lit(EDGE))


def known_sentences(spark: SparkSession, sentences: dict[int, str]) -> list:
    """(sentence, norm, head) of the table's wordings; of equal normal forms the smallest identifier."""
    wordings = spark.createDataFrame(list(sentences.items()), "sentence int, wording string")
    norms = wordings.groupBy(normalised(F.col("wording")).alias("norm")).agg(F.min("sentence").alias("sentence"))
    known = norms.select("sentence", "norm", _head(F.col("norm")).alias("head")).collect()
    if any(row["norm"].count(" ") < HEAD_WORDS - 1 for row in known):
        raise ValueError(f"a sentence needs {HEAD_WORDS} words")
    return known


def _head(words: Column) -> Column:
    return F.xxhash64(F.substring_index(words, " ", HEAD_WORDS))


def licence_sentences(documents: DataFrame, sentences: dict[int, str] = SENTENCES) -> DataFrame:
    """(doc_id, text_key, at, sentence): the known sentences of every whole text, `at` the piece they begin with.

    A sentence begins and ends where a line or a sentence of the text does (a line's end, or a colon, semicolon,
    dot, `!` or `?` before white space), and may be wrapped in any way between: lines and signs are blanks. What lies
    inside another known sentence of the text is not one of its own; repeated rows count once.

    Texts are cut into pieces at such ends. The first words from a piece on, hashed, are met with those of the
    table; only where they meet are the next pieces compared with the wording, so the work does not grow with the
    number of wordings.
    """
    spark = documents.sparkSession
    known = known_sentences(spark, sentences)
    most = max((len(row["norm"]) for row in known), default=0)
    heads = F.array(*(F.lit(h) for h in sorted({row["head"] for row in known}))).cast("array<bigint>")
    word = f"[^ {EDGE}]+"
    firsts = F.regexp_extract_all("marked", F.lit(f"{EDGE}(?=({f'[ {EDGE}]'.join([word] * HEAD_WORDS)}))"), F.lit(1))
    some = F.arrays_overlap(F.transform(firsts, lambda h: F.xxhash64(F.translate(h, EDGE, " "))), heads)

    def begun(pieces: Column) -> Column:
        starts = F.transform(pieces, lambda _, i: F.struct(
            i.alias("at"), _head(F.concat_ws(" ", F.slice(pieces, i + 1, HEAD_WORDS))).alias("head")))
        # No wording has more pieces than letters, and of a longer piece the rest cannot matter.
        following = lambda at: F.transform(F.slice(pieces, at + 1, most), lambda p: F.left(p, F.lit(most + 1)))
        return F.transform(F.filter(starts, lambda s: F.array_contains(heads, s["head"])), lambda s: F.struct(
            s["at"], s["head"],
            F.left(F.concat(F.concat_ws(EDGE, following(s["at"])), F.lit(EDGE)), F.lit(most + 1)).alias("body")))

    pieces = F.filter(F.split("marked", EDGE), lambda p: p != "")
    candidates = (
        documents.select("doc_id", F.xxhash64("text").alias("text_key"), edged(F.coalesce(F.col("text"), F.lit(""))).alias("marked"))
        .where(some)
        # The pieces are bound as a lambda's variable, so that looking at one does not cut the text again.
        .select("doc_id", "text_key", F.inline(F.transform(F.array(pieces), begun)[0])))
    table = spark.createDataFrame(known, "sentence int, norm string, head long")
    if len(known) <= SENT_SENTENCES:
        table = F.broadcast(table)
    body = F.col("body")
    met = candidates.join(table, "head").where(
        F.startswith(F.translate(body, EDGE, " "), F.col("norm")) & (F.substr(body, F.length("norm") + 1, F.lit(1)) == EDGE))
    covered = F.left(body, F.length("norm") + 1)
    spans = met.select(
        "doc_id", "text_key", "at", "sentence",
        (F.col("at") + F.length(covered) - F.length(F.translate(covered, EDGE, ""))).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "text_key").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("end").over(before)).where(
        F.col("reached").isNull() | (F.col("end") > F.col("reached"))).select("doc_id", "text_key", "at", "sentence")


def scan_licences(documents: DataFrame, sentences: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences long, sentence_ids string, licences string (sorted, comma-joined), licensed boolean.

    A rule holds where its sentences stand in its order in the document, others between them allowed. Rules of more sentences
    come first and use theirs up, so a licence "version 3" followed by "or any later version" is not also one of version 3 only.
    Null and empty texts have no sentence; every row of `documents` has its own row, repeated rows too.
    """
    by_document = licence_sentences(documents, sentences).groupBy("doc_id", "text_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]).alias("ids"))
    ruled = by_document.withColumn("line", F.concat(F.array_join("ids", ","), F.lit(",")))
    ruled = ruled.withColumn("held", F.array().cast("array<string>"))
    for name, ids in sorted(rules, key=lambda rule: -len(rule[1])):
        # Each match begins where the last one ended and nothing is tried twice, so a line is gone through once.
        pattern = r"\G" + "".join(rf"((?:(?!{i},)\d+,)*+){i}," for i in ids)
        ruled = ruled.withColumns({
            "held": F.when(F.col("line").rlike(pattern), F.array_append("held", F.lit(name))).otherwise(F.col("held")),
            "line": F.regexp_replace("line", pattern, "".join(f"${n}" for n in range(1, len(ids) + 1))),
        })
    named = ruled.select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.size("ids").cast("long").alias("n"),
        F.array_join("ids", ",").alias("ids"),
        F.array_join(F.array_sort(F.array_distinct("held")), ",").alias("names"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"))
    return rows.join(
        named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left",
    ).select(
        "doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_sentences"),
        F.coalesce("ids", F.lit("")).alias("sentence_ids"), F.coalesce("names", F.lit("")).alias("licences"),
        (F.coalesce("names", F.lit("")) != "").alias("licensed"))
