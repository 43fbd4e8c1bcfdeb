"""License scans in DataFrame operations only.

Two things are looked for. Phrases: every place where a phrase's words stand consecutively. Templates: an exact set-similarity
join of text blocks with license notices, by containment. A block is any run of consecutive words in which the notice would be
a share of ``least`` of the words, so line breaks, wrapping and sentence ends do not matter.

A template's tokens are ordered by their document frequency over all documents, rarest first. A block that holds ``need`` of its
tokens holds one of the first size - need + 1 (prefix filter). These prefix tokens are a table, token to template, of which
each occurrence in a text finds its templates by a join; the occurrence's surroundings must be long enough (length filter),
and if the token is the k-th of the template, no more than size - need of the k before it may be missing there (positional
filter). What remains is verified over all blocks that hold the occurrence. Answers are a function of the text, so equal texts
are answered once and joined back by their digest.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import spare

# The phrases of the base scan with their labels, and the license notices looked for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = NOT_WORD.replace("[", "[^")
LEAST = 0.9
SMALL = 1 << 20  # entries of the token table that are broadcast at most


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def lowered(text: Column) -> Column:
    """ASCII letters in lower case; the built-in ``lower`` does that where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(text: Column) -> Column:
    """The words with one space between; ``text`` is lower case."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def document_frequency(docs: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all documents each of a few tokens stands."""
    known = F.array(*map(F.lit, tokens))
    words = F.split(spaced(lowered(F.coalesce(F.col(text_col), F.lit("")))), " ")
    rows = docs.select(F.explode(F.array_intersect(words, known)).alias("token")).groupBy("token").count().collect()  # len(tokens) rows at most
    return {r["token"]: r["count"] for r in rows}


def _index(templates: list[tuple[str, str]], least: float, frequency: dict[str, int]) -> list[dict]:
    """Each template with its different tokens, rarest first, how many of them and how many words a block must and may have."""
    out = []
    for label, text in templates:
        if own := _tokens(text):
            order = sorted(set(own), key=lambda t: (frequency.get(t, 0), t))
            out.append({"label": label, "tokens": order, "need": math.ceil(least * len(order) - 1e-9), "width": math.ceil(len(own) / least - 1e-9)})
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, places and matches in place of the text.

    places: array of (label, start), every place of every phrase, words from 0. matches: array of (label, start, share): for
    each place of a prefix token of a template the best block around it, if it holds a share of ``least`` or more of the
    template's different tokens. A null text is empty: no words, no places, no matches. Rows stay as they are, repeated ones
    too; columns of the three names are replaced, other columns may have any name.
    """
    frequency = document_frequency(docs, sorted({t for _, text in templates for t in _tokens(text)}), text_col)
    index = _index(templates, least, frequency)
    others = [c for c in docs.columns if c not in (text_col, "n_words", "places", "matches")]
    plain, words, digest = spare(others, "plain", "words", "digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, spaced(lowered(text)).alias(plain), F.sha2(text.cast("binary"), 256).alias(digest))
    rows = rows.withColumn(words, F.when(F.col(plain) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))

    def places(phrase: str, label: str) -> Column:
        own = phrase.split(" ")

        def here(i: Column) -> Column:
            same = F.get(words, i) == own[0]
            for k, w in enumerate(own[1:], 1):
                same = same & (F.get(words, i + k) == w)
            return same

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)
        found = F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))
        return F.when(F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit(f" {phrase} ")), found)

    empty = F.array().cast("array<struct<label:string,start:bigint>>")
    all_places = F.concat(empty, *[F.coalesce(places(p, label), empty) for p, label in phrases.items()])
    counted = rows.select(*others, digest, F.size(words).cast("long").alias("n_words"), all_places.alias("places"))
    found = _found(rows.select(F.col(digest).alias("digest"), F.col(words).alias("words")), index).withColumnRenamed("digest", f"{digest}_of")
    none = F.array().cast("array<struct<label:string,start:bigint,share:double>>")
    joined = counted.join(found, F.col(digest) == F.col(f"{digest}_of"), "left")
    return joined.select(*others, "n_words", "places", F.coalesce("matches", none).alias("matches"))


def _found(rows: DataFrame, index: list[dict]) -> DataFrame:
    """(digest, matches) of the texts of ``rows`` (digest, words) that hold a template."""
    spark = rows.sparkSession
    entries = [(t, place, x["label"], x["tokens"], x["need"], x["width"]) for x in index for place, t in enumerate(x["tokens"][: len(x["tokens"]) - x["need"] + 1])]
    table = spark.createDataFrame(entries, "token string, place int, label string, tokens array<string>, need int, width int")
    table = F.broadcast(table) if len(entries) <= SMALL else table
    first, most = sorted({e[0] for e in entries}), max((x["width"] for x in index), default=1)
    hot = rows.where(F.arrays_overlap("words", F.array(*map(F.lit, first)).cast("array<string>")))
    here = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("token"), i.alias("at"))), lambda h: h["token"].isin(first))
    # an occurrence with as many words on either side as the widest template's block may have
    around = F.transform(here, lambda h: F.struct(h["token"].alias("token"), h["at"].alias("at"), F.slice("words", F.greatest(h["at"] - most + 2, F.lit(1)), F.lit(2 * most - 1)).alias("words")))
    met = hot.select("digest", F.explode(around).alias("h")).select("digest", "h.token", F.col("h.at").cast("long").alias("at"), F.col("h.words").alias("near")).join(table, "token")
    begin = F.least(F.col("at"), F.lit(most - 1).cast("long")).cast("int")  # where the occurrence stands in ``near``
    block = met.withColumn("from", F.greatest(begin - F.col("width") + 1, F.lit(0))).withColumn("block", F.slice("near", F.col("from") + 1, begin - F.col("from") + F.col("width")))
    block = block.withColumn("from", F.col("at") - begin + F.col("from"))
    missing = F.col("place") - F.size(F.array_intersect(F.slice("tokens", F.lit(1), F.col("place")), "block"))
    long_enough, in_place = F.size("block") >= F.col("need"), missing <= F.size("tokens") - F.col("need")
    enough = F.size(F.array_intersect("tokens", "block")) >= F.col("need")
    starts = F.sequence(F.lit(0), F.greatest(F.size("block") - F.col("width"), F.lit(0)))
    shares = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect("tokens", F.slice("block", s + 1, F.col("width")))).alias("shared"), (-s).alias("before")))
    best = block.where(long_enough & in_place).where(enough).withColumn("best", F.array_max(shares)).where("best.shared >= need")
    match = F.struct("label", (F.col("from") - F.col("best.before")).alias("start"), (F.col("best.shared") / F.size("tokens")).alias("share"))
    return best.groupBy("digest").agg(F.array_sort(F.collect_set(match)).alias("matches"))


def op3_license_scan(docs: DataFrame) -> DataFrame:
    """The contract's columns; the score is the largest share of a template found, or 1 where a phrase stands."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.array_distinct(F.transform("matches", lambda m: m["label"]))
    share = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"),
    )


def _sql() -> str:
    """DuckDB SQL that tries every block that begins with a token of the template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    index = _index(TEMPLATES, LEAST, {})
    tokens = ", ".join(f"({k}, {quoted(t)})" for k, x in enumerate(index) for t in x["tokens"])
    kinds = ", ".join(f"({k}, {quoted(x['label'])}, {len(x['tokens'])}, {x['need']}, {x['width']})" for k, x in enumerate(index))
    starts = []
    for phrase, label in PHRASES.items():
        own = phrase.split(" ")
        same = " and ".join(f"w[i + {n + 1}] = {quoted(x)}" for n, x in enumerate(own))
        starts.append(f"list_transform(list_filter(range(0, len(w) - {len(own) - 1}), lambda i: {same}), lambda i: {{'label': {quoted(label)}, 'pos': i}})")
    return f"""
with d as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents
), p as (select *, list_concat({", ".join(starts)}) as places from d),
t(k, token) as (values {tokens}),
kinds(k, label, n, need, width) as (values {kinds}),
x as (select rid, unnest(w) as token, unnest(range(len(w))) as pos from d),
h as (select rid, k, pos, token from x join t using (token)),
b as (
  select a.rid, a.k, a.pos, count(distinct o.token) as shared
  from h a join kinds using (k) join h o on a.rid = o.rid and a.k = o.k and o.pos >= a.pos and o.pos < a.pos + width group by all
), m as (
  select rid, label, max(shared / n) as share from b join kinds using (k) where shared >= need group by all
), s as (select rid, list(label) as own, max(share) as share from m group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(places) as bigint) as n_base,
  list_min(list_transform(places, lambda x: x.pos)) as first_word, list_max(list_transform(places, lambda x: x.pos)) as last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(own, [])))), ','), '') as labels,
  case when len(places) > 0 then 1.0 else coalesce(share, 0.0) end :: double as score
from p left join s using (rid)
"""


OP3_SQL = _sql()
