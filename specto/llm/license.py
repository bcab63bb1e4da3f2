"""License scans by diagonal voting: hits of rolling word k-grams vote for the offset between a text and a template."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall  # on UTF-8 bytes: bytes from 0x80 belong to words
WORD_JAVA = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # on the text as it is, before lower-casing

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening passages of public license texts; each adds its label.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-line": "Released under the MIT License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
K = 2


def words_of(text: str) -> list[bytes]:
    return WORD(text.encode("utf-8", "surrogatepass").lower())


def rolling(words: list[bytes]) -> np.ndarray:
    """The hash of the two words that begin at each position but the last."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def template_grams(templates: dict[str, str], phrases: dict[str, str]) -> list[tuple[int, bytes, str, int, int, bool]]:
    """gram, its words, template, position, grams of the template, whether a base phrase: a fixed table of a few hundred rows."""
    rows = []
    for base, group in ((True, phrases), (False, {v: k for k, v in templates.items()})):
        for text, label in group.items():
            words = words_of(text)
            grams = rolling(words)
            rows += [(int(g), b" ".join(words[i : i + K]), label, i, len(grams), base) for i, g in enumerate(grams)]
    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, near: int = 4, min_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. The hashes of all rolling 2-grams of
    every text are taken; those that no template has can't join and are left out before they become rows, and the rest are
    joined to the template positions by hash and words (broadcast: a fixed table), so that each hit is two equal words.
    Hits are added up by diagonal, the text position minus the template position. A base phrase stands at each diagonal
    with all its votes. For longer templates, diagonals within `near` words merge into a span, as words put in or left out
    move the diagonal; a span is verified by reading its hits in text order: those that go forward in the template must
    cover `min_cover` of it, and the span mustn't be stretched over more than twice the template. score is 1 with a base
    phrase, else the best cover among verified spans, else 0. Spans of several templates may overlap, and each gives its label.

    A null text counts as empty: no words, no labels, null first_word. Rows are told apart by id and text, so repeated
    rows and null ids each get their result; a text of any length is scanned whole; other columns are passed over; an
    empty table gives none. Only two texts of one id could share the hash that tells them apart.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    known = template_grams(templates, phrases)
    wanted = np.unique([r[0] for r in known])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, pos, grams, pairs = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                if len(words) < K:
                    continue
                own = rolling(words)
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own)
                keys += [i] * len(at)
                grams.append(own[at])
                for j in at.tolist():
                    pos.append(j)
                    pairs.append(b" ".join(words[j : j + K]))
            return pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(keys, pa.int64())), "pos": pa.array(pos, pa.int32()), "gram": pa.array(np.concatenate(grams) if grams else [], pa.int64()), "words": pa.array(pairs, pa.binary())})

        return work

    table = docs.sparkSession.createDataFrame(known, "gram long, words binary, label string, at int, size int, base boolean")
    hits = map_batches(rows.select("key", "text"), make, f"key struct<id:{dict(rows.dtypes)['doc_id']},h:bigint>, pos int, gram long, words binary")
    hits = hits.join(F.broadcast(table), ["gram", "words"])
    diagonals = hits.groupBy("key", "base", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    diagonals = diagonals.withColumn("first", F.col("diagonal") + F.array_min("ats")).withColumn("end", F.col("diagonal") + F.array_max("ats") + K)
    order = Window.partitionBy("key", "base", "label", "size").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near) | F.col("base"), F.lit(True))
    spans = diagonals.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(order))
    read = F.flatten(F.collect_list(F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), at.alias("at")))))
    spans = spans.groupBy("key", "base", "label", "size", "span").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sort_array(read).alias("hits"))
    begin = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    forward = F.aggregate("hits", begin, lambda s, h: F.when(h["at"] > s["last"], F.struct(h["at"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    spans = spans.withColumn("votes", forward)
    cover = F.col("votes") / F.col("size")
    spans = spans.withColumn("cover", cover).where(F.when(F.col("base"), F.col("votes") == F.col("size")).otherwise((cover >= min_cover) & (F.col("end") - F.col("first") <= 2 * (F.col("size") + K - 1))))
    found = spans.groupBy("key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "end", "label", "cover"))).alias("spans"),
    )
    every = rows.select("doc_id", "key", F.regexp_count("text", F.lit(WORD_JAVA)).cast("long").alias("n_words"))
    return every.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("spans")
