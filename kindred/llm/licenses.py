"""License scans by diagonal voting.

Every text's words are compared with license templates: the hash of each run of three words is joined
to its positions in the templates.  A match votes for the diagonal text position minus template
position.  Votes are added up by diagonal, neighbouring diagonals (words put in or left out) merge,
and a span counts if its votes, each verified word by word, cover at least ``cover`` of the
template's runs within a span of no more than about half as many words again.

All of it is built-in functions: one scan splits, hashes, joins (the template table is a constant) and
counts; what leaves the scan are only the votes.

Null texts count as empty.  Results are one row per input row; the votes of rows with the same id and
text are joined to each of them.  Null ids are kept.  Further columns are ignored, and an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 3

# Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public notices by label, in words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)


def words_of(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def base_places(words):
    """(start, label) of the base phrases in an array of words."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        hits = _places(words, parts, label)
        out.append(F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), hits).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")))
    return F.when(F.size(words) > 1, F.concat(*out)).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def _places(words, parts: list[str], label: str):
    def here(i):
        out = F.get(words, i) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + j) == w)
        return out

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def template_runs(spark) -> DataFrame:
    """(h, template, label, place, runs, run): the runs of the templates; a constant of a few hundred rows."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(t, label, i, len(w) - RUN + 1, " ".join(w[i : i + RUN]), *w[i : i + RUN]) for i in range(len(w) - RUN + 1)]
    df = spark.createDataFrame(rows, "template int, label string, place int, runs int, run string, w0 string, w1 string, w2 string")
    return df.select(F.xxhash64("w0", "w1", "w2").alias("h"), "template", "label", "place", "runs", "run")


def scan(docs: DataFrame, cover: float = 0.75, gap: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    at = F.col("places")
    base = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), base_places(F.col("words")).alias("places")).select(
        "doc_id", "key", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(F.transform(at, lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform(at, lambda x: x["at"])).alias("last_word"), F.array_sort(F.array_distinct(F.transform(at, lambda x: x["label"]))).alias("own"),
    )

    words = F.col("words")
    three = F.arrays_zip(words.alias("w0"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("w1"), F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))).alias("w2"))
    runs = rows.select("doc_id", "key", F.posexplode(three).alias("pos", "r")).select("doc_id", "key", "pos", "r.w0", "r.w1", "r.w2")
    runs = runs.withColumn("h", F.xxhash64("w0", "w1", "w2"))
    templates = F.broadcast(template_runs(docs.sparkSession))  # a constant
    votes = runs.join(templates, "h").where(F.concat_ws(" ", "w0", "w1", "w2") == F.col("run"))
    doc = ["doc_id", "key", "template", "label", "runs"]
    lines = votes.groupBy(*doc, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy(*doc).orderBy("diagonal")
    step = (F.col("diagonal") - F.lag("diagonal").over(order) > gap) | (F.col("lo") - F.lag("hi").over(order) > F.col("runs"))
    merged = lines.withColumn("span", F.sum(F.coalesce(step.cast("int"), F.lit(1))).over(order))
    spans = merged.groupBy(*doc, "span").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    covered = F.size("places") / F.col("runs")
    good = spans.where((covered >= cover) & (F.col("hi") - F.col("lo") + 1 <= 1.5 * F.col("runs") + gap + F.when(F.col("runs") <= 2, 1e9).otherwise(0)))
    found = good.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max(covered).alias("best"))

    none = F.array().cast("array<string>")
    same = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["key"] == found["key"])
    return base.join(found, same, "left").select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
