"""License scan by diagonal voting.

Every word k-gram of a document is looked up among the template k-grams; a match
at document position p and template position t votes for the diagonal p - t.
Neighbouring diagonals merge, so a few words put in or left out do not break a
notice, and a merged diagonal counts when enough of the template stands on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.llm.text import body, kept_rows, lowered, named, picked, upto, words_of

# Phrases and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public notices, in lower case and without punctuation.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution"
    ),
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies"
    ),
    "mit": "released under the mit license",
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software"
    ),
}

K = 4  # words of a gram
SLACK = 3  # neighbouring diagonals at most this far apart are one
COVER = 0.6  # share of a template's grams that must stand on a merged diagonal


def gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """One row per template position: label, n (its grams), tpos, h, gram."""
    whole = spark.createDataFrame(sorted(templates.items()), "label string, body string").select("label", words_of(F.col("body")).alias("words"))
    return whole.select("label", "words", (F.size("words") - k + 1).alias("n"), F.explode(upto(F.size("words") - k)).alias("tpos")).select(
        "label", "n", "tpos", gram(F.col("words"), F.col("tpos"), k).alias("h"), F.concat_ws(" ", F.slice("words", F.col("tpos") + 1, k)).alias("gram")
    )


def places(words: Column, text: Column, phrase: str) -> Column:
    """Word positions where the phrase stands; texts without its last word are not searched."""
    parts = phrase.split(" ")

    def stands(at: Column) -> Column:
        out = F.get(words, at) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, at + j) == w)
        return out

    return F.when(text.contains(parts[-1]), F.filter(upto(F.size(words) - len(parts)), stands)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, k: int = K,
    slack: int = SLACK, cover: float = COVER,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (array of label, at), found (array of label, start, stop, share).

    ``base`` are the places of the fixed phrases, ``found`` the verified template spans in words, stop exclusive.
    A null text is empty; empty texts and empty tables give no places; equal rows each give a row; a null id stays
    null; other columns are not read.  The templates are a fixed set, so their grams are broadcast.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    known = sorted({r.h for r in grams.select("h").collect()})
    text = picked(docs, id_col, text_col).select(named(id_col).alias("doc_id"), lowered(body(text_col)).alias("t"))
    split = text.select("doc_id", "t", words_of(F.col("t")).alias("words"))
    words = F.col("words")

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(words, F.col("t"), phrase), lambda at: F.struct(F.lit(label).alias("label"), at.alias("at")))

    base = F.flatten(F.array(*[labelled(*pair) for pair in PHRASES]))
    hits = F.filter(upto(F.size(words) - k), lambda at: gram(words, at, k).isin(known))
    rows = kept_rows(
        split.select("doc_id", F.size(words).cast("long").alias("n_words"), base.alias("base"), words, hits.alias("hits")).select(
            "doc_id", "n_words", "base",
            F.transform("hits", lambda at: F.struct(
                at.alias("pos"), gram(words, at, k).alias("h"), F.concat_ws(" ", F.slice(words, at + 1, k)).alias("gram")
            )).alias("hits"),
        )
    )
    votes = (
        rows.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
        .join(F.broadcast(grams), ["h", "gram"])
        .groupBy("rid", "label", "n", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("tpos").alias("seen"))
    )
    along = Window.partitionBy("rid", "label").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int"), F.lit(0))
    merged = (
        votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(along))
        .groupBy("rid", "label", "n", "band")
        .agg(F.min("low").alias("start"), (F.max("high") + k).alias("stop"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
        .withColumn("share", F.least(F.col("seen") / F.col("n"), F.lit(1.0)))
        .where(F.col("share") >= cover)
    )
    found = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", "start", "stop", "share"))).alias("found"))
    none = F.array().cast("array<struct<label:string,start:int,stop:int,share:double>>")
    return rows.join(found, "rid", "left").select("doc_id", "n_words", "base", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as counts and labels; a base phrase alone scores one half, a whole template one."""
    own = F.transform("found", lambda x: F.regexp_replace(x["label"], "-notice$", ""))
    base = F.col("base.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
        "found",
    )
