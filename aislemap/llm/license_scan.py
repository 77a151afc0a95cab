"""License scan by diagonal voting.

Every run of three words of every document is joined by hash to its positions in the
templates. Hits vote for their diagonal (document position minus template position);
neighbouring diagonals are merged, and spans are verified by their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aislemap.llm.common import term_words
from aislemap.session import materialise

GRAM = 3
# Diagonals this close belong together: a few words may be added to or missing from a notice.
NEAR = 4
COVERAGE = 0.6

# Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Opening words of public licence notices and their labels.
NOTICES = [
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution share alike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per template position: template, label, exact, grams (of the template), at, a, b, c, hash."""
    rows = []
    for number, (text, label, exact) in enumerate([(t, n, True) for t, n in base] + [(t, n, False) for t, n in notices]):
        words = text.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text}")
        for at in range(len(words) - GRAM + 1):
            rows.append((number, label, exact, len(words) - GRAM + 1, at, *words[at : at + GRAM]))
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, grams int, at int, a string, b string, c string")
    return made.withColumn("hash", F.xxhash64("a", "b", "c"))


def scan_hits(docs: DataFrame, table: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_words with at (word position) and the template columns for every hit, and one row without a hit per document."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), term_words(F.col(text)).alias("w"))
    runs = F.expr("transform(arrays_zip(w, slice(w, 2, greatest(size(w), 1)), slice(w, 3, greatest(size(w), 1))), x -> struct(x.w as a, x.`1` as b, x.`2` as c))")
    runs = words.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode_outer(runs).alias("pos", "run"))
    runs = runs.select("doc_id", "text_hash", "n_words", "pos", "run.a", "run.b", "run.c").withColumn("hash", F.xxhash64("a", "b", "c"))
    # the templates are a parameter: a few hundred rows
    found = runs.join(F.broadcast(table.withColumnRenamed("at", "slot")), ["hash", "a", "b", "c"], "left")
    return found.where("template is not null or coalesce(pos, 0) = 0").select(
        "doc_id", "text_hash", "n_words", "pos", "template", "label", "exact", "grams", "slot"
    )


def spans(hits: DataFrame, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, label, exact, first (word), last (word), coverage of every span found.

    A base phrase counts where one diagonal has all its runs. The diagonals of a notice are
    merged while they are at most ``near`` apart, and count from a share of the notice's runs.
    """
    key = ["doc_id", "text_hash", "template", "label", "exact", "grams"]
    votes = hits.where("template is not null").dropDuplicates([*key, "pos", "slot"]).withColumn("diagonal", F.col("pos") - F.col("slot"))
    exact = votes.where("exact").groupBy(*key, "diagonal").agg(F.count("*").alias("votes")).where("votes = grams")
    exact = exact.select("doc_id", "text_hash", "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("grams") + GRAM - 2).alias("last"), F.lit(1.0).alias("coverage"))
    order = Window.partitionBy(*key).orderBy("diagonal", "pos", "slot")
    loose = votes.where("not exact").withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(order))
    loose = loose.withColumn("group", F.sum(F.when(F.col("gap") <= near, 0).otherwise(1)).over(order))
    loose = loose.groupBy(*key, "group").agg(F.count_distinct("slot").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"))
    loose = loose.withColumn("coverage", F.col("votes") / F.col("grams")).where(F.col("coverage") >= coverage)
    return exact.unionByName(loose.select(*exact.columns))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null text counts as empty and has no words. Rows that repeat id and text each get the
    same result; rows that share an id with different texts are told apart by the text. An
    empty table gives no rows; other columns are ignored.
    """
    hits = materialise(scan_hits(docs, templates(docs.sparkSession, base, notices), text, doc_id))
    found = spans(hits)
    places = F.when(F.col("exact"), F.col("first"))
    per_doc = found.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(
        F.count(places).alias("n_base"), F.min(places).alias("first_word"), F.max(places).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "coverage"))).alias("spans"),
    )
    # every input row has exactly one run at position 0 (or none at all); several templates may share that run
    rows = hits.where("coalesce(pos, 0) = 0")
    per_run = F.greatest(F.size(F.collect_set(F.struct(F.coalesce("template", F.lit(-1)), F.coalesce("slot", F.lit(-1))))), F.lit(1))
    rows = rows.groupBy("doc_id", "text_hash", "n_words").agg((F.count("*") / per_run).cast("int").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    out = rows.join(per_doc, same, "left").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
