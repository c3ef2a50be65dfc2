"""License scan by diagonal voting, with DataFrame operations only.

Hashes of all rolling ``K``-word grams of every text are joined with the grams
of the templates, which gives pairs of positions.  Pairs on one diagonal
(position in the text minus position in the template) are counted together;
neighbouring diagonals, which inserted or missing words cause, are merged into
one span; a span counts when the words that shared grams cover, against all
words of span and template, reach ``SIMILARITY``.  A base phrase counts on a single diagonal
that holds all of its grams, that is, where its words stand consecutively.

The templates (one-line notices here, whole texts and file headers in
``license_texts``) are a fixed table of some two thousand grams and broadcast; a caller's
own larger table is joined by key.  Grams of a text that meet no template end
in the join; a marker gram keeps one row for every text, so one scan serves.

Null and empty texts: no words, no labels, score 0.  Repeated rows give a row
each.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surv.llm.license_texts import TEXTS
from surv.llm.sqlwords import kgrams, words

K = 3
GAP = 3              # words by which neighbouring diagonals may differ
SIMILARITY = 0.8
BROADCAST_GRAMS = 50_000

# --- fixed values: phrases and license notices --------------------------------
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def templates(spark: SparkSession, base=BASE, notices=NOTICES + TEXTS) -> DataFrame:
    """One row per gram: template number, label, kind, grams in all, position, hash."""
    rows = [(i, lab, "base", t) for i, (lab, t) in enumerate(base)] + [(len(base) + i, lab, "notice", t) for i, (lab, t) in enumerate(notices)]
    d = spark.createDataFrame(rows, "tid int, label string, kind string, text string").withColumn("w", words(F.col("text")))
    if d.where(F.size("w") < K).take(1):
        raise ValueError(f"a template needs {K} words")
    return d.select("tid", "label", "kind", (F.size("w") - K + 1).alias("m"), F.posexplode(kgrams(F.col("w"), K)).alias("q", "gram"))


def spans(docs: DataFrame, tmpl: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """Merged spans of all texts:
    a row per (text, template, span), and one with a null template per text."""
    t = tmpl.select("tid", "label", "kind", "m", "q", F.lit(False).alias("own"), "gram")
    mark = docs.sparkSession.createDataFrame([(-1, None, "marker", 0, -1, True, 0)], t.schema)
    t = t.unionByName(mark)
    if tmpl.count() <= BROADCAST_GRAMS:
        t = F.broadcast(t)
    d = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
         .withColumn("row", F.monotonically_increasing_id()).withColumn("w", words(F.col("text"))))
    d = d.select("row", "id", F.size("w").cast("long").alias("n_words"), kgrams(F.col("w"), K).alias("g"))
    # the marker is one more element, at position size(g)
    e = d.select("row", "id", "n_words", F.size("g").alias("end"), F.posexplode(F.concat(F.col("g"), F.array(F.lit(0).cast("long")))).alias("p", "gram"))
    e = e.select("row", "id", "n_words", "p", "gram", (F.col("p") == F.col("end")).alias("own"))
    hits = e.join(t, ["own", "gram"])
    diag = (hits.groupBy("row", "id", "n_words", "tid", "label", "kind", "m", F.when(~F.col("own"), F.col("p") - F.col("q")).alias("d"))
            .agg(F.collect_set("q").alias("qs"), F.min("p").alias("p0"), F.max("p").alias("p1")))
    w = Window.partitionBy("row", "tid").orderBy("d")
    step = F.when((F.col("kind") == "notice") & (F.col("d") - F.lag("d").over(w) <= gap), 0).otherwise(1)
    run = diag.withColumn("step", step).withColumn("span", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = (run.groupBy("row", "id", "n_words", "tid", "label", "kind", "m", "span")
              .agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
              .withColumn("shared", F.size("qs")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (K - 1))))))
    both = F.col("m") + F.col("p1") - F.col("p0") + (2 * K - 1)
    return (merged.withColumn("covered", F.when(F.col("kind") == "marker", F.lit(None)).otherwise(covered))
            .withColumn("similarity", F.col("covered") / (both - F.col("covered"))).drop("qs"))


def scan(docs: DataFrame, tmpl: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, number of words, base places (count, first and
    last word), base labels, all labels, best similarity, and the verified
    spans ``(label, first, last, similarity)``."""
    s = spans(docs, templates(docs.sparkSession) if tmpl is None else tmpl, id_col, text_col)
    base = (F.col("kind") == "base") & (F.col("shared") == F.col("m"))
    notice = (F.col("kind") == "notice") & (F.col("similarity") >= SIMILARITY)
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return s.groupBy("row", "id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("p0"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("p0"))).cast("long").alias("last_word"), labels(base).alias("base_labels"),
        labels(base | notice).alias("labels"), F.coalesce(F.max("similarity"), F.lit(0.0)).cast("double").alias("score"),
        F.sort_array(F.collect_list(F.when(base | notice, F.struct(F.col("p0").alias("first"), (F.col("p1") + K - 1).alias("last"), "label", "similarity")))).alias("spans"),
    ).drop("row").withColumnRenamed("id", id_col)
