"""License scan by diagonal voting: DataFrame operations only.

Every k-gram of a document's words is looked up, by hash, among the k-grams of short license
templates; a hit at document word p and template word t votes for the diagonal p - t.  A
diagonal with the votes of all of a template's k-grams is a place where its words stand
consecutively.  Neighbouring diagonals (words put in or left out) are merged, and a merged
run with ``least`` of the template's votes gives the template's label too.  Hits are
verified by comparing the words themselves, so equal hashes alone are no vote.

The template table is fixed and small, and is broadcast; documents are read once, and only
hits and one row for each document are shuffled.

Null and empty texts have no words and no labels.  Repeated rows come back as often as they
came.  Very long texts are one row until their k-grams are laid out.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, lowered, text_key

K = 3
#: (label, base, words); fixed values of the query.  Base phrases come first.  At most 62 k-grams each.
TEMPLATES = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", False, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", False, "licensed under the apache license version 2 0"),
    ("gpl", False, "this work is licensed under the gnu general public license version"),
    ("gpl", False, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", False, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", False, "licensed under cc by nc 4 0"),
    ("cc-by-sa", False, "licensed under cc by sa 4 0"),
    ("cc-by", False, "licensed under a creative commons attribution 4 0 international license"),
]
LEAST, SLACK = 0.75, 2


def grams(spark: SparkSession, templates: list[tuple[str, bool, str]]) -> DataFrame:
    """(template, label, base, n_grams, t, g0, g1, g2): a row for each template position."""
    rows = []
    for i, (label, base, phrase) in enumerate(templates):
        words = phrase.split()
        n = len(words) - K + 1
        if not 1 <= n <= 62:
            raise ValueError(f"a template has {K} to {61 + K} words: {phrase}")
        rows += [(i, label, base, n, t, *words[t : t + K]) for t in range(n)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, t int, g0 string, g1 string, g2 string")


def votes(docs: DataFrame, templates: list[tuple[str, bool, str]]) -> DataFrame:
    """Hits (doc_id, key, n_words, p and the template's columns), and a row for each document, whose template is null where no hit is at its first word."""
    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD_PATTERN), F.lit(0)).alias("w"))
    laid = words.select(
        "doc_id", "key", F.size("w").alias("n_words"),
        F.posexplode_outer(F.expr("arrays_zip(w, slice(w, 2, greatest(size(w), 1)), slice(w, 3, greatest(size(w), 1)))")).alias("p", "g"),
    )
    laid = laid.select("doc_id", "key", "n_words", "p", *[F.col(f"g.{x}").alias(f"d{i}") for i, x in enumerate("w 1 2".split())])
    hashed = laid.withColumn("h", F.xxhash64("d0", "d1", "d2"))
    table = F.broadcast(grams(docs.sparkSession, templates).withColumn("h", F.xxhash64("g0", "g1", "g2")))
    same = (hashed.h == table.h) & (hashed.d0 == table.g0) & (hashed.d1 == table.g1) & (hashed.d2 == table.g2)
    hit = hashed.join(table, same, "left").where("template IS NOT NULL OR p IS NULL OR p = 0")
    return hit.select("doc_id", "key", "n_words", F.coalesce("p", F.lit(0)).alias("p"), "template", "label", "base", "n_grams", "t")


def spans(docs: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """Merged runs of diagonals: (doc_id, key, n_words, copies, template, label, base, n_places, first_place, last_place, first_word, end_word, coverage).

    A document without hits has one row with a null template.  n_places and the places count
    diagonals with all votes.  copies: how often the row (doc_id, text) is in the input.
    """
    got = votes(docs, templates).repartition("doc_id", "key")
    # A document row for each copy: those at word 0, once for each template hit there.
    per = Window.partitionBy("doc_id", "key", "n_words")
    by_diagonal = got.groupBy("doc_id", "key", "n_words", "template", "label", "base", "n_grams", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"),
        F.count(F.when(F.col("p") == 0, 1)).alias("at_zero"),
    )
    by_diagonal = by_diagonal.withColumn("copies", F.max(F.when(F.col("at_zero") > 0, F.col("at_zero"))).over(per))
    order = Window.partitionBy("doc_id", "key", "n_words", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"), F.lit(1))
    runs = by_diagonal.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    place = F.when(F.bit_count("votes") == F.col("n_grams"), F.col("diagonal"))
    return runs.groupBy("doc_id", "key", "n_words", "copies", "template", "label", "base", "n_grams", "run").agg(
        F.count(place).alias("n_places"), F.min(place).alias("first_place"), F.max(place).alias("last_place"),
        F.min("low").alias("first_word"), (F.max("high") + K).alias("end_word"),
        F.coalesce(F.bit_count(F.bit_or("votes")) / F.col("n_grams"), F.lit(0.0)).alias("coverage"),
    )


def query(docs: DataFrame) -> DataFrame:
    base = F.coalesce(F.col("base"), F.lit(False))
    found = F.when(F.col("n_places") > 0, True).otherwise((F.col("coverage") >= LEAST) & ~base)
    got = spans(docs).groupBy("doc_id", "key", "n_words", "copies").agg(
        F.coalesce(F.sum(F.when(base, F.col("n_places"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last_place"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base & (F.col("n_places") > 0), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return got.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_base").cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")


_VALUES = ", ".join(f"({i}, '{label}', {base}, '{words}')" for i, (label, base, words) in enumerate(TEMPLATES))
SQL = rf"""
WITH t AS (SELECT template, label, base, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(template, label, base, words)),
tg AS (SELECT template, label, base, len(w) - 2 AS n_grams, t, w[t + 1] || ' ' || w[t + 2] || ' ' || w[t + 3] AS gram
       FROM (SELECT *, unnest(range(len(w) - 2)) AS t FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') AS w
      FROM documents),
dg AS (SELECT rid, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM (SELECT rid, w, unnest(range(len(w) - 2)) AS p FROM d)),
hits AS (SELECT rid, template, label, base, n_grams, p - t AS diagonal, count(DISTINCT t) AS votes, list(DISTINCT t) AS ts
         FROM dg JOIN tg USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {SLACK} THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM marked),
s AS (SELECT rid, template, label, base, n_grams, run, count(*) FILTER (votes = n_grams) AS n_places,
        min(diagonal) FILTER (votes = n_grams) AS first_place, max(diagonal) FILTER (votes = n_grams) AS last_place,
        list(ts) AS votes
      FROM runs GROUP BY rid, template, label, base, n_grams, run),
c AS (SELECT *, len(list_distinct(flatten(votes))) / n_grams AS coverage FROM s)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(coalesce(sum(s.n_places) FILTER (s.base), 0) AS BIGINT) AS n_base,
  CAST(min(s.first_place) FILTER (s.base) AS BIGINT) AS first_word, CAST(max(s.last_place) FILTER (s.base) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT s.label) FILTER (s.base AND s.n_places > 0)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT s.label) FILTER (s.n_places > 0 OR s.coverage >= {LEAST} AND NOT s.base)), ','), '') AS labels,
  CAST(coalesce(max(s.coverage), 0) AS DOUBLE) AS score
FROM d LEFT JOIN c AS s ON s.rid = d.rid GROUP BY d.rid, d.doc_id, d.w
"""
