"""License scan by diagonal voting of word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K = 2                 # words of a k-gram
NEIGHBOUR = 3         # diagonals so close are one place with words put in or left out
LEAST_COVERAGE = 0.6  # share of a template's k-grams that a place must have
_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # A-Z is lower-cased first, so capitals don't part words

# The base phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Further templates, wordings of notices and licence texts that are found with words changed.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def words(text: Column) -> Column:
    """Words of the lower-cased text; null and empty texts have none.

    Only A-Z must be lower-cased; other letters are too, which changes no word border and is undone by the exact comparison
    of template words, which are ASCII, with the original letters.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATOR), "")


def _lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_positions(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(h, gram, template, label, is_base, at, grams): each k-gram of each template; as many rows as the templates have words."""
    rows = []
    for number, (label, phrase) in enumerate([*base, *templates]):
        w = re.findall("[a-z0-9]+", phrase)
        for at in range(len(w) - K + 1):
            rows.append((" ".join(w[at:at + K]), number, label, number < len(base), at, len(w) - K + 1))
    df = spark.createDataFrame(rows, "gram string, template int, label string, is_base boolean, at int, grams int")
    return df.withColumn("h", F.xxhash64("gram"))


def row_key() -> Column:
    """Names a row by id and text; rows of one key with other ids or, by chance of a digest, other texts don't meet."""
    return F.concat_ws(":", F.xxhash64("doc_id", "text"), F.col("doc_id"), F.length("text"))


def hits(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """(row, template, label, is_base, grams, at, pos): every rolling k-gram of every text joined to the template positions by hash.

    The exploded k-grams stay in their task: the template side is as large as the template list, a parameter, and so broadcast.
    """
    grams = F.expr("zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> if(b is null, null, concat(a, ' ', b)))")
    rolled = rows.select("row", F.posexplode(grams).alias("pos", "said"))
    lowered = rolled.select("row", "pos", "said", F.xxhash64(F.lower("said")).alias("h")).where("said is not null")
    found = lowered.join(F.broadcast(positions), "h")
    return found.where(_lower(F.col("said")) == F.col("gram")).drop("h", "said", "gram")


def spans(found: DataFrame) -> DataFrame:
    """(row, template, label, is_base, first, last, coverage): places of templates, from votes of diagonals.

    A hit votes for the diagonal pos - at.  Votes are aggregated per diagonal; neighbouring diagonals are merged into one place;
    a place stands if enough different k-grams of the template are there.  A chain of diagonals that runs over more than twice the
    template's length is no single place: its diagonals are then verified one by one, and on one diagonal the k-grams stand
    in the template's order.  For base phrases nothing is merged and all must be there: the phrase stands word by word.
    """
    votes = found.groupBy("row", "template", "label", "is_base", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("is_base") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR)
    placed = votes.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("place", F.sum("_new").over(along))
    chain = Window.partitionBy("row", "template", "place")
    overlong = F.max("last").over(chain) - F.min("first").over(chain) + 1 > F.col("grams") * 2
    split = placed.withColumn("alone", F.when(overlong, F.col("diagonal")))
    merged = split.groupBy("row", "template", "label", "is_base", "grams", "place", "alone").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("start"))
    coverage = F.size("ats") / F.col("grams")
    return merged.withColumn("coverage", coverage).where(F.when(F.col("is_base"), F.col("coverage") == 1.0).otherwise(F.col("coverage") >= LEAST_COVERAGE)).select("row", "template", "label", "is_base", "start", "first", "last", "coverage")


def scan(docs: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, is_base, start, first, last, coverage): the places found, one row each; start counts words from 0."""
    rows = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("words"))
    found = spans(hits(rows, positions if positions is not None else template_positions(docs.sparkSession)))
    return rows.select("doc_id", "row").distinct().join(found, "row").drop("row")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no places; repeated rows get the same result each; no rows give no rows; other
    columns are ignored; very long texts are rolled over whole, in their own task.  The score is the largest coverage of any place, 0 without one.
    """
    rows = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("words"))
    found = spans(hits(rows, template_positions(docs.sparkSession)))
    base = F.col("is_base")
    per_row = found.groupBy("row").agg(
        F.count_distinct(F.when(base, F.struct("template", "start"))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"))
    sizes = docs.select("doc_id", row_key().alias("row"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    joined = sizes.join(per_row, "row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql_positions() -> str:
    rows = []
    for number, (label, phrase) in enumerate([*BASE, *TEMPLATES]):
        w = phrase.split()
        rows += [f"('{' '.join(w[at:at + K])}', {number}, '{label}', {str(number < len(BASE)).lower()}, {at}, {len(w) - K + 1})" for at in range(len(w) - K + 1)]
    return ", ".join(rows)


SQL = f"""
WITH p(gram, template, label, is_base, pat, grams) AS (VALUES {_sql_positions()}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(words) - 1)) AS pos, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w WHERE len(words) > 1),
v AS (SELECT doc_id, template, label, is_base, grams, pos - pat AS diagonal, list(DISTINCT pat) AS ats, min(pos) AS fst, max(pos) AS lst FROM g JOIN p USING (gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN is_base OR lag(diagonal) OVER a IS NULL OR diagonal - lag(diagonal) OVER a > {NEIGHBOUR} THEN 1 ELSE 0 END AS fresh FROM v WINDOW a AS (PARTITION BY doc_id, template ORDER BY diagonal)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS place FROM n),
o AS (SELECT *, CASE WHEN max(lst) OVER h - min(fst) OVER h + 1 > grams * 2 THEN diagonal END AS alone FROM c WINDOW h AS (PARTITION BY doc_id, template, place)),
m AS (SELECT doc_id, template, label, is_base, grams, len(list_distinct(flatten(list(ats)))) / grams AS coverage, min(diagonal) AS start FROM o GROUP BY doc_id, template, label, is_base, grams, place, alone),
f AS (SELECT * FROM m WHERE CASE WHEN is_base THEN coverage = 1.0 ELSE coverage >= {LEAST_COVERAGE} END)
SELECT w.doc_id, len(any_value(w.words))::BIGINT AS n_words, count(*) FILTER (f.is_base)::BIGINT AS n_base,
       min(f.start) FILTER (f.is_base)::BIGINT AS first_word, max(f.start) FILTER (f.is_base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.is_base), '') AS base_labels, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
       coalesce(max(f.coverage), 0)::DOUBLE AS score
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id
"""
