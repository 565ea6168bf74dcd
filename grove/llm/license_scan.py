"""License scan by diagonal voting, in DataFrame functions alone.

Every pair of neighbouring words of a text is hashed and joined to the same pairs of the
templates.  A hit at word ``p`` of the text and word ``q`` of a template votes for the
diagonal ``p - q``: the place where the template would start.  Votes are aggregated by
diagonal, neighbouring diagonals (a few words put in or left out) are merged into spans,
and a span is verified: its hits are walked in text order, and the longest chain that also
ascends in the template has to cover a share of it, so words of a license in another order
are not one.  Phrases and notices are templates that must be covered whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of the base scan (label, words).
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Short notices that name a public license (label, words).
NOTICES = (
    ("apache", "apache license version 2 0"),
    ("bsd", "under the bsd license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("mit", "under the mit license"),
    ("mpl", "mozilla public license"),
)
# Opening passages of public license texts (label, words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in "
               "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or "
            "neighboring rights to this work"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files to deal in the software without "
            "restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
#: Share of a template that a span has to cover.
MIN_COVER = 0.6
#: Diagonals up to this many words apart belong to one span.
DIAGONAL_GAP = 8
#: Most words of all templates together: they are broadcast.
MAX_TEMPLATE_WORDS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Lower-cased words of a text column; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")),
                                            UPPER, LOWER), F.lit(WORD), F.lit(0))


def _template_pairs(spark, phrases, notices, templates) -> DataFrame:
    rows = []
    for base, whole, group in ((True, True, phrases), (False, True, notices),
                               (False, False, templates)):
        for label, words in group:
            w = words.split()
            if len(w) < 2:
                raise ValueError(f"a template has two words at least: {label}")
            number = len({r[0] for r in rows})
            rows += [(number, label, base, whole, len(w) - 1, q, f"{w[q]} {w[q + 1]}")
                     for q in range(len(w) - 1)]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    return (spark.createDataFrame(rows, "template int, label string, base boolean, whole boolean, "
                                        "pairs int, q int, gram string")
            .withColumn("h", F.xxhash64("gram")))


def _chain(hits: Column, pairs: Column) -> Column:
    """Length of the longest run of hits (p, back = -q), sorted, that ascends in p and q.

    ``longest[q]`` is the longest chain so far that ends at template pair q.  Hits of one p come
    with descending q, so that no two of them are in a chain.
    """
    def step(longest: Column, hit: Column) -> Column:
        before = F.coalesce(F.array_max(F.slice(longest, F.lit(1), -hit["back"])), F.lit(0))
        return F.transform(longest, lambda x, q: F.when(q == -hit["back"],
                                                        F.greatest(x, before + 1)).otherwise(x))
    return F.aggregate(hits, F.array_repeat(F.lit(0), pairs), step, F.array_max)


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  phrases=PHRASES, templates=TEMPLATES, min_cover: float = MIN_COVER,
                  gap: int = DIAGONAL_GAP, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base (places of base phrases), first_word
    and last_word (least and greatest start of them, else null), base_labels, labels (sorted,
    distinct, comma-joined; the latter with the notices' and templates'), score (1 with a base
    phrase, else the best cover of a verified span, else 0) and spans (label, start, cover of
    the verified spans of notices and templates).

    Null and empty texts have no words and no labels.  Rows with the same key and text get
    equal results; rows with a null key are judged like others.  An empty table gives an
    empty result; other columns are not read.  A long text is read whole; only its hits, not
    its words, are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    rows = rows.select("_key", F.xxhash64("_text").alias("_th"), words_of("_text").alias("_w"))
    rows = rows.select("_key", "_th", "_w", F.size("_w").cast("long").alias("n_words"))
    known = F.broadcast(_template_pairs(spark, phrases, notices, templates))   # bounded above
    starts = F.when(F.col("n_words") > 1, F.sequence(F.lit(0), F.col("n_words").cast("int") - 2))
    grams = F.transform(starts, lambda i: F.struct(
        i.alias("p"), F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1)).alias("g")))
    hits = (rows.select("_key", "_th", F.explode(grams).alias("x"))
            .select("_key", "_th", "x.p", "x.g")
            .join(known, (F.xxhash64("g") == F.col("h")) & (F.col("g") == F.col("gram"))))
    same = ["_key", "_th", "template", "label", "base", "whole", "pairs"]
    votes = (hits.groupBy(*same, (F.col("p") - F.col("q")).alias("diagonal"))
             .agg(F.collect_set("q").alias("qs")))
    # phrases, notices: the whole on one diagonal; templates: neighbouring diagonals together
    line = Window.partitionBy("_key", "_th", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(line)
    spans = (votes.withColumn("_new", F.when(~F.col("whole") & (step <= gap), 0).otherwise(1))
             .withColumn("span", F.sum("_new").over(line))
             .groupBy(*same, "span")
             .agg(F.min("diagonal").cast("long").alias("start"),
                  F.flatten(F.collect_list(F.transform("qs", lambda q: F.struct(
                      (F.col("diagonal") + q).alias("p"), (-q).alias("back"))))).alias("hits"))
             .withColumn("bar", F.when(F.col("whole"), F.col("pairs"))
                         .otherwise(min_cover * F.col("pairs")))
             .where(F.size("hits") >= F.col("bar"))
             .withColumn("cover", F.when(F.col("whole"), F.size("hits"))
                         .otherwise(_chain(F.array_sort("hits"), F.col("pairs"))))
             .where(F.col("cover") >= F.col("bar"))
             .withColumn("cover", F.col("cover") / F.col("pairs")))
    phrase = F.col("base")
    found = spans.groupBy("_key", "_th").agg(
        F.count_if(phrase).alias("n_base"), F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(phrase, F.col("label"))).alias("_base"),
        F.collect_set(F.when(~phrase, F.col("label"))).alias("_more"),
        F.max(F.when(~phrase, F.col("cover"))).alias("_cover"),
        F.sort_array(F.collect_list(F.when(~phrase, F.struct("label", "start", "cover"))))
        .alias("spans"))
    none = F.array().cast("array<string>")
    f = found.select(F.col("_key").alias("_fk"), F.col("_th").alias("_ft"),
                     *[c for c in found.columns if c not in ("_key", "_th")])
    base, more = F.coalesce("_base", none), F.coalesce("_more", none)
    return (rows.select("_key", "_th", "n_words")
            .join(f, F.col("_key").eqNullSafe(F.col("_fk")) & (F.col("_th") == F.col("_ft")),
                  "left")
            .select(F.col("_key").alias(key), "n_words",
                    F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    "first_word", "last_word",
                    F.array_join(F.sort_array(base), ",").alias("base_labels"),
                    F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
                    F.when(F.size(base) > 0, F.lit(1.0))
                    .otherwise(F.coalesce("_cover", F.lit(0.0))).alias("score"), "spans"))
