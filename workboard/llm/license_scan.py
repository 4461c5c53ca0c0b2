"""License scans by diagonal voting (DataFrame functions only).

Texts and templates are cut into rolling grams of two words. Every gram of every text
is joined with the template positions of the same gram (hash first, then the words
themselves). A hit at word i of a text and word j of a template votes for the diagonal
i - j, the place where the template would begin. Votes are summed by text, template and
diagonal; diagonals that lie next to each other (words put in or left out) are merged,
but no two that are a match alone; a merged span is a match if enough of the template's
grams (each counted once) voted for it and its length fits. A base phrase has to have all votes on one diagonal: then it stands there word by
word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 2

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Templates of this library: the opening words of well-known notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
)
#: A broadcast of the template grams is asked for up to so many template words; beyond, Spark picks the join.
BROADCAST_WORDS = 50_000


def words(text: Column) -> Column:
    """A-Z lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. lower() would also turn
    the Kelvin sign into an ASCII k; kra stands in for it, a letter that no template has."""
    text = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(word_col: str) -> Column:
    """Structs (at, hash, a, b) of the rolling grams in a column of word arrays."""
    here = F.col(word_col)

    def gram(word, i):
        after = F.get(here, i + 1)
        return F.struct(i.alias("at"), F.xxhash64(word, after).alias("hash"), word.alias("a"), after.alias("b"))

    return F.transform(here, gram)


def template_grams(spark: SparkSession, templates: tuple) -> DataFrame:
    """template, label, base, grams (their number), place, hash, a, b."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(text).alias("text"), F.lit(label).alias("label"),
                     F.lit(base).alias("base")) for i, (text, label, base) in enumerate(templates)]
    table = spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))).withColumn("words", words(F.col("text")))
    return (table.select("template", "label", "base", (F.size("words") - 1).alias("grams"),
                         F.explode(_grams("words")).alias("g"))
            .where("g.b is not null")
            .select("template", "label", "base", "grams", F.col("g.at").alias("place"), "g.hash", "g.a", "g.b"))


def license_spans(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, id_col: str = "doc_id",
                  text_col: str = "text", drift: int = 3, least: float = 0.75) -> DataFrame:
    """Verified spans: row, id, n_words, label, base, start, end, coverage; and for every
    row of ``docs`` one line without a label that carries n_words.

    ``drift``: how far neighbouring diagonals lie apart at most; ``least``: the share of a
    notice's grams that has to vote. Templates need two words. Nulls are empty texts;
    repeated rows are scanned each for itself (``row`` numbers the rows of one run); an
    empty table gives an empty one.
    """
    templates = tuple((t, x, True) for t, x in base) + tuple((t, x, False) for t, x in notices)
    if any(len(t.split()) < GRAM for t, _, _ in templates):
        raise ValueError(f"a template needs {GRAM} words")
    grams = template_grams(docs.sparkSession, templates)
    if sum(len(t.split()) for t, _, _ in templates) <= BROADCAST_WORDS:
        grams = F.broadcast(grams)
    # each text has one more element, at -1 - n_words, so that texts without hits stay
    cut = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       words(F.col(text_col)).alias("words"))
           .select("row", "id", F.explode(F.concat(
               F.array(F.struct((-1 - F.size("words")).alias("at"), F.lit(None).cast("long").alias("hash"),
                                F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))),
               _grams("words"))).alias("g"))
           .select("row", "id", "g.at", "g.hash", "g.a", "g.b").where("at < 0 or b is not null"))
    hits = (cut.join(grams.select("template", "label", "base", "grams", "place", F.col("hash").alias("t_hash"),
                                  F.col("a").alias("t_a"), F.col("b").alias("t_b")),
                     F.col("hash") == F.col("t_hash"), "left")
            .where("at < 0 or (a = t_a and b = t_b)").repartition("row"))
    votes = (hits.groupBy("row", "id", "template", "label", "base", "grams",
                          F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") - F.col("place")).alias("diagonal"))
             .agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"),
                  F.collect_list("place").alias("places")))
    # a run has the neighbours of at most one diagonal that verifies alone ("sure"): a second one starts its own
    place = Window.partitionBy("row", "id", "template").orderBy("diagonal")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(place) > drift, F.lit(True)) | F.col("base")
    chain = Window.partitionBy("row", "id", "template", "chain").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    sure = ~F.col("base") & (F.col("votes") >= least * F.col("grams"))
    runs = (votes.where(F.col("template").isNull() | ~F.col("base") | (F.col("votes") >= F.col("grams")))
            .withColumn("sure", F.coalesce(sure, F.lit(False)))
            .withColumn("strong", F.col("sure") | (F.col("votes") >= F.greatest(F.lit(2), F.col("grams") / 5)))
            .withColumn("chain", F.sum(apart.cast("int")).over(upto))
            .withColumn("run", F.greatest(F.lit(1), F.sum(F.col("sure").cast("int")).over(chain))))
    # few votes far off can make a whole run too long: then its strong diagonals are merged, or the sure one is taken alone
    run = Window.partitionBy("row", "id", "template", "chain", "run")
    last_strong = F.last(F.when(F.col("strong"), F.col("diagonal")), True).over(
        run.orderBy("diagonal").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("strong") & F.coalesce(F.col("diagonal") - last_strong > drift, F.lit(True))
    part = Window.partitionBy("row", "id", "template", "chain", "run", "part", "strong")

    def whole(window):
        return ((F.sum("votes").over(window) >= least * F.col("grams"))
                & (F.max("high").over(window) + GRAM - F.min("low").over(window) <= 1.5 * (F.col("grams") + 1)))

    runs = (runs.withColumn("part", F.sum(gap.cast("int")).over(
                run.orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("level", F.when(F.col("template").isNull() | F.col("base") | whole(run), 0)
                        .when(F.col("strong") & whole(part), 1).when(F.col("sure"), 2))
            .where("level is not null")
            .withColumn("part", F.when(F.col("level") > 0, F.col("part"))))
    spans = (runs.groupBy("row", "id", "template", "label", "base", "grams", "chain", "run", "level", "part")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
                  F.min("low").alias("start"), F.max("high").alias("last")))
    coverage = F.col("votes") / F.col("grams")
    fits = F.col("base") | (coverage >= least)
    return spans.where(F.col("template").isNull() | fits).select(
        "row", "id", F.when(F.col("template").isNull(), -1 - F.col("start")).alias("n_words"), "label", "base",
        F.when(F.col("template").isNotNull(), F.col("start")).alias("start"),
        F.when(F.col("template").isNotNull(), F.col("last") + GRAM).alias("end"),
        F.when(F.col("template").isNotNull(), coverage).alias("coverage"))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best coverage; 0 without a match)."""
    spans = license_spans(docs, id_col=id_col, text_col=text_col, **options)

    def joined(keep):
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(keep, F.col("label")))))

    exact = F.coalesce(F.col("base"), F.lit(False))
    return spans.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        joined(exact).alias("base_labels"), joined(F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score")).drop("row").withColumnRenamed("id", id_col)
