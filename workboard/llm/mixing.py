"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash. A source takes whole rounds of all its documents and,
for the rest of its target, the documents whose hash is below the source's threshold.
The threshold is found level by level: words are summed by source and the next 10 bits
of the hash, a running sum over at most 1,024 buckets of a source shows in which bucket
the budget ends, and only the documents of that boundary bucket go on to the next level.
Nothing is sorted, the sums are combined before they are shuffled, and the levels after
the first see about a thousandth of the rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.common import free_name, materialize

WEIGHTS = (5.0, 2.0, 1.0)
BITS, LEVELS = 10, 6  # 60 bits of hash


def word_count(text_col: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def document_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the document's id and text; the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - BITS * LEVELS)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source: distinct, source_size) with a double column ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of
    all words; a target stops at ``most`` times its source, and the excess goes to the
    others by weight. That ends where target = min(cap, weight * level): in the order of
    cap / weight, the first source that its level doesn't fill sets the level. One row
    for each source goes through these windows, never one for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.withColumn("weight", F.get(pick, (F.row_number().over(order) - 1) % len(weights))).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn(
        "level", (F.lit(float(share)) * F.sum("source_size").over(everything)
                  - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    return levels.withColumn("at", level["level"]).select(
        "source", "source_size",
        F.when(F.col("at").isNull(), F.col("cap")).otherwise(
            F.least("cap", F.col("weight") * F.col("at"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: rounds (whole takes of all documents), limit and ties: documents
    whose hash is below the limit are taken once more, and so are ``ties`` of those whose
    hash is the limit (0 unless equal rows stand at the very boundary).

    ``sized`` (source, size, hash) should be a written table; ``goals`` is the result of
    targets().
    """
    goals = goals.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                             .otherwise(0).cast("long")).withColumn(
        "left", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = materialize(goals.select(F.col("source").alias("of"), "source_size", "target", "rounds", "left",
                                     F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("ties")), "budget")
    rows = sized.where("size > 0")
    running = (Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        open_ = rows.join(state.select("of", "prefix", "left"), F.col("source").eqNullSafe(F.col("of")))
        if level:
            open_ = open_.where(F.shiftrightunsigned("hash", shift + BITS) == F.col("prefix"))
            open_ = materialize(open_.select("source", "size", "hash", "of", "prefix", "left"), "boundary")
            rows = open_.select("source", "size", "hash")
        sums = (open_.withColumn("bucket", F.shiftrightunsigned("hash", shift)).groupBy("of", "left", "bucket")
                .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
        found = (sums.withColumn("upto", F.sum("words").over(running))
                 .where(F.col("upto") > F.col("left")).groupBy("of")
                 .agg(F.min(F.struct("bucket", "upto", "words", "rows")).alias("b")))
        # the last level's buckets are single hashes: of their equal rows so many come closest to the target
        rest = F.col("left") - F.col("b.upto") + F.col("b.words")
        state = state.join(found.withColumnRenamed("of", "bucket_of"), F.col("of").eqNullSafe(F.col("bucket_of")), "left")
        ties = F.lit(0) if level < LEVELS - 1 else F.coalesce(F.round(rest * F.col("b.rows") / F.col("b.words")), F.lit(0))
        first = F.lit(level == 0)
        state = materialize(state.select(
            "of", "source_size", "target", "rounds",
            F.when(F.col("b").isNull(), F.col("left")).otherwise(rest).alias("left"),
            F.when(F.col("b").isNotNull(), F.col("b.bucket") + F.when(ties >= F.col("b.rows"), 1).otherwise(0))
            .when(first, F.lit(1 << BITS)).otherwise((F.col("prefix") + 1) * (1 << BITS)).alias("prefix"),
            F.when(ties < F.col("b.rows"), ties).otherwise(0).cast("long").alias("ties")), "budget")
    return state.select(F.col("of").alias("source"), "source_size", "target", "rounds", F.col("prefix").alias("limit"), "ties")


def _limits(sized: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """Rounds, and limit and ties of what is taken once more (limit -1: nothing), by source (column ``of``)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = thresholds(sized, targets(sources, weights, share, most))
    more = (F.col("rounds") < most) & (F.col("target") > F.col("rounds") * F.col("source_size"))
    return materialize(limits.select(F.col("source").alias("of"), "source_size", "target", "rounds",
                                     F.when(more, F.col("limit")).otherwise(-1).alias("limit"),
                                     F.when(more, F.col("ties")).otherwise(0).alias("ties")), "limits")


def _with_copies(rows: DataFrame, limits: DataFrame, source: str, hashed: Column, names: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``limits`` (as ``names`` has them) and ``names["copies"]``.

    Equal rows at a boundary are told apart by where they stand in a written table: whole
    parts of it are taken until the next one would be too many, and only that part's rows
    are numbered. What is taken of equal rows is the same in every run."""
    n = names
    joined = rows.join(limits.withColumnsRenamed(n), F.col(source).eqNullSafe(F.col(n["of"])))
    below = joined.withColumn(n["copies"], F.col(n["rounds"]) + F.when(hashed < F.col(n["limit"]), 1).otherwise(0))
    if limits.where("ties > 0").isEmpty():
        return below
    tied = (F.col(n["ties"]) > 0) & (hashed == F.col(n["limit"]))
    part, at, before, here = (free_name(joined, x) for x in ("part", "at", "before", "here"))
    placed = materialize(joined.where(tied).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ties")
    earlier = Window.partitionBy(n["of"]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(n["of"], part).agg(F.count(F.lit(1)).alias(here))
             .withColumn(before, F.coalesce(F.sum(here).over(earlier), F.lit(0)))
             .withColumnsRenamed({n["of"]: f"{n['of']}_", part: f"{part}_"}))
    placed = placed.join(parts, F.col(n["of"]).eqNullSafe(F.col(f"{n['of']}_")) & (F.col(part) == F.col(f"{part}_")))
    cut = (F.col(before) < F.col(n["ties"])) & (F.col(before) + F.col(here) > F.col(n["ties"]))
    number = F.row_number().over(Window.partitionBy(n["of"], part).orderBy(at))
    some = placed.where(cut).withColumn(n["copies"], F.col(n["rounds"]) + F.when(
        number <= F.col(n["ties"]) - F.col(before), 1).otherwise(0))
    whole = placed.where(~cut).withColumn(n["copies"], F.col(n["rounds"]) + F.when(
        F.col(before) + F.col(here) <= F.col(n["ties"]), 1).otherwise(0))
    columns = below.columns
    return below.where(~tied).unionByName(some.select(*columns)).unionByName(whole.select(*columns))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies and
    taken (copies * size).

    Null and word-free texts have size 0 and are taken as often as any text of their
    hash. A null source is a source of its own, the last one. Of repeated rows, which share
    a hash, so many are taken once more as bring the source closest to its target. Reruns
    agree (on the multiset of rows). An empty table gives an empty table. Other columns are
    ignored.
    """
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size"), document_hash(id_col, text_col).alias("hash")),
                        "sized")
    names = {c: c for c in ("of", "source_size", "target", "rounds", "limit", "ties", "copies")}
    mixed = _with_copies(sized, _limits(sized, weights, share, most), "source", F.col("hash"), names)
    return mixed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, numbered from 1 in
    ``copy_col``. The thresholds are applied to the rows as they are read."""
    name = {x: free_name(docs, x) for x in ("of", "source_size", "target", "rounds", "limit", "ties", "copies")}
    sized = materialize(docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                                    document_hash(id_col, text_col).alias("hash")), "sized")
    taken = _with_copies(docs, _limits(sized, weights, share, most), source_col, document_hash(id_col, text_col), name)
    return (taken.where(F.col(name["copies"]) > 0)
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int"))).alias(copy_col)))
