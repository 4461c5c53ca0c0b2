"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the hashes (XXH64,
seed 42) of the text's word shingles. Two texts are linked if their fingerprints
differ in at most ``max_bits`` bits.

Covering masks: every bit position gets a non-zero vector of ``max_bits + 1`` bits;
the mask of a non-zero vector v keeps the positions whose vector has an odd inner
product with v. The vectors of up to ``max_bits`` differing positions span a space
of smaller dimension, so some v is orthogonal to all of them and its mask hides them
all: each pair within the radius has the same masked value in at least one of the
``2 ** (max_bits + 1) - 1`` tables. Nothing is missed and no probability is involved.

Hot groups: equal fingerprints are one node, whatever the number of copies. Of a
bucket, first every member is compared with the bucket's most frequent fingerprint
only; what that links is contracted. Then the members outside of a bucket's largest
component are joined with the bucket, for pairs between different components only.
That loses no link between components, and a bucket that is one component already
costs nothing more. A bucket in which that join would have over ``MOST_PAIRS`` pairs is
first cut by a covering family over the bits that its mask hides, and so on: pairs within
the radius still meet, other members part. Where a mask hides ``max_bits`` bits or fewer,
all members are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import free_name, materialize, text_bytes, with_package
from workboard.llm.components import connected_components

SEED = 42
#: A bucket is cut further rather than joined if that takes more pairs. No result depends on it.
MOST_PAIRS = 100_000


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text; 0 without words.

    bytes.split() and bytes.lower() know ASCII only: words are ``[^\\x20\\x09-\\x0D]+``
    and only A-Z are lower-cased.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).view(">i8")[0])


def fingerprint(text, shingle: int = 3):
    """Column of fingerprints for a binary text column (Arrow batches)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(x, shingle) for x in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType()).asNondeterministic()(text)


def covering_masks(max_bits: int, kept: int = 0) -> list[int]:
    """Signed 64-bit masks, one for each table: they keep the bits of ``kept`` and cover all others.
    The first vectors are a basis, so that each mask keeps more than ``kept`` if over ``max_bits`` are left."""
    size, kept = max_bits + 1, kept & (1 << 64) - 1
    hidden = [i for i in range(64) if not kept >> i & 1]
    order = sorted(range(1, 2 ** size), key=lambda v: (v.bit_count() > 1, v))
    vectors = {i: order[j % len(order)] for j, i in enumerate(hidden)}
    masks = {kept | sum(1 << i for i, m in vectors.items() if (m & v).bit_count() % 2): None for v in range(1, 2 ** size)}
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _close(a, b, max_bits):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _links_between(members: DataFrame, max_bits: int, most_pairs: int) -> DataFrame:
    """``members`` (mask, key: the bits that the mask keeps, fp, label) to pairs (a, b) of different labels
    that have a link in some bucket, enough to connect all labels that have one."""
    spark, found = members.sparkSession, None
    while True:
        sizes = members.groupBy("mask", "key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("mask", "key").agg(
            F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        mixed = sizes.where("labels > 1").select(
            "mask", "key", F.col("top.label").alias("main"), ((F.col("all") - F.col("top.n")) * F.col("all")).alias("work"))
        open_ = materialize(members.join(mixed, ["mask", "key"]), "open")
        same = 64 - F.bit_count("mask") <= max_bits  # whatever differs is within the radius
        small = open_.where(~same & (F.col("work") <= most_pairs))
        outside = small.where("label != main").select("mask", "key", F.col("fp").alias("fp_a"), F.col("label").alias("a"))
        inside = small.select("mask", "key", F.col("fp").alias("fp_b"), F.col("label").alias("b"))
        pairs = (outside.join(inside, ["mask", "key"]).where((F.col("a") != F.col("b")) & _close("fp_a", "fp_b", max_bits))
                 .select("a", "b"))
        pairs = pairs.unionByName(open_.where(same & (F.col("label") != F.col("main")))
                                  .select(F.col("label").alias("a"), F.col("main").alias("b")))
        found = pairs if found is None else found.unionByName(pairs)
        big = open_.where(~same & (F.col("work") > most_pairs))
        # masks there are few of: a power of the tables' number by the depth, which halves the hidden bits
        masks = [r[0] for r in big.select("mask").distinct().collect()]
        if not masks:
            return found
        finer = spark.createDataFrame([(m, x) for m in masks for x in covering_masks(max_bits, m)], "mask long, finer long")
        members = (big.select("mask", "fp", "label").join(F.broadcast(finer), "mask")
                   .select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp", "label"))


def fingerprint_components(nodes: DataFrame, max_bits: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``nodes`` (fp: distinct, n: copies) to (fp, label) for the fingerprints with links."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(x).cast("long")) for x in covering_masks(max_bits)])
    tables = nodes.select("fp", "n", F.posexplode(keys).alias("t", "key"))
    shared = (tables.groupBy("t", "key")
              .agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("n", "fp")).alias("top"))
              .where("members > 1").select("t", "key", F.col("top.fp").alias("pivot")))
    members = materialize(tables.join(shared, ["t", "key"]).select("t", "key", "fp", "pivot"), "members")
    first = connected_components(members.where((F.col("fp") != F.col("pivot")) & _close("fp", "pivot", max_bits))
                                 .select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    first = materialize(first, "labels")
    masks = F.array(*[F.lit(x).cast("long") for x in covering_masks(max_bits)])
    labelled = (members.join(first, members.fp == first.node, "left")
                .select(F.get(masks, F.col("t")).alias("mask"), "key", "fp", F.coalesce("label", "fp").alias("label")))
    pairs = _links_between(labelled, max_bits, most_pairs)
    second = connected_components(pairs).select(F.col("node").alias("label"), F.col("label").alias("root"))
    ends = first.select(F.col("node").alias("fp"), "label")
    alone = second.select(F.col("label").alias("fp"), "label").join(ends, "fp", "left_anti")
    return (ends.unionByName(alone).join(second, "label", "left")
            .select("fp", F.coalesce("root", "label").alias("label")))


def component_table(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` (id, fp) to one row per fingerprint: fp, component_id, and fp_first,
    the smallest fingerprint among the rows that carry that id."""
    nodes = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "nodes")
    labels = fingerprint_components(nodes.select("fp", "n"), max_bits)
    known = materialize(nodes.join(labels, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label")),
                        "known")
    heads = (known.groupBy("label")
             .agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("head"))
             .select("label", F.col("head.low").alias("component_id"), F.col("head.fp").alias("fp_first")))
    return materialize(known.join(heads, "label").select("fp", "component_id", "fp_first"), "components")


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, the row's own included.
    Null and word-free texts have fingerprint zero and link like any other. Rows that
    repeat an id stay as many rows; a null id takes part in links but is never a
    component's id (null only where no linked row has one). Texts are read whole.
    Other columns are ignored. An empty table gives an empty table.
    """
    with_package(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(text_bytes(text_col), shingle).alias("fp")),
                         "fingerprints")
    found = component_table(prints, max_bits)
    return prints.join(found, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id.

    A null id comes last; rows that repeat the id keep one row (the smallest
    fingerprint, then any of equal ones). All columns pass through.
    """
    with_package(docs.sparkSession)
    fp, ident = free_name(docs, "fp"), F.col(id_col)
    prints = materialize(docs.select(ident.alias("id"), fingerprint(text_bytes(text_col), shingle).alias("fp")),
                         "fingerprints")
    heads = (component_table(prints, max_bits).where("fp = fp_first")
             .select(F.col("component_id").alias("head_id"), F.col("fp").alias("head_fp")))
    marked = docs.withColumn(fp, fingerprint(text_bytes(text_col), shingle))
    kept = marked.join(heads, ident.eqNullSafe(F.col("head_id")) & (F.col(fp) == F.col("head_fp")), "left_semi")
    return kept.dropDuplicates([id_col, fp]).select(*docs.columns)
