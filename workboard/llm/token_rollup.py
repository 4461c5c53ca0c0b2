"""Token counts as delta-maintained rollups.

The log has a signed row for each document that a batch put in or took out, with its
counts under each tokenizer version. Each batch also leaves its delta: the sums of its
signed rows by source, language and tokenizer. Totals are sums of deltas, so they are
never counted again from the texts. A delete, or the old side of a revision, takes out
what the log has for the id: its net counts over all committed batches.

A batch is committed by a marker that is created, if there is none, after its log and its
delta are written; whether they have rows is no matter. Readers count the batches that
have one. A batch that is committed is skipped when it is run again; one that broke off
anywhere before its marker is written anew, and nothing of it was counted.

The log of a batch is cut by a hash of the id into ``SHARDS`` folders. A delete or a
revision reads the shards of its ids, and a hot id's rows are spread over several files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import with_package
from workboard.sources.files import FileExists, names_in, write_record

Tokenizer = Callable[[Column], Column]


def pattern_tokens(separators: str) -> Tokenizer:
    """Counts the words between runs of the characters of a regular-expression class."""
    def count(text: Column) -> Column:
        return F.size(F.array_remove(F.split(text, separators), "")).cast("long")
    return count


def bpe_tokens(path: str, pattern: str) -> Tokenizer:
    """Counts tokens of a byte-pair vocabulary (a file of base64 tokens and ranks that
    every executor can read at ``path``). Texts are encoded whole, in Arrow batches; each
    Python worker reads the file once."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(x)) for x in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(run, T.LongType())(text)


#: Tokenizer versions of the registered query.
TOKENIZERS: dict[str, Tokenizer] = {
    "space-1": pattern_tokens(r"[\x20\x09-\x0D]+"),
    "plain-1": pattern_tokens(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
}
INSERT, DELETE, REVISE = "insert", "delete", "revise"
#: Folders of a batch's log, and files of one of them at most.
SHARDS, SPREAD = 64, 4
_SUMS = ("docs", "tokens", "chars")


class TokenRollup:
    """Log and deltas in the folder ``path`` (on a cluster a shared one)."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, Tokenizer] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tokenizers = TOKENIZERS if tokenizers is None else tokenizers

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        return sorted(names_in(self.spark, f"{self.path}/commits"))

    def _read(self, name: str, batches: list[str]) -> DataFrame | None:
        if not batches:
            return None
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(
                *[f"{self.path}/{name}/batch={b}" for b in batches])
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return None  # batches without a row

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int").alias("shard")

    def _counted(self, docs: DataFrame, only: DataFrame | None) -> DataFrame:
        """Rows by tokenizer, of the ids in ``only``. Texts are counted where they are read
        and never shuffled: the ids are joined with the counts. (An inner join: Spark would
        push a semi join below the counting.)"""
        with_package(self.spark)
        text = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        counted = text.select("id", "source", "lang", F.length("text").cast("long").alias("chars"),
                              *[count(F.col("text")).alias(f"t{i}") for i, count in enumerate(self.tokenizers.values())])
        if only is not None:
            counted = counted.join(only, "id")
        each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("tokens"))
                         for i, name in enumerate(self.tokenizers)])
        return counted.select("id", "source", "lang", "chars", F.explode(each).alias("c")).select(
            "id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("docs"),
            F.col("c.tokens").alias("tokens"), "chars")

    def commit(self, batch: str, changes: DataFrame, only: DataFrame | None = None) -> bool:
        """Apply ``changes`` (op: insert, delete or revise; id, source, lang, text), of the
        ids in the column id of ``only`` if it is given; False if ``batch`` was committed
        before.

        Inserts add, whether the id is known or not. Deletes and revisions take out all
        that the log has for the id, under every tokenizer; unknown ids take out nothing.
        Repeated deletes or revisions of an id in one batch take it out once; repeated
        revisions each put their text in. Other operations raise. A null id can be put in,
        not taken out; null sources and languages are groups of their own; null texts have
        no tokens.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch name has letters, digits, _ and - only")
        done = self.committed()
        if batch in done:
            return False
        known = F.col("op").isin(INSERT, DELETE, REVISE)
        op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))
        changes = changes.select(op.alias("op"), "id", "source", "lang", "text")
        only = only if only is None else only.select("id").where("id is not null").distinct()
        rows = self._counted(changes.where(F.col("op") != DELETE).drop("op"), only)
        log = self._read("log", done)
        if log is not None:
            gone = changes.where(F.col("op") != INSERT).select("id").where("id is not null").distinct()
            gone = gone if only is None else gone.join(only, "id")
            shards = [r[0] for r in gone.select(self._shard()).distinct().collect()]  # SHARDS at most
            net = (log.where(F.col("shard").isin(shards)).join(gone, "id", "left_semi")
                   .groupBy("id", "source", "lang", "tokenizer")
                   .agg(*[F.sum(c).alias(c) for c in _SUMS]).where("docs != 0 or tokens != 0"))
            rows = rows.unionByName(net.select("id", "source", "lang", "tokenizer", *[(-F.col(c)).alias(c) for c in _SUMS]))
        here = f"{self.path}/log/batch={batch}"
        self._write_log(rows, here)
        delta = self._read("log", [batch])
        delta = rows.where(F.lit(False)) if delta is None else delta  # nothing was put in or taken out
        (delta.groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in _SUMS])
         .write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}"))
        return self._mark(batch)

    def _write_log(self, rows: DataFrame, folder: str) -> None:
        spread = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
        (rows.select("*", self._shard(), spread.alias("_spread")).repartition("shard", "_spread").drop("_spread")
         .write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(folder))

    def _mark(self, batch: str) -> bool:
        try:
            write_record(self.spark, f"{self.path}/commits/{batch}", batch)
        except FileExists:  # another driver was first
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars; groups without documents are left out."""
        done = self.committed()
        if not done:
            raise ValueError(f"nothing is committed in {self.path}")
        return (self._read("deltas", done).groupBy("source", "lang", "tokenizer")
                .agg(*[F.sum(c).alias(c) for c in _SUMS]).where("docs != 0"))

    def compact(self, into: str) -> "TokenRollup":
        """A rollup in the folder ``into`` with one batch, ``base``, of this one's net rows."""
        small, log = TokenRollup(self.spark, into, self.tokenizers), self._read("log", self.committed())
        if log is not None:
            net = (log.groupBy("id", "source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("docs != 0"))
            small._write_log(net, f"{small.path}/log/batch=base")
        else:
            small._write_log(self.totals().where(F.lit(False)).withColumn("id", F.lit(None).cast("long")), f"{small.path}/log/batch=base")
        self.totals().write.mode("overwrite").parquet(f"{small.path}/deltas/batch=base")
        small._mark("base")
        return small


def changes_of(docs: DataFrame, op: str, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
               text_col: str = "text") -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
