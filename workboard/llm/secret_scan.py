"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of a file is a row; its text is addressed by SHA-256, so a text that
stands at many paths or comes back in a later version is one blob. The ledger is a
Parquet folder with one sub-folder for each committed batch and one row for each
scanned pair of blob and rule version, with the findings. A batch scans only pairs
that no other batch has, and findings are joined back to all paths by address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import content_key, free_name, materialize, text_bytes, with_package
from workboard.session import scratch_path

# The base kinds in their order, pattern, smallest size, and the group that is measured.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
# Kinds of this library, after the base ones. A pem key goes from the last mark before its END mark to that one, whatever
# stands between. Repeats have no upper bounds; possessive ones end at marks, so no run is read twice.
_PEM = r"[A-Z ]*PRIVATE KEY-----"
MORE_RULES = (
    ("pem", rf"-----BEGIN {_PEM}(?:[^-]++|-(?!----(?:BEGIN|END) {_PEM}))*+-----END {_PEM}", 0, 0),
    ("github", r"(?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("urlauth", r"://[^\s:/@]++:([^\s:/@]{3,}+)@", 0, 1),
)


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order of their kinds; ``version`` names the set in the ledger."""
    version: str = "3"
    rules: tuple = field(default=BASE_RULES + MORE_RULES)

    @property
    def kinds(self) -> list[str]:
        return [x[0] for x in self.rules]


_FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
                                      T.StructField("end", T.IntegerType())]))
_KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE)


def find_secrets(text: str, rules: tuple) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted. Per kind leftmost matches that
    don't overlap; one that is too short is dropped after it has matched."""
    found = []
    for number, (kind, pattern, least, group) in enumerate(rules):
        if kind == "assign":
            if not _KEYWORDS.search(text):
                continue
            pattern = f"(?i:{pattern})"
        elif kind == "hex":  # runs are maximal, so the shorter ones needn't be matched at all
            pattern = f"[0-9a-f]{{{least},}}"
        for m in re.finditer(pattern, text, re.ASCII):
            low, high = m.span(group)
            if high - low >= least:
                found.append((*(m.span() if kind != "urlauth" else m.span(group)), number))
    return sorted((a, n, b) for a, b, n in found)


def scan(blobs: DataFrame, rules: RuleSet) -> DataFrame:
    """``blobs`` (blob, text) to (blob, rule_version, findings)."""
    with_package(blobs.sparkSession)
    schema = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()),
                           T.StructField("findings", _FINDINGS)])
    arrow = pa.schema([("blob", pa.string()), ("rule_version", pa.string()),
                       ("findings", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            findings = [[dict(zip(("start", "kind", "end"), x))
                         for x in find_secrets(t.as_py().decode("utf-8", "replace"), rules.rules)]
                        for t in batch.column("text")]
            blob = batch.column("blob").cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [blob, pa.array([rules.version] * batch.num_rows, pa.string()), pa.array(findings, arrow.field(2).type)],
                schema=arrow)

    return blobs.select("blob", "text").mapInArrow(run, schema)


class BlobLedger:
    """The ledger in the folder ``path`` (on a cluster a shared one)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def findings(self, version: str, found_only: bool = False) -> DataFrame | None:
        """(blob, findings) of a rule version, one row for each blob (with ``found_only`` for
        each that has findings), or None without a ledger. Written as a table of its own:
        a join with it then reads plain shuffles, which Spark can split at hot blobs."""
        rows = self._read()
        if rows is None:
            return None
        rows = rows.where((F.col("rule_version") == version) & ((F.size("findings") > 0) | F.lit(not found_only)))
        return materialize(rows.groupBy("blob").agg(F.first("findings").alias("findings")), "findings")

    def commit(self, batch: str, docs: DataFrame, rules: RuleSet = RuleSet(), text_col: str = "text") -> DataFrame:
        """Scan the unseen pairs of ``docs`` and append them as ``batch``.

        A batch that is run again replaces its own folder, so a retry changes nothing.
        Copies are gathered to one text for each blob with map-side combine before the
        ledger is asked, so a much-copied text is no hot key. Batches that were
        committed at the same time may hold a pair twice; readers take it once.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch name has letters, digits, _ and - only")
        blobs = (docs.select(content_key(text_col).alias("blob"), text_bytes(text_col).alias("text"))
                 .groupBy("blob").agg(F.first("text").alias("text")))
        old = self._read()
        if old is not None:
            seen = (old.where((F.col("rule_version") == rules.version) & (F.col("batch").cast("string") != batch))
                    .select("blob").distinct())
            blobs = blobs.join(seen, "blob", "left_anti")
        out = f"{self.path}/batch={batch}"
        scan(blobs, rules).write.mode("overwrite").option("compression", "zstd").parquet(out)
        return self.spark.read.parquet(out)

    def at_paths(self, docs: DataFrame, rules: RuleSet = RuleSet(), text_col: str = "text",
                 into: str = "findings") -> DataFrame:
        """``docs`` with an array column ``into`` of the findings of each row's text
        (start, kind number, end; null where the text was never scanned)."""
        key, found = free_name(docs, "blob"), self.findings(rules.version)
        if found is None:
            return docs.withColumn(into, F.lit(None).cast(_FINDINGS))
        found = found.select(F.col("blob").alias(key), F.col("findings").alias(into))
        return docs.withColumn(key, content_key(text_col)).join(found, key, "left").select(*docs.columns, into)


def span_text(findings: Column, kinds: list[str], only: int | None = None) -> Column:
    """kind:start:end of the findings (of the first ``only`` kinds), comma-joined."""
    names = F.array(*[F.lit(x) for x in kinds])
    kept = findings if only is None else F.filter(findings, lambda x: x["kind"] < only)
    return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan_documents(docs: DataFrame, ledger_path: str | None = None, batch: str = "all", rules: RuleSet = RuleSet(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Commit ``docs`` as a batch of the ledger (a new one in the shared folder by
    default) and return id and findings for every row.

    Null texts are the empty blob, without findings. Repeated rows and ids stay as
    they are; an empty table commits an empty batch.
    """
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_path or scratch_path(spark, "llm/blob-ledger"))
    ledger.commit(batch, docs, rules, text_col)
    found = ledger.findings(rules.version, found_only=True)
    return (docs.select(F.col(id_col).alias("id"), content_key(text_col).alias("blob")).join(found, "blob", "left")
            .select(F.col("id").alias(id_col), F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings")))


def _marked(mark: str):
    """A function of text, sorted starts and ends: the text with a mark for each run of overlapping
    spans, in one pass over the text. Texts without spans are not sent (null)."""
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, first, last in zip(texts, starts, ends):
            if text is None:
                out.append(None)
                continue
            pieces, at = [], None
            for a, b in zip(first, last):
                if at is not None and a < at:
                    at = max(at, b)
                    continue
                pieces += [text[at or 0:a], mark]
                at = b
            out.append("".join([*pieces, text[at:]]))
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "ends": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())


def redact_secrets(docs: DataFrame, ledger_path: str | None = None, batch: str = "all", rules: RuleSet = RuleSet(),
                   text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with every found span replaced by ``mark``; overlapping
    spans are replaced together. ``chars_col``, if there is one, is counted anew where
    the text changed."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_path or scratch_path(spark, "llm/blob-ledger"))
    ledger.commit(batch, docs, rules, text_col)
    found, key = free_name(docs, "findings"), free_name(docs, "blob")
    spans = ledger.findings(rules.version, found_only=True).select(F.col("blob").alias(key), F.col("findings").alias(found))
    rows = docs.withColumn(key, content_key(text_col)).join(spans, key, "left").drop(key)
    text, changed = F.col(text_col), F.size(found) > 0
    with_package(spark)
    new = free_name(rows, "redacted")
    rows = rows.withColumn(new, _marked(mark)(F.when(changed, text.cast("string")), F.transform(found, lambda x: x["start"]),
                                              F.transform(found, lambda x: x["end"])))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    if chars_col in out:
        out[chars_col] = F.when(changed, F.length(new).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    out[text_col] = F.when(changed, F.col(new)).otherwise(text)
    return rows.select(*[x.alias(c) for c, x in out.items()])
