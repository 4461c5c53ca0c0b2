"""The registered queries of this subpackage: each applies its operator, with
production parameters, to its whole tables and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from workboard.llm import classifier, decontaminate, html_text, license_scan, mixing, pii, quality_rules, secret_scan, simhash
from workboard.llm import chat_format as chat
from workboard.llm import conversation_repair as repair
from workboard.llm import token_alignment as alignment
from workboard.llm import token_rollup as rollup
from workboard.llm.common import table
from workboard.session import scratch_path

#: The tokenizer files of the registered queries and the number of pieces of the second.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZERS = alignment.TokenizerPair(f"{TOKENIZER_DIR}/byte_bpe_50k.json", f"{TOKENIZER_DIR}/piece_bpe_32k.model")
PIECES = 32_000


def op1_license_scans(spark, d):
    return license_scan.license_labels(table(spark, d, "documents"))


def op2_html_extraction(spark, d):
    pages = html_text.extract_text(table(spark, d, "pages").select("page_id", "url", "html"), into="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secret_scans(spark, d):
    rules = secret_scan.RuleSet()
    base = len(secret_scan.BASE_RULES)
    found = secret_scan.scan_documents(table(spark, d, "documents"), rules=rules)

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("findings"), rules.kinds, base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("findings"), rules.kinds).alias("spans"))


def op4_mixing_sources(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark, d):
    judged = quality_rules.quality_rules(table(spark, d, "documents").select("doc_id", "text"), into="quality")
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                             "n_repeat_words", "base_failed", "kept", "n_covered")])


def op6_pii(spark, d):
    found = pii.pii_by_document(table(spark, d, "documents"))

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spans(kept):
        return F.concat_ws(",", F.transform(kept, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    return found.select("doc_id", *[count(k.name) for k in pii.BASE_KINDS],
                        F.sha2(spans(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
                        spans(F.col("found")).alias("spans"))


def op7_quality_classifier(spark, d):
    return classifier.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_token_counts(spark, d):
    """All documents go in; those labelled toxic are deleted; those of low quality are
    revised to texts without their symbols; and each batch is sent twice."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    labels = labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    cleaned = docs.withColumn("text", F.regexp_replace("text", "[#*$%&|<>!]", ""))
    totals = rollup.TokenRollup(spark, scratch_path(spark, "llm/token-rollup"))
    for batch, rows, op, only in (("load", docs, rollup.INSERT, None),
                                  ("toxic", docs, rollup.DELETE, labels.where("toxic = 1")),
                                  ("cleaned", cleaned, rollup.REVISE, labels.where("quality = 0 and toxic = 0"))):
        for _ in range(2):
            totals.commit(batch, rollup.changes_of(rows, op), only)
    return totals.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"),
                                  F.col("tokens").alias("n_tokens"), F.col("chars").alias("n_chars"))


def op9_benchmark_decontamination(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op10_simhash_near_dedup(spark, d):
    return simhash.simhash_near_duplicates(table(spark, d, "documents"))


#: A conversation whose texts are made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(added), TOKENIZERS.bytes_json), arranged=True)


def op12_token_alignment(spark, d):
    found = alignment.link_statistics(table(spark, d, "documents"), TOKENIZERS, PIECES)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13_conversation_repair(spark, d):
    return repair.repair_conversations(repair.damaged(table(spark, d, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_license_scans, op2_html_extraction, op3_secret_scans, op4_mixing_sources, op5_quality_rules, op6_pii,
    op7_quality_classifier, op8_token_counts, op9_benchmark_decontamination, op10_simhash_near_dedup,
    op11_chat_formatting, op12_token_alignment, op13_conversation_repair)}
