"""The pipeline's stages and rows against brute force."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.llm import brute, frames
from workboard.llm import mixing, quality_rules, secret_scan


def plain_pipeline(spark, docs, items):
    """docs: rows of (id, text, lang, source, n_chars) -> those that reach the mix."""
    import pandas as pd
    kept = quality_rules.measure(pd.Series([(d[1] or "").encode() for d in docs]))["kept"]
    docs = [d for d, k in zip(docs, kept) if k]
    assert not any(brute.quality(d[1])[-1] for d in docs)
    groups = defaultdict(list)
    for d, fp, group in zip(docs, *brute.groups([d[:2] for d in docs])):
        groups[group].append((d[0] is None, d[0], fp - (1 << 64) if fp >> 63 else fp, d))
    docs = [min(g, key=lambda x: x[:3])[3] for g in groups.values()]
    hit = brute.contamination([d[:2] for d in docs], items)
    docs = [d for d, h in zip(docs, hit) if not h[-1]]
    out, rules = [], secret_scan.RuleSet().rules
    for d in docs:
        text, at, parts = d[1], 0, []
        for a, _, b in secret_scan.find_secrets(text, rules):
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        if parts:
            text = "".join(parts) + text[at:]
            d = (d[0], text, d[2], d[3], len(text))
        out.append(d)
    return out


@pytest.fixture(scope="module", params=["tables", "odd", "empty"])
def folder(request, spark, tmp_path_factory):
    if request.param == "tables":
        return SF001
    root, docs, items = str(tmp_path_factory.mktemp("pipeline")), frames.odd_docs(spark), frames.items(spark)
    if request.param == "empty":
        docs, items = docs.limit(0), items.limit(0)
    docs.write.parquet(f"{root}/documents.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    return root


def test_rows(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain_pipeline(spark, docs, items)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    copies = defaultdict(list)
    for r in got.collect():
        copies[tuple(r)[:5]].append(r["copy"])
    assert set(copies) <= set(want)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in want:
        n = len(brute.SPACE_WORD.findall(d[1] or ""))
        sizes[d[3]] += n
        most[d[3]] = max(most[d[3]], n)
        taken[d[3]] += n * len(copies.get(d, ()))
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= most[source]


def test_stages_keep_columns_and_extra_ones(spark, tmp_path):
    docs = frames.clashing(frames.odd_docs(spark))
    frames.items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path))
        assert rows.columns == docs.columns + ["copy"] * (name == "mixing_sources"), name
        assert rows.count() > 0
        assert all(r["_key"] == "extra _key" for r in rows.select("_key").collect())


def test_each_stage_on_its_own(spark):
    docs = frames.odd_docs(spark)
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    ids = sorted((i is None, i) for (i,) in one.select("doc_id").collect())
    rows = [r[:2] for r in frames.odd_rows()]
    heads = {(g, c) for g, (_, _, c) in zip(brute.groups(rows)[1], brute.components(rows))}
    assert [i for none, i in ids if not none] == sorted(c for _, c in heads if c is not None)
    clean = corpus_pipeline.without_secrets(spark, docs, "")
    assert clean.count() == docs.count()
    changed = clean.select("doc_id", F.col("text").alias("new")).join(docs, "doc_id").where("text != new")
    assert {r["doc_id"] for r in changed.collect()} - {15} == {16}
    assert mixing.take_mix(docs.limit(0)).count() == 0
