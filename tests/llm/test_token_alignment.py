"""Two tokenizers over the same texts against one-text-at-a-time versions."""

import os
import random

import pytest

from tests.conftest import SF001
from tests.llm.brute_tokens import Plain, alignment, overlaps
from tests.llm.frames import DOCS, clashing, odd_docs
from workboard.llm import queries, token_alignment
from workboard.llm.queries import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZERS.bytes_json), reason="no tokenizer files")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    return Plain(TOKENIZERS.bytes_json, TOKENIZERS.pieces_model)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", " the", "é", "é", "1", "22", "!", "'s", "'ll", "東", "😀", "　", " ", "\x1c",
             "\x85", "\xa0", "▁", "<s>", "</s>", "<0x41>", "<|endoftext|>", "_", "..", "\x00", "​", "\r\n", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(300)]
    return texts + ["x" * 30_000, "ab" * 3000 + " end", " " * 5000, "\n", "word " * 2000, None, "", "▁"]


def test_query_equals_plain_version(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_token_alignment(spark, SF001)
    assert found.columns[:8] == list(COLUMNS)
    assert _sorted(found.select(*COLUMNS).collect()) == _sorted(alignment(docs, plain))


def test_odd_texts_in_small_batches(spark, plain):
    texts = odd_texts()
    rows = [(None if k % 50 == 7 else k // 2, x, None, None, None) for k, x in enumerate(texts)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(7))
    found = token_alignment.link_statistics(docs, TOKENIZERS, queries.PIECES, batch_bytes=400, aligned_bytes=90)
    assert _sorted(found.select(*COLUMNS).collect()) == _sorted(alignment([r[:2] for r in rows], plain))


def test_clashing_columns_empty_table_and_odd_rows(spark, plain):
    docs = odd_docs(spark)
    found = token_alignment.link_statistics(clashing(docs), TOKENIZERS, queries.PIECES).select(*COLUMNS)
    assert _sorted(found.collect()) == _sorted(alignment([(r.doc_id, r.text) for r in docs.collect()], plain))
    assert token_alignment.link_statistics(docs.limit(0), TOKENIZERS, queries.PIECES).count() == 0


def test_arrays(spark, plain):
    rows = [(k, x, None, None, None) for k, x in enumerate(odd_texts()[:60])]
    found = token_alignment.align_tokens(spark.createDataFrame(rows, DOCS).coalesce(1), TOKENIZERS).collect()
    assert len(found) == len(rows)
    for r in found:
        sides = plain.tokens(rows[r.doc_id][1]) or [[], []]
        assert list(zip(r.a_ids, r.a_ends)) == sides[0]
        assert list(zip(r.b_ids, r.b_ends)) == sides[1]
        pairs = list(zip(r.over_a, r.over_b))
        assert len(set(pairs)) == len(pairs)
        assert set(pairs) == overlaps(*sides)
        assert [r.a_ends[i] for i in r.link_a] == [r.b_ends[j] for j in r.link_b] == sorted(
            {e for _, e in sides[0]} & {e for _, e in sides[1]})


def test_words_are_learned_again(monkeypatch, plain):
    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 5)
    for k in range(0, 300, 20):
        texts = odd_texts()[k:k + 20]
        x = token_alignment.align([t.encode() for t in texts], TOKENIZERS)
        for d, row in enumerate(x.doc.tolist()):
            sides = plain.tokens(texts[row])
            assert [x.ids[s][x.of[s] == d].tolist() for s in (0, 1)] == [[i for i, _ in side] for side in sides]
