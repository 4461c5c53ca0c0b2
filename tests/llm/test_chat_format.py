"""Rendered conversations: read back exactly, masks against a character-by-character version."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from tests.conftest import SF001
from workboard.llm import chat_format as chat
from workboard.llm import oracle, queries
from workboard.llm.queries import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZERS.bytes_json), reason="no tokenizer files")
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", "\\", "\\\\", "<", "[", "<<SYS>>", "<</SYS>>", "[ROLE]x[TEXT]", "[/ROLE]",
         "<|endoftext|>", " ", "\n", "ok", "naïve", "東京", "😀", "é", "\x00", "　", "[/INS", "T]", "</", "s>"]


def odd_turns(n=60):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "tool", "", "a</s>b", "x\\"])
            text = rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12)))])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3]), role, text))
    rows += [(77, 1, "assistant", "y" * 20_000), (77, 1, "assistant", "y" * 20_000), (77, 2, "user", " " * 5000)]
    return rows + [(78, k, "user" if k % 2 else "assistant", f"turn {k} <s>") for k in range(3000)]


def in_duckdb(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(oracle.CHAT).fetchall(), key=str)


def test_odd_turns_equal_sql(spark, tmp_path):
    rows = odd_turns()
    spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS part", "'x' AS formatted", "turn AS loss").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.op11_chat_formatting(spark, str(tmp_path)).collect()), key=str) == in_duckdb(rows)


def test_small_parts_give_the_same(spark, tmp_path):
    rows = odd_turns()
    parts = chat.format_conversations(spark.createDataFrame(rows, TURNS), TOKENIZERS.bytes_json, part_chars=40)
    parts.write.parquet(f"{tmp_path}/parts")
    written = spark.read.parquet(f"{tmp_path}/parts")
    assert written.where("conv_id = 78").count() > 300
    want = [r for r in in_duckdb(rows) if r[0] != -7]
    assert sorted(map(tuple, chat.read_back(written.repartition(9)).collect()), key=str) == want
    assert sorted(map(tuple, chat.read_back(parts, arranged=True).collect()), key=str) == want


def test_tokens_and_masks(spark):
    encoder = chat.OffsetEncoder(TOKENIZERS.bytes_json, chat.ChatTemplate().controls)
    rows = spark.createDataFrame(odd_turns(25), TURNS)
    whole = {r.conv_id: r for r in chat.format_conversations(rows, TOKENIZERS.bytes_json).collect()}
    cut = {}
    for r in chat.format_conversations(rows, TOKENIZERS.bytes_json, part_chars=30).orderBy("conv_id", "part").collect():
        cut.setdefault(r.conv_id, []).append(r)
    for conv, r in whole.items():
        e = encoder.bpe.exact.encode(r.formatted, add_special_tokens=False)
        assert r.token_ids == e.ids
        under = np.zeros(len(r.formatted), dtype=bool)
        for s in r.loss_spans:
            under[s.start:s.end] = True
        assert r.loss == [bool(under[a:b].any()) for a, b in e.offsets]
        assert [x for p in cut[conv] for x in p.token_ids] == r.token_ids  # parts are cut where tokens end
        assert [x for p in cut[conv] for x in p.loss] == r.loss
        assert not any(i >= 50256 and m for i, m in zip(r.token_ids, r.loss))


def test_masked_by_binary_search():
    start, end = np.array([0, 3, 3, 5, 9]), np.array([3, 5, 5, 9, 10])
    loss, held = chat.masked([(1, 2), (4, 4), (4, 6), (9, 10)], start, end)
    assert loss.tolist() == [True, True, True, True, True] and held == [(1, 2), (4, 6), (9, 10)]
    assert chat.masked([], start, end)[0].tolist() == [False] * 5


def test_template():
    t = chat.ChatTemplate()
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "\\"]),
                  "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        assert list(t.turns("".join("".join(t.rendered(*x)) for x in turns))) == turns
    with pytest.raises(ValueError):
        chat.ChatTemplate(roles=(("user", "<u>", "</u>"), ("assistant", "<u><a>", "</a>")))


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.format_conversations(empty, TOKENIZERS.bytes_json)).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF001}/conversations.parquet'")
    want = sorted(con.execute(oracle.CHAT).fetchall())
    assert sorted(map(tuple, queries.op11_chat_formatting(spark, SF001).collect())) == want
