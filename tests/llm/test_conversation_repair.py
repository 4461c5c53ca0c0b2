"""Faults and cheapest repairs of conversations against a search per conversation."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.brute_repair import damage, repaired
from tests.llm.test_chat_format import TURNS
from workboard.llm import conversation_repair, queries, repair_grammar

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def odd_turns(seed=4, n=150):
    rng, rows = random.Random(seed), []
    texts = ["", " \t\n", None, "Yes.", "No!", "cut off", "What?", "end. \n", "a. ", " ", "?", "東京。", "x\x85"]
    for conv in [None, *range(n)]:
        for k in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "apple", "User", "\nu"])
            rows.append((conv, rng.choice([None, k, k, k, 2 * k]), role, rng.choice(texts)))
    return rows + [rows[3]] * 4


def test_query_equals_search(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").collect()]
    found = queries.op13_conversation_repair(spark, SF01)
    assert found.columns == COLUMNS
    assert by_id(found.collect()) == by_id(repaired(*damage(given)))


def test_odd_turns_in_small_segments(spark):
    given = odd_turns()
    rows = spark.createDataFrame(given, TURNS).selectExpr("*", "'x' AS key", "turn AS n", "'y' AS present_", "1 AS _copy", "0 AS at")
    for segment in (4096, 3, 1):
        found = conversation_repair.repair_conversations(conversation_repair.damaged(rows), segment)
        assert by_id(found.collect()) == by_id(repaired(*damage(given)))
    plain = conversation_repair.repair_conversations(rows.withColumn("present", F.lit(None).cast("boolean")), 2)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given]
    assert by_id(plain.collect()) == by_id(repaired(whole, list(dict.fromkeys(r[0] for r in given))))


def test_one_long_conversation_and_hot_copies(spark):
    rng = random.Random(9)
    given = [(5, k, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"no {k}", f"yes {k}.", ""])) for k in range(3000)]
    given += [(6, 1, "user", "same.")] * 2000 + [(6, 2, "user", "same.")] * 2000 + [(7, 0, "user", "x.")]
    found = conversation_repair.repair_conversations(spark.createDataFrame(given, TURNS), 100)
    assert by_id(found.collect()) == by_id(repaired(given, [5, 6, 7]))


def test_empty_table_and_absent_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair_conversations(empty).collect() == []
    gone = spark.createDataFrame([(1, 1, "user", "x.")], TURNS).withColumn("present", F.lit(False))
    assert by_id(conversation_repair.repair_conversations(gone).collect()) == by_id(repaired([], [1]))


def test_grammar_rebuilds_its_sequences():
    rng = random.Random(8)
    for _ in range(60):
        k = rng.randint(1, 4)
        given = [np.array([rng.randrange(k) for _ in range(rng.randint(0, 60))], dtype=np.int64) for _ in range(rng.randint(0, 9))]
        rules, short = repair_grammar.re_pair(given, k)

        def whole(symbol):
            return [symbol] if symbol < k else [x for part in rules[symbol - k] for x in whole(part)]

        assert [[x for s in line.tolist() for x in whole(s)] for line in short] == [x.tolist() for x in given]
        pairs = [p for line in short for p in zip(line.tolist(), line[1:].tolist()) if p[0] != p[1]]
        assert len(pairs) == len(set(pairs))


def test_ropes():
    rng = random.Random(2)
    for _ in range(300):
        def rope(text):
            if len(text) < 3 or rng.random() < 0.2:
                return text
            cut = rng.randint(1, len(text) - 1)
            return repair_grammar.Rope(rope(text[:cut]), rope(text[cut:]))
        a = "".join(rng.choice("DK") for _ in range(rng.randint(1, 40)))
        b = a[:rng.randint(0, len(a))] + "".join(rng.choice("DK") for _ in range(rng.randint(0, 4)))
        assert repair_grammar.text_of(rope(a)) == a
        assert repair_grammar.less(rope(a), rope(b)) == (a < b)
