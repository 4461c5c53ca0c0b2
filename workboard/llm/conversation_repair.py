"""Faults of conversations and their cheapest repair (``repair_grammar`` has the method).

Rows are dealt out in order, by ranges of (conversation, turn, role, text's hash), so that
a long conversation spreads over tasks. A task cuts its rows into segments, each of one
conversation, builds one grammar for about ``BATCH_SYMBOLS`` of them and puts out one
transfer matrix per segment; a conversation's edits come from the product of its segments.
Only then are the texts read again, in order, and hashed as a stream: SHA-256 takes a
conversation's text in sequence, hence in one task, which holds no more than a batch.

Rows are ordered by turn (null first), then by role and by the hash of role and text. Null
roles and texts are one space. An initial other than s, u or a (also of an empty role) is
never legal. Null conversation ids are one conversation; repeated rows are duplicates;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import materialize, with_package
from workboard.llm.repair_grammar import (ACCEPTING, CALLED, DELETE, INSERT, KEEP, KEPT, START, best, product, sequence_matrices,
                                          text_of)

SPACES = " \t\n\x0b\x0c\r"
#: Symbols of a segment at most, and about so many per grammar.
SEGMENT, BATCH_SYMBOLS = 4096, 1 << 17
LEGAL = {"su", "ua", "au"}
NAME_OF = {2: "user", 3: "assistant"}
_COUNTERS = ("blank", "duplicate", "truncated", "illegal", "turns")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the damage that the checksum of ``conv_id:turn`` (null:
    a space) calls for, modulo 20: 0 drops the row (it stays with ``present`` false), 1 empties its text,
    2 takes out its sentence ends, 3 repeats it, 4 makes its role user."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
                       (fate != 0).alias("present"),
                       F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
                       ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text, present and key, the hash of role and text (128 bits)."""
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
                       present.alias("present"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return rows.withColumn("key", F.substring(F.unhex(key), 1, 16))


def _units(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number n (0: only rows that aren't present), the symbol of the first
    of them, their initial, and whether the same role and text stands at an earlier turn."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = (F.when(body == "", "x").when(F.right(body, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial)))
    narrow = rows.select("conv_id", "turn", "role", "key", "present", initial.alias("initial"), symbol.alias("symbol"))
    units = narrow.groupBy("conv_id", "turn", "role", "key", "initial", "symbol").agg(
        F.sum(F.col("present").cast("long")).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))  # null turns stand first
    first = units.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(place).alias("first"))
    found = units.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    return found.select("conv_id", "turn", "role", "key", "initial", "symbol", "n",
                        F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"))


_MATRIX = pa.struct([("from", pa.int8()), ("to", pa.int8()), ("cost", pa.int64()), ("edits", pa.string())])
_ENTRY = T.StructType([T.StructField("from", T.ByteType()), T.StructField("to", T.ByteType()),
                       T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType())])


def _segments(units: DataFrame, segment: int) -> DataFrame:
    ordered = units.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key") \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key")
    id_type, turn_type = units.schema["conv_id"].dataType, units.schema["turn"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("at", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("rows", *_COUNTERS)],
                           T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
                           T.StructField("min_turn", turn_type), T.StructField("max_turn", turn_type),
                           T.StructField("matrix", T.ArrayType(_ENTRY))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at, done, waiting, now = TaskContext.get().partitionId() << 32, [], 0, None
        types: list[pa.DataType] = []

        def begun(conv) -> dict:
            return {"conv_id": conv, "symbols": [], "rows": 0, **dict.fromkeys(_COUNTERS, 0), "first": None, "last": None,
                    "min_turn": None, "max_turn": None}

        def evaluated() -> pa.RecordBatch:
            matrices = sequence_matrices(["".join(s["symbols"]) for s in done])
            columns = [pa.array([s[c] for s in done], types[0] if c == "conv_id" else pa.int64())
                       for c in ("conv_id", "at", "rows", *_COUNTERS)]
            columns += [pa.array([s[c] for s in done], pa.string()) for c in ("first", "last")]
            columns += [pa.array([s[c] for s in done], types[1]) for c in ("min_turn", "max_turn")]
            columns.append(pa.array([[{"from": i, "to": j, "cost": c, "edits": text_of(e)} for (i, j), (c, e) in m.items()]
                                     for m in matrices], pa.list_(_MATRIX)))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

        for batch in stream:
            types = [batch.column(0).type, batch.column(1).type]
            for conv, turn, initial, symbol, n, seen in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5, 6, 7))):
                if now is not None and now["conv_id"] != conv:
                    done.append({**now, "at": at})
                    at, waiting, now = at + 1, waiting + now["rows"] + 1, None
                    if waiting > BATCH_SYMBOLS:
                        yield evaluated()
                        done, waiting = [], 0
                now = now or begun(conv)
                left = n
                while left:
                    if now["rows"] >= segment:
                        done.append({**now, "at": at})
                        at, waiting, now = at + 1, waiting + now["rows"] + 1, begun(conv)
                        if waiting > BATCH_SYMBOLS:
                            yield evaluated()
                            done, waiting = [], 0
                    k = min(left, segment - now["rows"])
                    again = k - (left == n and not seen)  # of these, how many repeat an earlier row
                    if symbol == "x":
                        now["blank"] += k
                    else:
                        now["duplicate"] += again
                        now["truncated"] += symbol.isupper() * (k - again)
                    now["symbols"].append(symbol * (k - again) + "x" * again)
                    now["illegal"] += k - 1 + (now["last"] is not None and now["last"] + initial not in LEGAL)
                    now["first"], now["last"] = now["first"] or initial, initial
                    if turn is not None and turn != now["max_turn"]:
                        now["turns"] += 1
                        now["min_turn"] = turn if now["min_turn"] is None else now["min_turn"]
                        now["max_turn"] = turn
                    now["rows"] += k
                    left -= k
        if now is not None:
            done.append({**now, "at": at})
        if done:
            yield evaluated()

    return ordered.mapInArrow(run, schema)


def _conversations(segments: DataFrame) -> DataFrame:
    """One row per conversation from its segments in order: gaps, the counters, cost and audit."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([segments.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in names],
                           T.StructField("audit", T.StringType())])
    columns = segments.columns

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def rows_of(found: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
            ends = [best(s["matrix"]) for s in found]
            out = [pa.array([s["conv_id"] for s in found], id_type),
                   pa.array([0 if s["max_turn"] is None else int(s["max_turn"]) - int(s["min_turn"]) + 1 - s["turns"]
                             for s in found], pa.int64())]
            out += [pa.array([s[c] for s in found], pa.int64()) for c in names[1:5]]
            out += [pa.array([c for c, _ in ends], pa.int64()), pa.array([e for _, e in ends], pa.string())]
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

        for batch in stream:
            found = []
            for s in batch.to_pylist():
                s["matrix"] = {(e["from"], e["to"]): (e["cost"], e["edits"]) for e in s["matrix"]}
                if now is not None and now["conv_id"] == s["conv_id"]:
                    if s["rows"]:
                        s["illegal"] += now["last"] is not None and now["last"] + s["first"] not in LEGAL
                        s["turns"] -= s["min_turn"] is not None and s["min_turn"] == now["max_turn"]
                        now["matrix"] = product(now["matrix"], s["matrix"])
                        now["last"] = s["last"]
                        now["min_turn"] = s["min_turn"] if now["min_turn"] is None else now["min_turn"]
                        now["max_turn"] = now["max_turn"] if s["max_turn"] is None else s["max_turn"]
                        for c in _COUNTERS:
                            now[c] += s[c]
                else:
                    if now is not None:
                        found.append(now)
                    now = s
            if found:
                yield rows_of(found, batch.column(0).type)
        if now is not None:
            yield rows_of([now], batch.column(0).type)

    dealt = segments.select(*columns).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    return dealt.mapInArrow(run, schema)


def _repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The conversations with the hash of their repaired rows: each one's audit, then its rows, in order."""
    names = [f.name for f in conversations.schema.fields]
    heads = conversations.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("turn", "role", "text", "key")})
    both = (heads.withColumn("kind", F.lit(0)).unionByName(rows.where("present").drop("present").withColumn("kind", F.lit(1)),
                                                           allowMissingColumns=True)
            .select(*names, "kind", "turn", "role", "key", "text").repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "key"))
    schema = T.StructType([*conversations.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    n = len(names)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = walk = None
        for batch in stream:
            done = []
            kinds, roles, texts = (batch.column(c).to_pylist() for c in (n, n + 2, n + 4))
            heads = iter(batch.filter(pa.array([k == 0 for k in kinds])).select(names).to_pylist())
            for kind, role, text in zip(kinds, roles, texts):
                if kind:
                    walk.row(role, text)
                    continue
                if head is not None:
                    done.append({**head, "repaired_sha256": walk.finished()})
                head = next(heads)
                walk = _Walk(head["audit"])
            if done:
                yield table_of(done, batch.schema)
        if head is not None:
            yield table_of([{**head, "repaired_sha256": walk.finished()}], batch.schema)

    def table_of(done: list[dict], given: pa.Schema) -> pa.RecordBatch:
        fields = [given.field(c) for c in names] + [pa.field("repaired_sha256", pa.string())]
        return pa.RecordBatch.from_pylist(done, schema=pa.schema(fields))

    return both.mapInArrow(run, schema)


class _Walk:
    """Applies a conversation's edits to its rows as they come and hashes what results."""

    def __init__(self, audit: str):
        self.edits, self.state, self.hash, self.any = iter(audit), START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _call(self, text: str) -> None:
        self.state = CALLED[self.state]
        self._put(NAME_OF[self.state], text)

    def row(self, role: str, text: str) -> None:
        edit = next(self.edits)
        while edit == INSERT:
            self._call("")
            edit = next(self.edits)
        if edit == KEEP:
            self.state = KEPT[self.state, role[0]]
            self._put(role, text)
        elif edit != DELETE:
            self._call(text)

    def finished(self) -> str:
        for edit in self.edits:
            assert edit == INSERT, "an edit without a row"
            self._call("")
        assert self.state in ACCEPTING
        return self.hash.hexdigest()


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; rows whose column ``present`` is false only say that there is
    such a conversation) as one row per conversation: gaps, the counters blank, duplicate, truncated and
    illegal, the cost of the cheapest repair, its edits as ``audit`` (ties: least by ASCII), and
    repaired_sha256 of the repaired ``role:text``, joined by line feeds."""
    with_package(rows.sparkSession)
    keyed = _keyed(rows)
    conversations = materialize(_conversations(_segments(_units(keyed), segment)), "repair-audits")
    return _repaired(keyed, conversations)
