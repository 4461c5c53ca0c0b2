"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered into one string: each text stands between the
control strings of its role, and control strings inside texts are escaped so that they
can be read back. The string is encoded once, with character offsets; the sorted spans
of the turns under the loss are intersected with the token spans by binary search.

A conversation is rendered by one task, in the order of its turns, as a stream: it is
put out in parts of about ``part_chars`` characters, cut between turns. No token reaches
over a control string, so the parts' tokens are those of the whole string. A task holds
one part, or one longer text, however long the conversation is.

Rows are ordered by turn (null first), then role and text. Null texts and roles are
empty ones. Null conversation ids are one conversation. Repeated rows are turns of their
own, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import with_package
from workboard.llm.token_alignment import LONG_WORD, ByteBpe

PART_CHARS = 1 << 20


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings around a text, by role; a role without its own gets ``other``, with its
    name between the first two. ``reserved`` strings are escaped as well (the tokenizer's own).

    In texts a control string gets an ``escape`` after its first character, and an ``escape``
    that stands there already is doubled; a single one is thus always the template's."""
    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    reserved: tuple[str, ...] = ("<|endoftext|>",)
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = tuple(dict.fromkeys([x for r in self.roles for x in r[1:]] + list(self.other)))
        every = controls + self.reserved
        if len(self.escape) != 1 or any(self.escape in c or len(c) < 2 for c in every):
            raise ValueError("the escape is one character, and no control string has it or is shorter than two")
        for c in every:
            for k in every:
                if c != k and k in c or any(k.startswith(c[i:]) for i in range(1, len(c))):
                    raise ValueError(f"{c!r} and {k!r} could overlap")
        object.__setattr__(self, "controls", controls)

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for c in (*self.controls, *self.reserved):
            text = text.replace(c, c[0] + self.escape + c[1:])
        return text

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text) if self.escape in text else text

    def rendered(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text, the escaped text, what stands behind."""
        for name, begin, end in self.roles:
            if role == name:
                return begin, self.escaped(text), end
        begin, middle, end = self.other
        return begin + self.escaped(role) + middle, self.escaped(text), end

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of every turn of a rendered string."""
        pieces = re.split("(" + "|".join(map(re.escape, self.controls)) + ")", formatted)
        begins, k = {begin: name for name, begin, _ in self.roles}, 1
        while k < len(pieces):
            if pieces[k] == self.other[0]:
                yield self.unescaped(pieces[k + 1]), self.unescaped(pieces[k + 3])
                k += 6
            else:
                yield begins[pieces[k]], self.unescaped(pieces[k + 1])
                k += 4


class OffsetEncoder:
    """Token ids and character spans of rendered strings; each control string is a token of its own."""

    def __init__(self, path: str, controls: tuple[str, ...]):
        from tokenizers import AddedToken
        self.bpe = ByteBpe(path)
        self.bpe.exact.encode_special_tokens = False
        self.bpe.exact.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in controls])
        control_ids = {c: self.bpe.exact.token_to_id(c) for c in controls}
        self.size = np.zeros(max([*self.bpe.entry, *control_ids.values()]) + 1, dtype=np.int64)
        for i, b in [*self.bpe.entry.items(), *((i, c.encode()) for c, i in control_ids.items())]:
            self.size[i] = len(b)
        if self.bpe.by_rank:
            import tiktoken

            from workboard.llm.token_alignment import SPLIT
            self.fast = tiktoken.Encoding("controls", pat_str=SPLIT, special_tokens=control_ids,
                                          mergeable_ranks={b: i for i, b in self.bpe.entry.items()})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        edges = np.flatnonzero(np.diff(raw <= 32, prepend=False, append=True))
        if not self.bpe.by_rank or np.diff(edges, prepend=0).max(initial=0) > LONG_WORD:
            e = self.bpe.exact.encode(text, add_special_tokens=False)
            spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            return np.array(e.ids, dtype=np.int32), spans[:, 0], spans[:, 1]
        ids = np.array(self.fast.encode(text, allowed_special="all"), dtype=np.int32)
        ends = np.cumsum(self.size[ids])
        # a token that is part of a character has the whole character's span
        char = np.append(np.cumsum((raw & 0xC0) != 0x80), 0)
        first, last = ends - self.size[ids], ends - 1
        return ids, char[first] - 1, char[last]


@lru_cache(maxsize=4)
def _encoder(path: str, controls: tuple[str, ...]) -> OffsetEncoder:
    return OffsetEncoder(path, controls)


def masked(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch one of the sorted ``spans``, and the characters of each span that tokens hold."""
    s, e = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    lo, hi = np.searchsorted(end, s, side="right"), np.searchsorted(start, e, side="left")
    edge = np.zeros(len(start) + 1, dtype=np.int64)
    held = (hi > lo) & (e > s)
    np.add.at(edge, lo[held], 1)
    np.add.at(edge, hi[held], -1)
    return np.cumsum(edge[:-1]) > 0, [(max(int(start[a]), x), min(int(end[b - 1]), y))
                                      for a, b, x, y, k in zip(lo, hi, s.tolist(), e.tolist(), held) if k]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def format_conversations(rows: DataFrame, tokenizer: str, template: ChatTemplate = ChatTemplate(),
                         loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as conv_id, part (from 0), formatted (string), token_ids,
    loss (per token whether it touches a text of ``loss_roles``) and loss_spans (the characters of each
    such text, as ``start`` and ``end`` in ``formatted``). ``tokenizer`` is a byte-level BPE file that
    every executor can read. The parts of a conversation stand together, in order, in one partition."""
    turns = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([turns.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("formatted", T.StringType()),
                           T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("loss", T.ArrayType(T.BooleanType())), T.StructField("loss_spans", T.ArrayType(SPAN))])
    with_package(rows.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, template.controls)
        pieces, spans, size, part, now = [], [], 0, 0, None

        def done(conv) -> dict:
            formatted = "".join(pieces)
            ids, start, end = encoder.encode(formatted)
            loss, held = masked(spans, start, end)
            return {"conv_id": conv, "part": part, "formatted": formatted, "token_ids": ids, "loss": loss,
                    "loss_spans": [{"start": a, "end": b} for a, b in held]}

        kinds = pa.schema([pa.field("conv_id", pa.null()), ("part", pa.int32()), ("formatted", pa.string()),
                           ("token_ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
                           ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

        def batch_of(found: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
            fields = [f.with_type(id_type) if f.name == "conv_id" else f for f in kinds]
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in found], f.type) for f in fields],
                                              schema=pa.schema(fields))

        id_type, out, waiting = None, [], 0
        for batch in stream:
            id_type = batch.column(0).type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                begin, body, end = template.rendered(role, text)
                new = now is None or now[0] != conv
                if now is not None and (new or size + len(begin) + len(body) + len(end) > part_chars):
                    out.append(done(now[0]))
                    waiting += size
                    pieces, spans, size, part = [], [], 0, 0 if new else part + 1
                    if waiting > part_chars:
                        yield batch_of(out, id_type)
                        out, waiting = [], 0
                now = (conv,)
                if role in loss_roles:
                    spans.append((size + len(begin), size + len(begin) + len(body)))
                pieces += [begin, body, end]
                size += len(begin) + len(body) + len(end)
        if now is not None:
            yield batch_of([*out, done(now[0])], id_type)

    return ordered.mapInArrow(run, schema)


def read_back(parts: DataFrame, template: ChatTemplate = ChatTemplate(), arranged: bool = False) -> DataFrame:
    """What the columns conv_id, part, formatted and loss_spans of ``format_conversations`` hold: one
    row per conversation with n_turns, turns_sha256 (role, line feed, text, line feed of every turn),
    loss_chars, loss_sha256 (the text under the loss mask) and formatted_chars. ``arranged`` says that
    the parts still stand as the operator put them out; else they are dealt and sorted again."""
    parts = parts.select("conv_id", "part", "formatted", "loss_spans")
    if not arranged:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = T.StructType([parts.schema["conv_id"], *[
        T.StructField(c, T.StringType() if c.endswith("sha256") else T.LongType()) for c in names]])
    with_package(parts.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in stream:
            found = []
            for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        found.append(now)
                    now = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0,
                           "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                now["formatted_chars"] += len(formatted)
                for role, text in template.turns(formatted):
                    now["n_turns"] += 1
                    now["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = template.unescaped(formatted[span["start"]:span["end"]])
                    now["loss_chars"] += len(text)
                    now["loss_sha256"].update(text.encode())
            if found:
                yield digests(found, batch.column(0).type)
        if now is not None:
            yield digests([now], batch.column(0).type)

    def digests(found: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r["conv_id"] for r in found], id_type)]
        columns += [pa.array([r[c].hexdigest() if c.endswith("sha256") else r[c] for r in found],
                             pa.string() if c.endswith("sha256") else pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names])

    return parts.mapInArrow(run, schema)
