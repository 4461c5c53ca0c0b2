"""Alignment of two tokenizers over the same texts.

Both sides encode a space and the text: the byte-level vocabulary gets the space, the
piece vocabulary adds it. Tokens then tile the same bytes. Per batch of documents one
``pandas.merge_asof`` per direction, on the byte offset and keyed by document, finds for
each token start the token of the other side that covers it; both directions together
give all overlapping pairs. Offsets at which a token of either side ends cut a document
into groups; pairs that end together are its links.

Words are encoded once while a worker remembers them: a text may be cut before a space that follows another
character and precedes a visible one, because no token of either vocabulary reaches
over such a place (``_Encoders`` checks it and encodes whole texts otherwise).

How often an id pair is linked in the whole corpus is summed from one row per batch and
pair. The sums go back to the batch that has the pair, not to each document, so that a
pair that stands in every document has only as many rows as there are batches.

Null and empty texts have no tokens, nor have texts that a side doesn't give back byte
by byte (such as U+2581 or bytes that are not UTF-8). Repeated rows and ids, null ids
too, stay rows of their own; an empty table gives an empty table. A batch has about
``BATCH_BYTES`` bytes of text, of which ``ALIGNED_BYTES`` or one longer text are in work.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import materialize, text_bytes, with_package

BATCH_BYTES = 8 << 20
#: So many bytes of a batch are aligned at a time.
ALIGNED_BYTES = 3 << 19
#: A worker keeps the tokens of so many words, then starts anew; no result depends on it.
KEPT_WORDS = 200_000
#: Words beyond this many bytes go to the library whose merges take n log n steps.
LONG_WORD = 2000
#: How GPT-2's byte-level vocabularies split a text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First bytes of a character that is surely no white space.
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


@dataclass(frozen=True)
class TokenizerPair:
    """Files that every executor can read: a byte-level BPE (JSON of the ``tokenizers``
    library) and a BPE of pieces with byte fallback (``sentencepiece``)."""
    bytes_json: str
    pieces_model: str


class ByteBpe:
    """Ids of a byte-level BPE, without special tokens."""

    def __init__(self, path: str):
        import tiktoken
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in seen}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        added = {x["content"] for x in spec["added_tokens"]}
        self.entry: dict[int, bytes] = {i: bytes(byte_of[c] for c in w) for w, i in vocab.items() if w not in added}
        self.size = np.zeros(max(self.entry) + 1, dtype=np.int64)
        for i, b in self.entry.items():
            self.size[i] = len(b)
        split = spec["pre_tokenizer"] or {}
        joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges)
        # the rank of a merge is its id: then the merges by rank are the merges by list
        self.by_rank = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                        and not split.get("add_prefix_space") and all(vocab[w] == 256 + k for k, w in enumerate(joined)))
        if self.by_rank:
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, special_tokens={},
                                          mergeable_ranks={b: i for i, b in self.entry.items()})

    @cached_property
    def exact(self):
        """The library's own tokenizer, read when it is needed."""
        from tokenizers import Tokenizer
        exact = Tokenizer.from_file(self.path)
        exact.encode_special_tokens = True
        return exact

    def together(self, word: str) -> bool:
        """Whether the word may be encoded in a row with others of its kind: merges then stop at its ends."""
        return self.by_rank and len(word) <= LONG_WORD and word[:1] == " " and not (word[1:2].isspace() or word[-1].isspace())

    def encode(self, words: list[str], n_together: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number by word; the first ``n_together`` are encoded in a row."""
        ids = np.zeros(0, dtype=np.int32)
        counts = np.zeros(0, dtype=np.int64)
        if n_together:
            row = words[:n_together]
            ids = np.array(self.fast.encode_ordinary("".join(row)), dtype=np.int32)
            ends = np.cumsum([len(w.encode()) for w in row])
            counts = np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0)
        rest = [self.fast.encode_ordinary(x) if self.by_rank and len(x) <= LONG_WORD
                else self.exact.encode(x, add_special_tokens=False).ids for x in words[n_together:]]
        return (np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(rest), dtype=np.int32)]),
                np.concatenate([counts, np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))]))


def _grown(kept: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``kept`` with ``new`` after its first ``used`` values, with room for more."""
    if used + len(new) > len(kept):
        kept = np.concatenate([kept[:used], np.zeros(used + len(new), dtype=kept.dtype)])
    kept[used:used + len(new)] = new
    return kept


class _Encoders:
    def __init__(self, pair: TokenizerPair):
        import sentencepiece
        self.a, self.b = ByteBpe(pair.bytes_json), sentencepiece.SentencePieceProcessor(model_file=pair.pieces_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        entry_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(pieces)}
        self.cuts = self.a.by_rank and not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [[entry.get(i, b"") for i in range(max(entry) + 1)] for entry in (self.a.entry, entry_b)]
        self.sizes = [np.array([len(x) for x in t], dtype=np.int64) for t in self.bytes]
        n = [len(t) for t in self.bytes]
        self.n_b = n[1]
        # what a token writes into the digest, by id and by whether its group ends with it
        self.text = [f"{i}," for i in range(n[0])] + [f"{i}|" for i in range(n[0])]
        self.text += [f"{i}," for i in range(n[1])] + [f"{i};" for i in range(n[1])]
        self.first = (0, n[0], 2 * n[0], 2 * n[0] + n[1])

        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.good = np.zeros(0, dtype=bool)
        self.ids, self.used = [np.zeros(0, dtype=np.int32) for _ in "ab"], [0, 0]
        self.counts, self.begin = [np.zeros(0, dtype=np.int64) for _ in "ab"], [np.zeros(0, dtype=np.int64) for _ in "ab"]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        row = np.fromiter(map(self.a.together, texts), dtype=bool, count=len(texts))
        order = np.argsort(~row, kind="stable").tolist()
        words, texts = [words[k] for k in order], [texts[k] for k in order]
        pieces = self.b.encode([x[1:] for x in texts], num_threads=1)
        found = [self.a.encode(texts, int(row.sum())),
                 (np.fromiter(itertools.chain.from_iterable(pieces), dtype=np.int32),
                  np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))]
        n, good, joined = len(self.place), np.ones(len(words), dtype=bool), b"".join(words)
        for side, (ids, counts) in enumerate(found):
            entry = self.bytes[side]
            if b"".join([entry[i] for i in ids.tolist()]) != joined:
                each = np.split(ids, np.cumsum(counts)[:-1])
                good &= [b"".join([entry[i] for i in x.tolist()]) == w for x, w in zip(each, words)]
            self.begin[side] = _grown(self.begin[side], n, _starts(counts) + self.used[side])
            self.counts[side] = _grown(self.counts[side], n, counts)
            self.ids[side] = _grown(self.ids[side], self.used[side], ids)
            self.used[side] += len(ids)
        self.good = _grown(self.good, n, good)
        self.place.update(zip(words, range(n, n + len(words))))

    def words(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in ``ids`` (by ``begin`` and ``counts``, per side) and ``good``:
        whether both sides give the word back."""
        if len(self.place) > KEPT_WORDS:
            self._forget()
        self._learn([w for w in words if w not in self.place])
        return np.array([self.place[w] for w in words], dtype=np.int64)


_LOADED: dict[TokenizerPair, _Encoders] = {}


def _encoders(pair: TokenizerPair) -> _Encoders:
    """Once per Python worker."""
    if pair not in _LOADED:
        _LOADED[pair] = _Encoders(pair)
    return _LOADED[pair]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _gather(values: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin and count as given, one after the other."""
    return values[np.repeat(begin - _starts(counts), counts) + np.arange(counts.sum())]


@dataclass
class Aligned:
    """Tokens of the documents ``doc`` (rows of the batch) and how they meet. ``ids``,
    ``start``, ``end`` and ``of`` (the token's document) per side; ``over`` the overlapping
    pairs and ``link`` those that end together, as token numbers of either side."""
    doc: np.ndarray
    ids: list[np.ndarray]
    of: list[np.ndarray]
    start: list[np.ndarray]
    end: list[np.ndarray]
    over: tuple[np.ndarray, np.ndarray]
    link: tuple[np.ndarray, np.ndarray]


def align(texts: list[bytes], pair: TokenizerPair) -> Aligned:
    """Align the texts of one batch."""
    enc = _encoders(pair)
    rows = np.array([k for k, x in enumerate(texts) if x], dtype=np.int64)
    spaced = [b" " + texts[k] for k in rows]
    buffer = np.frombuffer(b"".join(spaced), dtype=np.uint8)
    begin = _starts(np.fromiter(map(len, spaced), dtype=np.int64, count=len(spaced)))
    cut = np.zeros(len(buffer) + 1, dtype=bool)
    if enc.cuts and len(buffer):
        space = buffer == 32
        cut[1:-2] = space[1:-1] & ~space[:-2] & _VISIBLE[buffer[2:]]
    cut[begin] = True
    cut[-1] = True
    offsets = np.flatnonzero(cut) if len(buffer) else np.zeros(1, dtype=np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                  [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)]).dictionary_encode()
    code = enc.words(words.dictionary.to_pylist())[words.indices.to_numpy()]
    good = enc.good[code]
    word_edge = np.searchsorted(offsets[:-1], np.append(begin, len(buffer)))
    doc_of_word = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(word_edge))
    whole = np.ones(len(rows), dtype=bool)
    whole[doc_of_word[~good]] = False
    keep = whole[doc_of_word]
    code, doc_of_word = code[keep], doc_of_word[keep]
    ids, of, start, end = [], [], [], []
    for side in (0, 1):
        counts = enc.counts[side][code]
        ids.append(_gather(enc.ids[side], enc.begin[side][code], counts))
        of.append(np.repeat(doc_of_word, counts))
        size = enc.sizes[side][ids[side]]
        start.append(_starts(size))
        end.append(start[side] + size)
    a = pd.DataFrame({"doc": of[0], "at": start[0], "a": np.arange(len(ids[0]))})
    b = pd.DataFrame({"doc": of[1], "at": start[1], "b": np.arange(len(ids[1]))})
    if len(a):
        under_a = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy().astype(np.int64)
        under_b = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy().astype(np.int64)
    else:
        under_a = under_b = np.zeros(0, dtype=np.int64)
    later = start[0][under_b] != start[1]  # tokens that start together are found by both directions
    over = (np.concatenate([np.arange(len(ids[0])), under_b[later]]),
            np.concatenate([under_a, np.arange(len(ids[1]))[later]]))
    together = np.flatnonzero(end[0][over[0]] == end[1][over[1]])
    together = together[np.argsort(over[0][together], kind="stable")]
    return Aligned(rows[whole], ids, [np.cumsum(whole)[x] - 1 for x in of], start, end, over,
                   (over[0][together], over[1][together]))


def _digests(x: Aligned, enc: _Encoders) -> list[str]:
    """Per document the SHA-256 of its groups, as ``a1,a2|b1;a3|b2,b3``."""
    n, last = [len(i) for i in x.ids], x.link
    # tokens of the other side that stand before a token: whole groups, the own one's A tokens before its B tokens
    group_a, group_b = np.searchsorted(last[0], np.arange(n[0])), np.searchsorted(last[1], np.arange(n[1]))
    ends_a, ends_b = np.concatenate([[0], last[0] + 1]), np.concatenate([[0], last[1] + 1])
    parts = np.empty(n[0] + n[1], dtype=np.int64)
    closes_a, closes_b = np.zeros(n[0], dtype=np.int64), np.zeros(n[1], dtype=np.int64)
    closes_a[last[0]] = 1
    closes_b[last[1]] = 1
    parts[np.arange(n[0]) + ends_b[group_a]] = x.ids[0] + np.array(enc.first[:2])[closes_a]
    parts[np.arange(n[1]) + ends_a[group_b + 1]] = x.ids[1] + np.array(enc.first[2:])[closes_b]
    text, out, at = enc.text, [], 0
    for size in (np.bincount(x.of[0], minlength=len(x.doc)) + np.bincount(x.of[1], minlength=len(x.doc))).tolist():
        joined = "".join([text[i] for i in parts[at:at + size].tolist()])
        out.append(hashlib.sha256(joined[:-1].encode()).hexdigest())
        at += size
    return out


def _batches(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text (column 1), or of one longer text."""
    for batch in stream:
        if not batch.num_rows:
            continue
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], dtype=np.int64)
        piece = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(edges):
            yield batch.slice(lo, hi - lo)


def align_tokens(docs: DataFrame, pair: TokenizerPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its id; the ids of both sides (``a_ids``, ``b_ids``) and their ends as byte
    offsets in the spaced text (``a_ends``, ``b_ends``); the overlapping pairs as token numbers
    (``over_a``, ``over_b``) and those that end together, which also end the groups (``link_a``, ``link_b``)."""
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    kind = T.ArrayType(T.IntegerType())
    names = ("a_ids", "b_ids", "a_ends", "b_ends", "over_a", "over_b", "link_a", "link_b")
    schema = T.StructType([rows.schema[0], *[T.StructField(c, kind) for c in names]])
    with_package(docs.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(stream, ALIGNED_BYTES // 4):
            x = align(batch.column(1).to_pylist(), pair)
            first = [np.searchsorted(x.of[side], np.arange(len(x.doc))) for side in (0, 1)]
            base = x.start[0][first[0]] if len(x.doc) else first[0]
            by_doc = np.argsort(x.of[0][x.over[0]], kind="stable")
            over, link = [o[by_doc] for o in x.over], x.link
            columns = [(x.ids[0], x.of[0]), (x.ids[1], x.of[1])]
            columns += [(x.end[s] - base[x.of[s]], x.of[s]) for s in (0, 1)]
            columns += [(p[s] - first[s][x.of[s][p[s]]], x.of[s][p[s]]) for p in (over, link) for s in (0, 1)]
            arrays = []
            for values, of in columns:
                counts = np.zeros(batch.num_rows, dtype=np.int64)
                counts[x.doc] = np.bincount(of, minlength=len(x.doc))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                                       pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *names])

    return rows.mapInArrow(run, schema)


def linked_batches(docs: DataFrame, pair: TokenizerPair, id_col: str = "doc_id", text_col: str = "text",
                   batch_bytes: int = BATCH_BYTES, aligned_bytes: int = ALIGNED_BYTES) -> DataFrame:
    """Per row of ``docs``: its batch, id, counts, digest of the groups and, as 32-bit numbers, for each
    link the place of its id pair in the batch's list. One more row per batch has that list, ``pairs``
    (A id times the size of B's vocabulary, plus B id), and how often each is linked, ``times``."""
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("batch", T.LongType()), rows.schema[0], *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("places", T.BinaryType()),
                           T.StructField("pairs", longs), T.StructField("times", longs)])
    names = [f.name for f in schema.fields]
    with_package(docs.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = _encoders(pair)
        number, size, done = TaskContext.get().partitionId() << 32, 0, []
        for batch in _batches(stream, aligned_bytes):
            texts = batch.column(1).to_pylist()
            x = align(texts, pair)
            n, link_doc = batch.num_rows, x.of[0][x.link[0]]
            numbers = [np.zeros(n, dtype=np.int64) for _ in counts]
            for out, of in zip(numbers, (x.of[0], x.of[1], link_doc, link_doc, x.of[0][x.over[0]])):
                out[x.doc] = np.bincount(of, minlength=len(x.doc))
            digest = [""] * n
            for d, text in zip(x.doc.tolist(), _digests(x, enc)):
                digest[d] = text
            done.append((batch.column(0), numbers, digest, x.ids[0][x.link[0]].astype(np.int64) * enc.n_b + x.ids[1][x.link[1]]))
            size += sum(map(len, texts))
            if size >= batch_bytes:
                yield listed(number, done)
                number, size, done = number + 1, 0, []
        if done:
            yield listed(number, done)

    def listed(number: int, done: list[tuple]) -> pa.RecordBatch:
        """The documents of a batch, and a last row with its list of pairs."""
        ids = pa.concat_arrays([d[0] for d in done] + [pa.nulls(1, done[0][0].type)])
        numbers = [np.append(np.concatenate(x), 0) for x in zip(*(d[1] for d in done))]
        place, pairs = pd.factorize(np.concatenate([d[3] for d in done]))
        times, place, n = np.bincount(place, minlength=len(pairs)), place.astype(np.int32), len(ids) - 1
        edges = np.concatenate([[0], np.cumsum(numbers[3][:-1])]).tolist()
        places = [place[lo:hi].tobytes() for lo, hi in itertools.pairwise(edges)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n + 1, number)), ids, *[pa.array(x) for x in numbers],
             pa.array([*itertools.chain.from_iterable(d[2] for d in done), None], pa.string()),
             pa.array([*places, None], pa.binary()), pa.array([None] * n + [pairs], pa.list_(pa.int64())),
             pa.array([None] * n + [times], pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(run, schema)


def _pair_counts(batches: DataFrame, n_b: int) -> DataFrame:
    """Columns batch, place, links (of the pair in the corpus) and best: no other A id has more
    links with the pair's B id. At most as many B ids as the vocabulary has go through the last join."""
    each = (batches.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p"))
            .select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")))
    total = each.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b", F.col("pair") % n_b)
    top = total.groupBy("b").agg(F.max("links").alias("top"))
    total = total.join(top, "b").select("pair", "links", (F.col("links") == F.col("top")).alias("best"))
    return each.join(total, "pair").select("batch", "place", "links", "best")


def link_statistics(docs: DataFrame, pair: TokenizerPair, n_b: int, id_col: str = "doc_id", text_col: str = "text",
                    batch_bytes: int = BATCH_BYTES, aligned_bytes: int = ALIGNED_BYTES) -> DataFrame:
    """Per row of ``docs`` its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps.
    ``n_b`` is the size of the piece vocabulary.

    The batches are written once. Each batch's list of pairs, with the corpus' sums, is dealt to the task
    that has its documents, sorted in front of them, and read as a stream: a task holds one list at a time."""
    batches = materialize(linked_batches(docs, pair, id_col, text_col, batch_bytes, aligned_bytes), "token-links")
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
    rows = batches.where("pairs is null").drop("pairs", "times").withColumns(
        {"place": F.lit(None).cast("int"), "links": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")})
    lists = _pair_counts(batches.select("batch", "pairs", "times"), n_b)
    both = (rows.unionByName(lists, allowMissingColumns=True).repartition("batch")
            .sortWithinPartitions("batch", F.col("place").asc_nulls_last()))
    order = ["batch", "place", "links", "best", id_col, *counts, "groups_sha256", "places"]
    out = T.StructType([rows.schema[id_col], *[T.StructField(c, T.LongType()) for c in (*counts, "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, best = None, [], []
        for batch in stream:
            number = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if number[lo] != now:
                    now, links, best = number[lo], [], []
                part = batch.slice(lo, hi - lo)
                listed = part.num_rows - part.column(1).null_count
                if listed:
                    links.append(part.column(2).slice(0, listed).to_numpy())
                    best.append(part.column(3).slice(0, listed).to_numpy(zero_copy_only=False))
                docs_here = part.slice(listed)
                if not docs_here.num_rows:
                    continue
                links, best = [np.concatenate([np.zeros(0, np.int64), *links])], [np.concatenate([np.zeros(0, bool), *best])]
                at = [np.frombuffer(x, dtype=np.int32) for x in docs_here.column(11).to_pylist()]
                columns = [docs_here.column(c) for c in range(4, 10)]
                columns += [pa.array([int(best[0][p].sum()) for p in at], pa.int64()),
                            pa.array([int(links[0][p].sum()) for p in at], pa.int64()), docs_here.column(10)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return both.select(*order).mapInArrow(run, out)

