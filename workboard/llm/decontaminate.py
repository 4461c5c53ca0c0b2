"""Benchmark decontamination with a positional inverted index.

The index is a table of segments. A segment covers whole neighbouring documents of about
``segment_words`` words and holds, for each of its terms, the ascending word
positions where it stands (terms, starts, postings; positions run through the
segment, and n_words says where each document ends). Segments are built where the
documents lie, without a shuffle, and written to the shared folder; they can be kept
and searched again with other test items.

A search sends the test phrases to the segments in blocks of bounded size. In each
segment a phrase's posting lists are taken from the rarest term up: the positions of
the rarest, less its place in the phrase, are possible starts, and each further list
keeps those that it confirms. All lists are intersected, so a match is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import content_key, free_name, materialize, text_bytes, with_package
from workboard.session import arrow_batches

#: Words of a segment (a longer document is a segment of its own) and of a block of test items.
SEGMENT_WORDS = 1 << 18
SLICE_BYTES = 1 << 23  # of text that a task cuts, or of segments that it searches, at a time
BLOCK_WORDS = 1 << 18

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.lower().translate(_TO_WORDS).split()


# ---------------------------------------------------------------- index

def _tokenised(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words one after the other), as words_of() cuts them. Arrow
    splits and counts; its strings are views of the bytes."""
    plain = pa.array([t.lower().translate(_TO_WORDS).strip() for t in texts], pa.binary()).view(pa.string())
    lists = pc.ascii_split_whitespace(plain)
    sizes = np.where(pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False), 0,
                     pc.list_value_length(lists).to_numpy())
    words = lists.flatten()  # a text without words gives one empty word
    return sizes, words.filter(pc.greater(pc.binary_length(words), 0))


def _segment(number: int, ids: pa.Array, sizes: np.ndarray, words: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    order = np.sort((numbers << 32) | np.arange(len(numbers)))
    starts = np.zeros(len(coded.dictionary) + 1, dtype=np.int32)
    np.cumsum(np.bincount(numbers, minlength=len(coded.dictionary)), out=starts[1:])
    lists = {"ids": ids, "n_words": pa.array(sizes.astype(np.int32)), "terms": coded.dictionary.view(pa.binary()),
             "starts": pa.array(starts), "postings": pa.array((order & 0xFFFFFFFF).astype(np.int32))}
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64())] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                                            for x in lists.values()], schema=schema)


def _stretches(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts rows into runs: those that begin in the same stretch of ``most`` units."""
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)].tolist()
    return list(zip(cuts, cuts[1:]))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Posting segments of all texts, written to the shared folder.

    Null texts have no words. Each row of ``docs`` is a document of its own, repeated
    and null ids included. An empty table has no segments.
    """
    with_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    ids = rows.schema["id"].dataType
    out = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(ids)),
                        T.StructField("n_words", T.ArrayType(T.IntegerType())),
                        T.StructField("terms", T.ArrayType(T.BinaryType())),
                        T.StructField("starts", T.ArrayType(T.IntegerType())),
                        T.StructField("postings", T.ArrayType(T.IntegerType()))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column("id")
            schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(keys.type)), ("n_words", pa.list_(pa.int32())),
                                ("terms", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32())),
                                ("postings", pa.list_(pa.int32()))])
            texts = batch.column("text")
            for first, last in _stretches(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                sizes, words = _tokenised(texts.slice(first, last - first).to_pylist())
                ends = np.cumsum(sizes)
                for low, high in _stretches(sizes, segment_words):
                    begin = int(ends[low] - sizes[low])
                    yield _segment(number, keys.slice(first + low, high - low), sizes[low:high],
                                   words.slice(begin, int(ends[high - 1]) - begin), schema)
                    number += 1

    # most terms and positions are written once: a Parquet dictionary would cost time only.
    # A row is megabytes, and writers and readers hold a row group: those are kept small, and as
    # Parquet looks at a group's size after 100 rows only, it is told to look after each.
    with arrow_batches(docs.sparkSession, SLICE_BYTES):
        return materialize(rows.mapInArrow(segments, out), "index", {
            "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 24),
            "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})


def indexed_documents(index: DataFrame) -> DataFrame:
    """segment, ordinal, id and n_words of each indexed document."""
    return (index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "doc"))
            .select("segment", "ordinal", F.col("doc.ids").alias("id"), F.col("doc.n_words").alias("n_words")))


class _Segment:
    """One stored segment, seen through the vocabulary of a block of queries."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        at = pc.index_in(vocabulary, value_set=row["terms"].values)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = row["starts"].values.to_numpy()
        self.low = np.where(at >= 0, starts[at], 0)
        self.size = np.where(at >= 0, starts[at + 1] - starts[at], 0)
        self.postings = row["postings"].values.to_numpy()
        self.ends = np.cumsum(row["n_words"].values.to_numpy().astype(np.int64))

    def list(self, term: int) -> np.ndarray:
        return self.postings[self.low[term]:self.low[term] + self.size[term]]

    def document(self, position):
        return np.searchsorted(self.ends, position, side="right")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Ascending starts of the phrase, within one document each."""
        order = np.argsort(self.size[terms], kind="stable")
        starts = self.list(terms[order[0]]).astype(np.int64) - order[0]
        for place in order[1:]:
            if not len(starts):
                return starts
            there = self.list(terms[place])
            at = np.searchsorted(there, starts + place)
            starts = starts[there[np.minimum(at, len(there) - 1)] == starts + place]
        starts = starts[starts >= 0]
        return starts[self.document(starts) == self.document(starts + len(terms) - 1)]

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Smallest spans of at most ``span`` words of one document with all terms."""
        terms = np.unique(terms)
        order = terms[np.argsort(self.size[terms], kind="stable")]
        here = self.list(order[0]).astype(np.int64)
        for term in order[1:]:
            there = self.list(term)
            at = np.searchsorted(there, here - span + 1)
            here = here[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] < here + span)]
        found = set()
        for p in here.tolist():
            events = sorted((x, int(t)) for t in terms for x in self._within(t, p - span + 1, p + span))
            last: dict = {}
            for x, t in events:
                last[t] = x
                if len(last) == len(terms) and x - (low := min(last.values())) < span \
                        and self.document(low) == self.document(x):
                    found.add((low, x + 1))
        return sorted(s for s in found if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in found))

    def _within(self, term, low, high):
        there = self.list(term)
        return there[np.searchsorted(there, low):np.searchsorted(there, high)].tolist()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


_MATCH = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("query", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                    T.StructField("end", T.IntegerType())])))])


def _search(index: DataFrame, phrases: dict[str, list[tuple[bytes, ...]]], within: int | None) -> DataFrame:
    """Matches of one block: for each document and query the merged word spans
    (in the document, end exclusive)."""
    spark = index.sparkSession
    vocabulary = sorted({w for ps in phrases.values() for p in ps for w in p})
    number = {w: i for i, w in enumerate(vocabulary)}
    coded: dict[int, dict[tuple, list[str]]] = defaultdict(dict)
    for query, ps in phrases.items():
        for p in ps:
            coded[len(p)].setdefault(tuple(number[w] for w in p), []).append(query)
    # as arrays, of which every worker has a copy: Python's tuples take many times as much
    by_size = {}
    for n, asked in coded.items():
        ends = np.cumsum([len(queries) for queries in asked.values()])
        by_size[n] = (np.array(list(asked), dtype=np.int32), ends,
                      pa.array([q for queries in asked.values() for q in queries], pa.string()).dictionary_encode())
    block = spark.sparkContext.broadcast((pa.array(vocabulary, pa.binary()), by_size))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_size = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("terms", "starts", "postings", "n_words")}
                seg, spans = _Segment(row, words), defaultdict(list)
                for n, (rows, ends, names) in by_size.items():
                    for k in np.flatnonzero((seg.size[rows] > 0).all(axis=1)).tolist():
                        found = seg.near(rows[k], within) if within else \
                            [(s, s + n) for s in seg.phrase(rows[k]).tolist()]
                        queries = names[int(ends[k - 1]) if k else 0:int(ends[k])].to_pylist() if found else ()
                        for low, high in found:
                            doc = int(seg.document(low))
                            shift = int(seg.ends[doc - 1]) if doc else 0
                            for query in queries:
                                spans[doc, query].append((low - shift, high - shift))
                if spans:
                    at = batch.column("segment")[i].as_py()
                    yield pa.RecordBatch.from_pylist(
                        [{"segment": at, "ordinal": d, "query": q,
                          "spans": [{"start": a, "end": b} for a, b in _merged(s)]} for (d, q), s in spans.items()],
                        schema=pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("query", pa.string()),
                                          ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    with arrow_batches(spark, SLICE_BYTES):  # run here, as a plan that runs later has the batches of its session
        return materialize(index.select("segment", "n_words", "terms", "starts", "postings").mapInArrow(search, _MATCH), "matches")


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The different items in blocks of about ``block_words`` words, so that what a search
    sends to the tasks is bounded however many items there are, or rows of one item. The
    items are read and compared once and written; a block reads what was written."""
    texts = materialize(items.select(F.col(item_col).cast("string").alias("item"), text_bytes(text_col).alias("text")).distinct(),
                        "items")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (6 * block_words)))
    for k in range(count):
        yield texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, item_col: str = "item_id",
                   text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """segment, ordinal, query (item id as text) and merged word spans of every place
    where ``window`` consecutive words of an item stand. A shorter item with words is
    one phrase; an item without words matches nothing. Items without an id are searched
    as well: their ``query`` is null."""
    with_package(index.sparkSession)
    found = None
    for block in _blocks(items, item_col, text_col, block_words):
        phrases: dict[str, list] = defaultdict(list)
        for item, text in block:
            words = words_of(bytes(text))
            if words:
                phrases[item] += {tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}
        part = _search(index, phrases, None)
        found = part if found is None else found.unionByName(part)
    return found


def proximity_matches(index: DataFrame, items: DataFrame, span: int, item_col: str = "item_id",
                      text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Like phrase_matches, for places where all words of an item stand, in any order,
    within ``span`` words of a document."""
    with_package(index.sparkSession)
    found = None
    for block in _blocks(items, item_col, text_col, block_words):
        phrases: dict[str, list] = defaultdict(list)
        for item, text in block:
            words = tuple(sorted(set(words_of(bytes(text)))))
            if words:
                phrases[item].append(words)
        part = _search(index, phrases, span)
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (merged hit spans), items (ids as
    text, sorted; items without an id have none) and n_hit (words inside any span)."""
    index = build_index(docs, id_col, text_col)
    found = phrase_matches(index, items, window, item_col, item_text_col)
    per_doc = (found.groupBy("segment", "ordinal")
               .agg(F.array_sort(F.collect_set("query")).alias("items"),
                    F.array_sort(F.flatten(F.collect_list("spans"))).alias("all")))
    # words in the union of the sorted spans: what each adds beyond the furthest end so far
    counted = F.aggregate(
        "all", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"])
    per_doc = per_doc.withColumn("n_hit", counted)
    return (indexed_documents(index).join(per_doc, ["segment", "ordinal"], "left")
            .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("all", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no hit. Rows are matched by content address,
    so null and repeated ids and extra columns are no matter."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, content_key(text_col))
    hit = (contamination(keyed, items, window, key, text_col, item_col, item_text_col)
           .where("n_hit > 0").select(key).distinct())
    return keyed.join(hit, key, "left_anti").select(*docs.columns)
