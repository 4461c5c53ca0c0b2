"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with calibrated probabilities.

Random indexing: every token has a fixed sparse vector of -1, 0 and 1; the vector of a
word is the sum of its neighbours' fixed vectors over the whole corpus. Tokens share
``BUCKETS`` hash buckets, so the table has a fixed size whatever the vocabulary. The sums
are whole numbers: partial sums from the tasks add up to the same table in any order.

A document is the mean, spread and largest values of its words' vectors, rare words
weighing more, with its length and the share of its distinct tokens. A network with one
hidden layer (numpy, Adam) is fitted on a bounded sample of labelled rows; the logits are
divided by a temperature that fits rows kept aside for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import materialize, text_bytes, with_package

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: The network is fitted on at most so many different labelled rows, those with the smallest hashes; equal ones are one
#: row with a count.
MAX_TRAIN = 20_000
CHUNK_TOKENS = 1 << 17
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_N_FEATURES = 3 * DIM + 2


def index_vectors() -> np.ndarray:
    """The fixed vectors, one for each bucket: ``NONZERO`` entries of -1 or 1."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIM), dtype=np.int8)
    for row, places in enumerate(rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]):
        out[row, places] = rng.choice((-1, 1), NONZERO)
    return out


class _Buckets(dict):
    """token -> bucket; forgets everything when it has grown large."""

    def __missing__(self, token):
        if len(self) > 1 << 20:
            self.clear()
        self[token] = out = zlib.crc32(token) % BUCKETS
        return out


def _chunks(texts: list[bytes], buckets: _Buckets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of all tokens, tokens of each text) of neighbouring texts with about
    CHUNK_TOKENS tokens together."""
    found, sizes = [], []
    for text in texts:
        tokens = [buckets[x] for x in _TOKEN.findall(text)]
        if sizes and len(found) + len(tokens) > CHUNK_TOKENS:
            yield np.array(found, dtype=np.int64), np.array(sizes, dtype=np.int64)
            found, sizes = [], []
        found += tokens
        sizes.append(len(tokens))
    if sizes:
        yield np.array(found, dtype=np.int64), np.array(sizes, dtype=np.int64)


def context_sums(tokens: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each token the sum of its neighbours' fixed vectors, within its text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = index[tokens]
    out = np.zeros((len(tokens), DIM), dtype=np.int16)
    for step in range(1, min(WINDOW, len(tokens) - 1) + 1):
        same = (doc[step:] == doc[:-step])[:, None]
        out[:-step] += own[step:] * same
        out[step:] += own[:-step] * same
    return out


def word_table(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, token counts) by bucket, from all of ``docs``: one pass, one sum by
    bucket with map-side combine, and a result of fixed size."""
    with_package(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        total, count = np.zeros((BUCKETS, DIM), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for tokens, sizes in _chunks(batch.column(0).to_pylist(), buckets):
                if not len(tokens):
                    continue
                context = context_sums(tokens, sizes, index)
                order = np.sort((tokens << 32) | np.arange(len(tokens)))
                tokens = order >> 32
                first = np.flatnonzero(np.diff(tokens, prepend=-1))
                total[tokens[first]] += np.add.reduceat(context[order & 0xFFFFFFFF], first, axis=0, dtype=np.int64)
                count += np.bincount(tokens, minlength=BUCKETS)
        used = np.flatnonzero(count)
        values = np.c_[count[used], total[used]]
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * (DIM + 1), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], names=["bucket", "sums"])

    parts = docs.select(text_bytes(text_col)).mapInArrow(sums, "bucket int, sums array<bigint>")
    rows = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM + 1)]).collect()
    vectors, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for row in rows:  # at most BUCKETS
        count[row[0]], vectors[row[0]] = row[1], row[2:]
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32), count


def pool(tokens: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of features for each text; zeros but for the length where it has no tokens."""
    out = np.zeros((len(sizes), _N_FEATURES), dtype=np.float32)
    full = np.flatnonzero(sizes)
    out[:, -2] = np.log1p(sizes)
    if not len(full):
        return out
    # one row for each token that a text has, with its weight times its count
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, times = np.unique(doc * BUCKETS + tokens, return_counts=True)
    of, distinct = pairs // BUCKETS, pairs % BUCKETS
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    own = vectors[distinct]
    w = (weights[distinct] * times).astype(np.float32)[:, None]
    weighted = own * w
    total = np.add.reduceat(w, starts, axis=0)
    mean = np.add.reduceat(weighted, starts, axis=0) / total
    weighted *= own
    out[full, :DIM] = mean
    out[full, DIM:2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(weighted, starts, axis=0) / total - mean * mean, 0))
    out[full, 2 * DIM:3 * DIM] = np.maximum.reduceat(own, starts, axis=0)
    out[full, -1] = np.diff(np.r_[starts, len(of)]) / sizes[full]
    return out


def document_features(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """id and features of every row, written to the shared folder."""
    with_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(words)  # of fixed size, see BUCKETS and DIM

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, count = table.value
        weights = (1e-3 / (1e-3 + count / max(1.0, count.sum()))).astype(np.float32)
        buckets = _Buckets()
        for batch in batches:
            parts = [pool(t, s, vectors, weights) for t, s in _chunks(batch.column("text").to_pylist(), buckets)]
            values = np.concatenate(parts) if parts else np.zeros((0, _N_FEATURES), dtype=np.float32)
            lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * _N_FEATURES,
                                             pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "features"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("features", T.ArrayType(T.FloatType()))])
    return materialize(rows.mapInArrow(features, schema), "features")


@dataclass
class Network:
    """Two layers on standardised features; ``temperature`` divides the logit."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256,
        rate: float = 3e-3, decay: float = 1e-4, times: np.ndarray | None = None) -> Network:
    """Fit on the rows that aren't ``aside`` (all, if that leaves none), then choose the
    temperature with the smallest log loss on those that are. A row counts ``times`` (1 by
    default): an epoch draws as many rows as there are, evenly over the running sum of
    the counts. Without rows, or with one class, the score is the same for all: the share
    of label 1 with a half row of each."""
    rng = np.random.default_rng(7)
    times = np.ones(len(y)) if times is None else times.astype(np.float64)
    share = ((times * y).sum() + 0.5) / (times.sum() + 1)
    net = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], hidden)), np.zeros(hidden),
                  np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    use = ~aside if len(np.unique(y[~aside])) > 1 else np.ones(len(y), dtype=bool)
    net.mean = np.average(x[use], axis=0, weights=times[use])
    net.scale = np.sqrt(np.average((x[use] - net.mean) ** 2, axis=0, weights=times[use])) + 1e-6
    net.w1, net.w2 = rng.normal(0, x.shape[1] ** -0.5, net.w1.shape), rng.normal(0, hidden ** -0.5, hidden)
    xs, ys = (x[use] - net.mean) / net.scale, y[use]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    upto = np.cumsum(times[use])
    for epoch in range(epochs):
        places = (np.arange(len(xs)) + epoch * 0.618034 % 1) * (upto[-1] / len(xs))
        drawn = np.minimum(np.searchsorted(upto, places, side="right"), len(xs) - 1)
        for rows in np.array_split(drawn[rng.permutation(len(xs))], max(1, len(xs) // batch)):
            xb, h = xs[rows], np.tanh(xs[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - ys[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [xb.T @ back + decay * params[0], back.sum(axis=0), h.T @ error + decay * params[2],
                     np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    kept = aside if aside.any() else use
    logit, truth = net.logits(x[kept]), y[kept]
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.average(np.logaddexp(0, logit / t) - truth * logit / t, weights=times[kept]) for t in tried]
    net.temperature = float(tried[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, held_out: int = 0, aside: int = 1,
                   threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Labels are read only from rows whose crc32 of the id as text is not ``held_out``
    modulo ``folds``; those at ``aside`` set the temperature. Rows without an id or a
    label teach nothing; an id with several labels or rows teaches with each. Equal rows
    (id, label, features) are one with a count, of which the ``max_train`` with the
    smallest hashes are collected and no more. The score
    sees the text only. Null and empty texts get the score of a text without tokens.
    Repeated rows get equal scores; an empty table gives an empty table.
    """
    words = word_table(docs, text_col)
    features = document_features(docs, words, id_col, text_col)
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(F.col("label").isin(0.0, 1.0) & (fold != held_out)))
    known = known.groupBy("id", "label").agg(F.count(F.lit(1)).alias("labels"))
    # thinned by hash before the join; the hard limit is taken of what is left, in tasks, and written
    usable = known.join(features.select("id").distinct(), "id", "left_semi").count()
    share = min(1.0, 1.1 * max_train / max(1, usable))
    drawn = features.withColumn("hash", F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("features")), F.lit(1 << 30)))
    drawn = (drawn.where(F.col("hash") < int(share * (1 << 30))).join(known, "id")
             .groupBy("hash", "id", "label", "features").agg(F.sum("labels").alias("times"))
             .orderBy("hash", "id", "label", "features").limit(max_train))
    rows = materialize(drawn, "training-sample").select("id", "features", "label", "times", fold.alias("fold")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["label"], r["features"]))
    x = np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), _N_FEATURES)
    net = fit(x, np.array([r["label"] for r in rows], dtype=np.float64), np.array([r["fold"] == aside for r in rows], dtype=bool),
              times=np.array([r["times"] for r in rows], dtype=np.float64))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(model.value.score(np.stack(values.to_numpy()).astype(np.float64)) if len(values) else [],
                            dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score = F.pandas_udf(run, T.DoubleType()).asNondeterministic()
    return (features.select("id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
                            score("features").alias("score"))
            .select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
