"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features: hashed words, hashed character n-grams of words (with
marks for word start and end), and one feature for each word that repeats the word before it or before that. A softmax
layer gives the classes. Vectors and layer are trained together by stochastic gradient descent in numpy, one document at
a time, with a rate that falls to zero. Features keep their case.

Fitted on at most ``FIT_ROWS`` labelled rows in the order of a hash of the id, a documented bound; their texts are read whole. Features are
taken in the tasks that read the texts, and one task trains, so the driver holds nothing but the result. Scoring covers whole texts. As
the layer is linear in the average, a document's score needs only the sum of one number per feature, so scoring is a few array
passes in ``mapInArrow``.

Defined cases: null and empty texts get the score of the bias alone; repeated rows get equal scores, a row each; a row without an id
counts as held out; null labels and labels of unknown documents are not used; an id that is labelled twice counts with its least
label; without labelled rows every score is 0.5; further columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import fold, labelled_rows, small_batches, table

BUCKETS = 1 << 18
WIDTH = 12
EPOCHS = 5
RATE = 1.0
FIT_ROWS = 4000
THRESHOLD = 0.3
GRAMS = (3, 4)

_U = np.uint64


def features(chunk: A.Chunk, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays: words, repeats, then n-grams."""
    words = chunk.word_hash()
    mask = _U(buckets - 1)
    out = [(chunk.row, ((words ^ _U(0x51)) & mask).astype(np.int64))]
    for back in (1, 2):
        same = np.flatnonzero((words[back:] == words[:-back]) & (chunk.row[back:] == chunk.row[:-back])) + back
        out.append((chunk.row[same], np.full(len(same), back, dtype=np.int64)))
    if not len(words):
        return out
    mark = np.zeros(len(chunk.data) + 1, dtype=np.int8)
    mark[chunk.starts] = 1
    mark[chunk.ends[chunk.ends < len(chunk.data)]] -= 1
    inside = np.cumsum(mark[:-1]).astype(bool)
    inside[chunk.starts] = True
    lead = np.flatnonzero(inside & ((chunk.data & 0xC0) != 0x80))
    word = np.searchsorted(chunk.starts, lead, side="right") - 1
    stop = np.append(lead[1:], 0)
    last = np.append(word[1:] != word[:-1], True)
    stop = np.where(last, chunk.ends[word], stop)
    first = np.insert(last[:-1], 0, True)
    for n in GRAMS:
        if len(lead) < n:
            continue
        ok = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
        edge = first[ok].astype(np.uint64) + _U(2) * last[ok + n - 1].astype(np.uint64)
        h = A.mix(chunk.span_hash(lead[ok], stop[ok + n - 1]) + edge + _U(7))
        out.append((chunk.row[word[ok]], (h & mask).astype(np.int64)))
    return out


def counted(chunk: A.Chunk, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, times) of each row, buckets ascending."""
    row, bucket = (np.concatenate(x) for x in zip(*features(chunk, buckets)))
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    cut = np.searchsorted(key, np.arange(1, chunk.n_rows) * buckets)
    return list(zip(np.split(key % buckets, cut), np.split(count, cut)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int = 2, seed: int = 1, buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """Vectors, layer and bias from the counted features of rows."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((buckets, WIDTH), dtype=np.float32) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((classes, WIDTH), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    total, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / total)
            done += 1
            bucket, count = rows[i]
            share = count.astype(np.float32) / np.float32(max(1, count.sum()))
            mean = share @ vectors[bucket] if len(bucket) else np.zeros(WIDTH, np.float32)
            z = layer @ mean + bias
            z = np.exp(z - z.max())
            error = (z / z.sum()).astype(np.float32)
            error[labels[i]] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * 0.1 * error
            if len(bucket):
                # dense documents have tiny shares: the step is on the sum, as if each place were updated
                vectors[bucket] -= np.outer(rate * share * min(50.0, len(bucket) ** 0.5), back)
    return {"vectors": vectors, "layer": layer, "bias": bias}


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict[str, np.ndarray]:
    """A scorer for two classes from a bounded sample of rows with labels 0 or 1: one number per bucket, and the bias."""
    small_batches(docs.sparkSession)

    def read(batches):
        for batch in batches:
            for start, end, chunk in A.chunks(A.text_column(batch, "_t"), lower=False):
                rows = counted(chunk)
                lists = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1)]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists], names=["_h", "_d", "label", "bucket", "times"])

    def learn(batches):
        rows, labels = [], []
        for batch in batches:
            rows += [(b.values.to_numpy().astype(np.int64), t.values.to_numpy()) for b, t in zip(batch.column(3), batch.column(4))]
            labels += batch.column(2).to_pylist()
        if rows:
            model = train(rows, np.array(labels))
            weights = (model["vectors"] @ (model["layer"][1] - model["layer"][0])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([float(model["bias"][1] - model["bias"][0])])], names=["score", "bias"])

    sample = labelled_rows(docs, labels, id_col, text_col, [label_col], FIT_ROWS).select("_h", "_d", F.col(label_col).alias("label"), "_t")
    sample = sample.mapInArrow(A.task(read), "_h long, _d long, label int, bucket array<int>, times array<int>")
    found = sample.orderBy("_h", "_d").limit(FIT_ROWS).mapInArrow(A.task(learn), "score binary, bias double").first()  # FIT_ROWS rows, one model
    if found is None:
        return {"score": np.zeros(BUCKETS, np.float32), "bias": np.zeros(1)}
    return {"score": np.frombuffer(found["score"], np.float32), "bias": np.array([found["bias"]])}


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, the probability of class 1, for every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats at any size of the input

    def run(batches):
        weights, bias = held.value["score"], float(held.value["bias"][0])
        for batch in batches:
            texts, out = A.text_column(batch, text_col), np.zeros(batch.num_rows)
            for start, end, chunk in A.chunks(texts, lower=False):
                n, total, count = end - start, np.zeros(end - start), np.zeros(end - start)
                for row, bucket in features(chunk):
                    total += A.by_row_sum(row, weights[bucket], n)
                    count += np.bincount(row, minlength=n)
                out[start:end] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(A.task(run), f"`{id_col}` {kind}, score double")


def op9_subword_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(F.col("doc_id"), 5) != 0)
    model = fit(docs, labels, "doc_id", "text", "quality")
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
