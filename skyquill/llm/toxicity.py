"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the presence of words (A-Z lower-cased, without the marks around them). Each later
model also sees the probabilities of the earlier categories; to train it, those are out-of-fold predictions, so it
learns from probabilities of the quality that it meets on new documents. A document is toxic when the probability of the
last category reaches a threshold chosen on out-of-fold predictions.

Labels with several categories form the chain in their order. With one label, as in the given table, the earlier categories are
kinds of toxic rows: clusters of the labelled toxic rows by the words that tell toxic rows from others. No words are given.

Each model selects the words whose presence differs most between its classes (z statistic of at least ``MIN_Z``), scales
them by the log ratio of their rates and fits a logistic regression by gradient steps in numpy; words are told apart by
64-bit hashes, so there are no shared buckets. Fitted on at most ``FIT_ROWS`` labelled rows in the order of a hash of the
id, a documented bound; their texts are read whole. Words are counted by class and fold in Spark, and only words that pass
the selection of some fold come to the driver, as row and word numbers. Scoring covers whole texts.

Defined cases: null and empty texts have the probabilities of no words; null labels and labels of unknown documents are not used;
without labelled rows all probabilities are 0 and nothing is toxic; rows that share id and text are fitted once and scored alike, each
as a row of its own; rows that share an id but not the text are rows of their own; columns named like those of the result (p_toxic) are
ignored by classify() and kept by remove_toxic(); empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import discard, fold, labelled_rows, materialise, small_batches, table

FIT_ROWS = 8000
FOLDS = 3
MIN_Z = 4.0
MIN_DOCS = 3
KINDS = 2
KIND_STEPS = 10


@dataclass
class Linear:
    """Word hashes (ascending) with weights, weights of earlier probabilities, and the bias."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0

    def logit(self, rows: np.ndarray, hashes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """rows and hashes: the distinct words by row."""
        out = np.full(len(earlier), self.bias) + (earlier @ self.chained if len(self.chained) else 0)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            out += A.by_row_sum(rows[hit], self.weights[at[hit]], len(earlier))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_linear(rows: np.ndarray, hashes: np.ndarray, labels: np.ndarray, earlier: np.ndarray, steps: int = 200) -> Linear:
    """Logistic regression on selected words and on ``earlier`` (a column for each earlier category)."""
    n1, n = labels.sum(), len(labels)
    if n1 == 0 or n1 == n:
        return Linear(chained=np.zeros(earlier.shape[1]), bias=-50.0 if n1 == 0 else 50.0)
    words, place = np.unique(hashes, return_inverse=True)
    df = np.bincount(place, minlength=len(words))
    df1 = np.bincount(place, weights=labels[rows], minlength=len(words))
    p, rate1, rate0 = df / n, df1 / n1, (df - df1) / (n - n1)
    z = (rate1 - rate0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / (n - n1)))
    chosen = np.flatnonzero((df >= MIN_DOCS) & (np.abs(z) >= MIN_Z))
    ratio = np.log((df1[chosen] + 0.5) / (n1 + 1)) - np.log((df[chosen] - df1[chosen] + 0.5) / (n - n1 + 1))
    to = np.full(len(words), -1)
    to[chosen] = np.arange(len(chosen))
    keep = to[place] >= 0
    r, c = rows[keep], to[place[keep]]
    value = ratio[c]
    # full-batch Adam on a few thousand weights
    x = np.zeros(len(chosen) + earlier.shape[1] + 1)
    x[-1] = np.log(n1 / (n - n1))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        logit = np.bincount(r, weights=value * x[c], minlength=n) + earlier @ x[len(chosen) : -1] + x[-1]
        error = (sigmoid(logit) - labels) / n
        grad = np.concatenate([np.bincount(c, weights=value * error[r], minlength=len(chosen)), earlier.T @ error, [error.sum()]])
        grad[:-1] += 1e-4 * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(words[chosen], ratio * x[: len(chosen)], x[len(chosen) : -1], float(x[-1]))


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]
    threshold: float

    def known_words(self, chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct words that any model of the chain knows."""
        known = np.unique(np.concatenate([m.words for m in self.models] or [np.zeros(0, np.uint64)]))
        rows, words = chunk.bare_words()
        hit = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words if len(known) else np.zeros(len(words), bool)
        return A.row_sets(rows[hit], words[hit], chunk.n_rows)[:2]

    def predict(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """A column of probabilities for each category."""
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, sigmoid(model.logit(rows, hashes, out))])
        return out


def kinds_of(rows: np.ndarray, words: np.ndarray, labels: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """A 0/1 column for each kind of the rows labelled 1: clusters by direction over the words that such rows have more often.

    rows and words: numbers of the distinct words by row. Starts from the row farthest from the mean, then the row farthest from all starts.
    """
    out = np.zeros((len(labels), kinds))
    own = np.flatnonzero(labels == 1)
    if not len(own) or not kinds:
        return out
    n_words = int(words.max()) + 1 if len(words) else 0
    df1 = np.bincount(words, weights=labels[rows], minlength=n_words) / len(own)
    df0 = np.bincount(words, weights=1 - labels[rows], minlength=n_words) / max(1, len(labels) - len(own))
    new = np.full(len(labels), -1)
    new[own] = np.arange(len(own))
    use = (new[rows] >= 0) & (df1 > df0)[words] if len(words) else np.zeros(0, bool)
    r, w = new[rows[use]], words[use]
    norm = np.sqrt(np.maximum(np.bincount(r, minlength=len(own)), 1))
    value = 1 / norm[r]

    def mean(mask: np.ndarray) -> np.ndarray:
        c = np.bincount(w, weights=value * mask[r], minlength=n_words)
        return c / max(np.sqrt((c**2).sum()), 1e-9)

    def near(c: np.ndarray) -> np.ndarray:
        return np.bincount(r, weights=value * c[w], minlength=len(own))

    closest = near(mean(np.ones(len(own))))
    centres: list[np.ndarray] = []
    for _ in range(kinds):
        start = np.zeros(len(own))
        start[int(closest.argmin())] = 1
        centres.append(mean(start))
        got = near(centres[-1])
        closest = got if len(centres) == 1 else np.maximum(closest, got)
    for _ in range(KIND_STEPS):
        kind = np.argmax([near(c) for c in centres], axis=0)
        centres = [mean((kind == k).astype(float)) for k in range(kinds)]
    out[own, kind] = 1
    return out


def fit_sets(rows: np.ndarray, hashes: np.ndarray, labels: np.ndarray, names: tuple[str, ...], part: np.ndarray) -> Chain:
    """rows and hashes: distinct words by row; ``labels``: a 0/1 column for each category, in the order of the chain; ``part``: fold of each row."""
    n = len(labels)
    if not n:
        return Chain(names, [Linear(chained=np.zeros(k)) for k in range(len(names))], 0.5)
    earlier, models = np.zeros((n, 0)), []
    for k in range(len(names)):
        unseen = np.zeros(n)
        for f in range(FOLDS):
            inside = np.flatnonzero(part != f)
            new = np.full(n, -1)
            new[inside] = np.arange(len(inside))
            take = new[rows] >= 0
            model = fit_linear(new[rows[take]], hashes[take], labels[inside, k], earlier[inside])
            out = part == f
            unseen[out] = sigmoid(model.logit(rows, hashes, earlier))[out]
        models.append(fit_linear(rows, hashes, labels[:, k], earlier))
        earlier = np.column_stack([earlier, unseen])
    y, p = labels[:, -1], earlier[:, -1]
    tries = np.linspace(0.1, 0.9, 33)
    f1 = [2 * (y[p >= t]).sum() / max(1, y.sum() + (p >= t).sum()) for t in tries]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return Chain(names, models, float(tries[best[len(best) // 2]]))


def fit_chain(texts: list[str], labels: np.ndarray, names: tuple[str, ...]) -> Chain:
    """A chain from texts at hand."""
    got = [(r + at, h) for at, end, c in A.chunks(pa.array(texts, pa.string()), lower=True) for r, h, _ in [A.row_sets(*c.bare_words(), end - at)]]
    rows, hashes = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return fit_sets(rows, hashes, labels, names, np.arange(len(texts)) % FOLDS)


def _word_sets(rows: DataFrame, label_cols: list[str]) -> DataFrame:
    """_h, _d, labels and words (array of hashes) of rows with _h, _d, _t and labels."""

    def run(batches):
        for batch in batches:
            for start, end, chunk in A.chunks(A.text_column(batch, "_t"), lower=True):
                _, hashes, sizes = A.row_sets(*chunk.bare_words(), end - start)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], lists], names=["_h", "_d", *label_cols, "words"])

    return rows.select("_h", "_d", *label_cols, "_t").mapInArrow(A.task(run), f"_h long, _d long, {', '.join(f'`{c}` int' for c in label_cols)}, words array<long>")


def _telling_words(sets: DataFrame, label_cols: list[str]) -> DataFrame:
    """word of those that pass the selection of fit_linear for a label, on all rows or on all but one fold."""
    fold_ = F.pmod(F.col("_h"), F.lit(FOLDS)).alias("_f")
    parts = [f"_f <> {f}" for f in range(FOLDS)] + ["true"]
    rows = sets.select(fold_, *label_cols).groupBy("_f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in label_cols]).collect()  # FOLDS rows
    words = sets.select(fold_, *label_cols, F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(*[F.count(F.when(F.expr(p), 1)).alias(f"d{i}") for i, p in enumerate(parts)], *[F.coalesce(F.sum(F.when(F.expr(p), F.col(c))), F.lit(0)).alias(f"d{i}_{k}") for i, p in enumerate(parts) for k, c in enumerate(label_cols)])
    passes = F.lit(False)
    for i in range(len(parts)):
        inside = [r for r in rows if r["_f"] != i]
        n = sum(r["n"] for r in inside)
        for k, c in enumerate(label_cols):
            n1 = sum(r[c] for r in inside)
            if 0 < n1 < n:
                df, df1 = F.col(f"d{i}"), F.col(f"d{i}_{k}")
                p = df / n
                z = (df1 / n1 - (df - df1) / (n - n1)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
                passes = passes | ((df >= MIN_DOCS) & (F.abs(z) >= MIN_Z - 1e-6))
    return counts.filter(passes).select("word")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = ("toxic",), kinds: int = KINDS) -> Chain:
    """A chain from a bounded sample of the labelled rows; the last of ``label_cols`` is the verdict's. A single label gets ``kinds`` before it."""
    names = list(label_cols)
    small_batches(docs.sparkSession)
    sets = _word_sets(labelled_rows(docs, labels, id_col, text_col, names, FIT_ROWS), names).orderBy("_h", "_d").limit(FIT_ROWS)  # an id may have many texts
    sets = materialise(sets, "toxic-sets")
    telling = _telling_words(sets, names)
    rows = sets.select("_h", "_d", *names).orderBy("_h", "_d", *names).toArrow()  # FIT_ROWS rows of numbers, repeated ids apart
    found = sets.select("_h", "_d", F.explode("words").alias("word")).join(telling, "word").toArrow()
    discard(sets)
    key = lambda t: list(zip(t.column("_h").to_pylist(), t.column("_d").to_pylist()))
    at = {k: i for i, k in enumerate(key(rows))}
    place = np.array([at[k] for k in key(found)], dtype=np.int64)
    hashes = found.column("word").to_numpy().view(np.uint64)
    order = np.lexsort((hashes, place))
    place, hashes = place[order], hashes[order]
    y = np.column_stack([rows.column(c).to_numpy() for c in names]).astype(float) if rows.num_rows else np.zeros((0, len(names)))
    part = np.array([h % FOLDS for h in rows.column("_h").to_pylist()], dtype=np.int64)
    chain = tuple(names)
    if len(names) == 1 and kinds:
        y = np.column_stack([kinds_of(place, np.unique(hashes, return_inverse=True)[1], y[:, 0], kinds), y])
        chain = (*[f"kind_{k + 1}" for k in range(kinds)], *names)
    return fit_sets(place, hashes, y, chain, part)


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, p_<category> for each, and ``is_toxic`` for every row; further columns of ``docs`` are left out."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)  # selected words of FIT_ROWS documents
    names = [f"p_{c}" for c in chain.names]
    schema = ", ".join(f"{n} double" for n in names)

    def run(batches):
        model = held.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)))
            for start, end, chunk in A.chunks(A.text_column(batch, text_col), lower=True):
                out[start:end] = model.predict(*model.known_words(chunk), end - start)
            arrays = [pa.array(out[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(out[:, -1] >= model.threshold)], names=[id_col, *names, "is_toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(A.task(run), f"`{id_col}` {kind}, {schema}, is_toxic boolean")


def remove_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        model = held.value
        for batch in batches:
            toxic = np.zeros(batch.num_rows, bool)
            for start, end, chunk in A.chunks(A.text_column(batch, text_col), lower=True):
                toxic[start:end] = model.predict(*model.known_words(chunk), end - start)[:, -1] >= model.threshold
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(A.task(run), docs.schema)


def training_labels(spark, sf_dir: str) -> DataFrame:
    """Labels of the query and of the pipeline: four fifths, by id."""
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold(F.col("doc_id"), 5) != 0)


def op1_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, training_labels(spark, sf_dir)))
