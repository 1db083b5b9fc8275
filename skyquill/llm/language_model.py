"""Scoring by a gated recurrent language model.

Tokens are the words of a text (A-Z lower-cased) and one end. The model predicts each token from the state of a gated
recurrent unit that has read all tokens before it. The output is factored by classes: a softmax over classes, then, for
the most frequent ``WORDS`` words, a softmax within the class that also depends on the state. Every other word belongs to
a class by its last byte, and within it has its smoothed share of the training tokens of that class. A word never seen
has the share of the one unknown word, as in the base score. Training is by truncated backpropagation in numpy: one pass of every
partition over all tokens of its training documents, and the mean of the partitions' models, each weighted by its tokens. All begin
from the same weights, which a short start on the driver has found from at most ``START_DOCS`` documents. Means are taken of ``FAN`` models
at a time, in rounds.

A document is scored in windows, and the state is carried over from one to the next, so the score is the
log-likelihood of the whole document whatever its length.

Counts cover all training documents. Words with at least ``tokens / HEAD`` occurrences, of which there can be no more than
``HEAD``, are broadcast; rarer words go back to their documents by a join on the word.

Defined cases: a null text is empty (one end token); a null id counts as held out; repeated rows are scored alike;
further columns are ignored; an empty table gives an empty result; without training tokens every word is unknown.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import discard, materialise, small_batches, table

HEAD = 1 << 22
CLASSES, IN_CLASS = 48, 48
WORDS = CLASSES * IN_CLASS  # the end token is the first of them
TAILS = 16
HIDDEN = 16
START_DOCS = 600
START_CHARS = 20_000
STREAMS, START_STREAMS, WINDOW = 256, 64, 16
PART_TOKENS = 400_000
FAN = 8
SCORE_WINDOW, SCORE_STATES = 24, 8192
SCORE_TOKENS = 2_000_000
SMOOTH = 0.1
CHUNK = 1 << 21
END = np.uint64(0x0E0F_E0F0_1234_5678)

_U = np.uint64


def _tail_class(last: np.ndarray) -> np.ndarray:
    """Class of a rarer word by its last byte: marks, digits, letters by groups, other bytes."""
    table_ = np.full(256, 15, dtype=np.int64)
    for k, group in enumerate(("aá", "e", "iouy", "n", "r", "s", "t", "dgh", "bcfjklmpqvwxz", ".", ",", "!?", "%&", "#$*", "|0123456789")):
        for c in group.encode("ascii", "ignore"):
            table_[c] = k
    return table_[last]


def _tokens(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, tail class) of all tokens in text order, an end after each row's words."""
    n = len(chunk.starts) + chunk.n_rows
    place = np.arange(len(chunk.starts)) + chunk.row
    hashes, tails = np.full(n, END, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    hashes[place] = chunk.word_hash()
    tails[place] = _tail_class(chunk.data[chunk.ends - 1])
    return np.repeat(np.arange(chunk.n_rows), chunk.count + 1), hashes, tails


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word (hash as long), tail, n. Each task sums its words before the shuffle, a bounded number at a time."""

    def run(batches):
        def out(h, t, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, t, n = (np.concatenate(x) for x in zip(*held))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, t[first], np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            for _, _, chunk in A.chunks(A.text_column(batch, text_col), lower=True, limit=CHUNK):
                _, h, t = _tokens(chunk)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, t[first], n))
                if sum(len(x[0]) for x in held) > 1_500_000:
                    held = [merged()]
                    if len(held[0][0]) > 750_000:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())

    parts = docs.select(text_col).mapInArrow(A.task(run), "word long, tail int, n long")
    return parts.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


class Network:
    """Parameters in one flat float32 array, so models can be averaged."""

    SHAPES = {"x": (WORDS + TAILS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES + TAILS), "cb": (CLASSES + TAILS,), "w": (CLASSES, HIDDEN, IN_CLASS), "wb": (CLASSES, IN_CLASS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        if flat is None:
            flat = (np.random.default_rng(seed).standard_normal(self.SIZE) * 0.15).astype(np.float32)
        self.flat = np.array(flat, dtype=np.float32)
        self.views(self.flat, self)

    @classmethod
    def views(cls, flat: np.ndarray, into) -> None:
        at = 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            setattr(into, name, flat[at : at + n].reshape(shape))
            at += n

    def step(self, h: np.ndarray, symbols: np.ndarray):
        """(new state, what backpropagation needs)."""
        g, x = h @ self.u, self.x[symbols]
        rz = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN])))
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        gn = g[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
        return n + z * (h - n), (h, r, z, n, gn)

    def log_probability(self, states: np.ndarray, symbols: np.ndarray, grad=None):
        """Natural log of the probability of each symbol: of its class, and of the word within it (tail classes: the class alone).

        With ``grad``, adds to it the gradients of minus their mean, and gives those of the states, too.
        """
        n = len(symbols)
        cls = np.where(symbols < WORDS, symbols // IN_CLASS, symbols - WORDS + CLASSES)
        # states are within -1 and 1, so this is a bound of all logits; below it no maximum has to be taken off
        safe = max(np.abs(self.c).sum(axis=0).max() + np.abs(self.cb).max(), np.abs(self.w).sum(axis=1).max() + np.abs(self.wb).max()) < 80
        at = np.arange(n)
        e = states @ self.c
        e += self.cb
        if not safe:
            e -= e.max(axis=1, keepdims=True)
        out = e[at, cls]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        out -= np.log(total)
        if grad is not None:
            e *= (1 / (n * total))[:, None]
            e[at, cls] -= np.float32(1 / n)
            grad.c += states.T @ e
            grad.cb += e.sum(axis=0)
            back = e @ self.c.T
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        order = order[: edges[-1]]
        own = states[order]
        q = np.empty((len(order), IN_CLASS), dtype=np.float32)
        some = np.flatnonzero(np.diff(edges))
        for k in some:
            np.matmul(own[edges[k] : edges[k + 1]], self.w[k], out=q[edges[k] : edges[k + 1]])
        q += np.repeat(self.wb, np.diff(edges), axis=0)
        if not safe:
            q -= q.max(axis=1, keepdims=True)
        at, word = at[: len(order)], symbols[order] % IN_CLASS
        picked = q[at, word]
        np.exp(q, out=q)
        total = q.sum(axis=1)
        out[order] += picked - np.log(total)
        if grad is None:
            return out
        q *= (1 / (n * total))[:, None]
        q[at, word] -= np.float32(1 / n)
        more = np.empty_like(own)
        for k in some:
            part = q[edges[k] : edges[k + 1]]
            grad.w[k] += own[edges[k] : edges[k + 1]].T @ part
            np.matmul(part, self.w[k].T, out=more[edges[k] : edges[k + 1]])
        grad.wb[some] += np.add.reduceat(q, edges[some], axis=0) if len(some) else 0
        back[order] += more
        return out, back


class _Gradient:
    def __init__(self):
        self.flat = np.zeros(Network.SIZE, dtype=np.float32)
        Network.views(self.flat, self)


def train(net: Network, symbols: np.ndarray, epochs: int, rate: float, most: int = STREAMS) -> int:
    """Truncated backpropagation over one long run of tokens, cut into streams. Gives the number of tokens used."""
    streams = max(1, min(most, len(symbols) // (4 * WINDOW)))
    length = len(symbols) // streams
    if not length:
        return 0
    data = symbols[: streams * length].reshape(streams, length)
    m, v, steps = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
    for _ in range(epochs):
        h = np.zeros((streams, HIDDEN), dtype=np.float32)
        for at in range(0, length, WINDOW):
            block = data[:, at : at + WINDOW]
            states, kept, fresh = [], [], []
            for t in range(block.shape[1]):
                # after an end the next document starts from nothing
                new = data[:, at + t - 1] == 0 if at + t else np.ones(streams, bool)
                h = np.where(new[:, None], np.float32(0), h)
                states.append(h)
                fresh.append(new)
                h, used = net.step(h, block[:, t])
                kept.append(used)
            grad = _Gradient()
            _, back = net.log_probability(np.concatenate(states), block.T.ravel(), grad)
            back = back.reshape(block.shape[1], streams, HIDDEN)
            dh, dx_all = np.zeros_like(h), []
            for t in range(block.shape[1] - 1, -1, -1):
                hp, r, z, n, gn = kept[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (hp - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dx = np.concatenate([dr, dz, dn], axis=1)
                dg = np.concatenate([dr, dz, dn * r], axis=1)
                grad.u += hp.T @ dg
                dx_all.append(dx)
                dh = np.where(fresh[t][:, None], np.float32(0), dh * z + dg @ net.u.T + back[t])
            flat_symbols = block.T[::-1].ravel()
            dx = np.concatenate(dx_all)
            order = np.argsort(flat_symbols, kind="stable")
            s = flat_symbols[order]
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            grad.x[s[starts]] += np.add.reduceat(dx[order], starts, axis=0)
            norm = float(np.sqrt((grad.flat**2).sum()))
            if norm > 1:
                grad.flat /= norm
            steps += 1
            m += 0.1 * (grad.flat - m)
            v += 0.01 * (grad.flat**2 - v)
            net.flat -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)
    return streams * length


def score_documents(net: Network, symbols: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each run of symbols (tail words: of their class), in windows with the state carried over."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    out, h = np.zeros(len(first)), np.zeros((len(first), HIDDEN), dtype=np.float32)
    at, longest = 0, int(count[0]) if len(count) else 0
    while at < longest:
        states, seen, rows = [], [], []
        live = int(np.searchsorted(-count, -at, side="left"))
        stop = min(at + max(SCORE_WINDOW, SCORE_STATES // live), longest)
        for t in range(at, stop):
            live = int(np.searchsorted(-count, -t, side="left"))  # documents with more than t tokens
            s = symbols[first[:live] + t]
            states.append(h[:live])
            seen.append(s)
            rows.append(np.arange(live))
            h, _ = net.step(h[:live], s)
        logs = net.log_probability(np.concatenate(states), np.concatenate(seen))
        out += np.bincount(np.concatenate(rows), weights=logs, minlength=len(out))
        at = stop
    back = np.empty(len(out))
    back[order] = out
    return back


class Lexicon:
    """Broadcast words: counts of the frequent ones, symbols of the most frequent, and what each tail class sums to."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: list[tuple[int, int, int]], tails_of: np.ndarray):
        order = np.lexsort((words, -counts))  # equally frequent words by their hash, so numbers do not depend on the order of rows
        ranked = [w for w in words[order][: WORDS + 1].tolist() if w != int(END)][: WORDS - 1]
        top = np.array([int(END), *ranked], dtype=np.uint64)
        place = np.argsort(top)
        self.top, self.symbol = top[place], place.astype(np.int64)
        place = np.argsort(words)
        self.words, self.counts = words[place], counts[place].astype(np.int64)
        tokens, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for tail, n, k in totals:
            tokens[tail] += n
            kinds[tail] += k
        is_top, at = self._find(self.top, words)
        for tail, n in zip(tails_of[is_top], counts[is_top]):
            tokens[tail] -= n
            kinds[tail] -= 1
        self.tail_log = np.log10(tokens + SMOOTH * (kinds + 1))

    @staticmethod
    def _find(among: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(among, words), len(among) - 1)
        return among[at] == words, at

    def symbols(self, words: np.ndarray, tails: np.ndarray) -> np.ndarray:
        hit, at = self._find(self.top, words)
        return np.where(hit, self.symbol[at], WORDS + tails)


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("held_out"))


def _models(docs: DataFrame, flat: np.ndarray, lexicon: Lexicon, start=None) -> DataFrame:
    """n and flat: of each partition, the tokens it learnt from, which are all of its training documents, and its model. ``start``: a broadcast of both."""
    start = start or docs.sparkSession.sparkContext.broadcast((flat, lexicon))

    def run(batches):
        flat, lex = start.value
        own, n, pending, size = Network(flat), 0, [], 0
        for batch in batches:
            for _, _, chunk in A.chunks(A.text_column(batch, "text"), lower=True, limit=CHUNK):
                _, h, t = _tokens(chunk)
                pending.append(lex.symbols(h, t))
                size += len(h)
                if size >= PART_TOKENS:
                    symbols = np.concatenate(pending)
                    used = train(own, symbols, epochs=1, rate=0.003)
                    n += used
                    pending, size = [symbols[used:]], len(symbols) - used  # what filled no stream waits for the next
        while size:
            symbols = np.concatenate(pending)
            used = train(own, symbols, epochs=1, rate=0.003)
            n += used
            pending, size = [symbols[used:]], len(symbols) - used
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.flat.tobytes()], pa.binary())], names=["n", "flat"])

    return _training(docs).select("text").mapInArrow(A.task(run), "n long, flat binary")


def _learn(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    used = _training(docs).filter(F.length("text").between(1, START_CHARS)).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    got = used.orderBy("h", "text").limit(START_DOCS).toArrow()
    texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    net = Network()

    def read(texts: pa.Array) -> np.ndarray:
        parts = []
        for _, _, chunk in A.chunks(texts, lower=True, limit=CHUNK):
            _, h, t = _tokens(chunk)
            parts.append(lexicon.symbols(h, t))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    train(net, read(texts.cast(pa.string())), epochs=3, rate=0.01, most=START_STREAMS)

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        total, n = np.zeros(Network.SIZE), int(frame["n"].sum())
        for k, flat in zip(frame["n"], frame["flat"]):
            total += k * np.frombuffer(flat, dtype=np.float32)
        return pd.DataFrame({"n": [n], "flat": [(total / n).astype(np.float32).tobytes()]})

    start = docs.sparkSession.sparkContext.broadcast((net.flat, lexicon))
    models = materialise(_models(docs, net.flat, lexicon, start), "lm-models")
    start.destroy()
    while (n := models.count()) > FAN:
        old, groups = models, -(-n // FAN)
        key = F.pmod(F.xxhash64("flat"), F.lit(groups)).alias("k")
        models = materialise(old.select(key, "n", "flat").groupBy("k").applyInPandas(mean, "n long, flat binary"), "lm-models")
        discard(old)
    rows = sorted(map(tuple, models.collect()))  # FAN models at most
    discard(models)
    if not rows:
        return net.flat
    total = sum(n for n, _ in rows)
    return sum(np.frombuffer(flat, dtype=np.float32) * (n / total) for n, flat in rows).astype(np.float32)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row. ``held_out``: a Column."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    counts = materialise(count_words(_training(docs), "text"), "lm-counts")
    sums = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()  # TAILS rows at most
    tokens, kinds = sum(r["n"] for r in sums), sum(r["k"] for r in sums)
    head = counts.filter((F.col("n") >= max(1, -(-tokens // HEAD))) | (F.col("word") == int(END.view(np.int64)))).toArrow()  # HEAD words and the end at most
    words = head.column("word").to_numpy().view(np.uint64)
    lexicon = Lexicon(words, head.column("n").to_numpy(), [(r["tail"], r["n"], r["k"]) for r in sums], head.column("tail").to_numpy())
    flat = _learn(docs, lexicon)
    base_log = float(np.log10(tokens + SMOOTH * (kinds + 1)))
    held = spark.sparkContext.broadcast((flat, lexicon))  # a fixed number of weights, and at most HEAD words

    def run(batches):
        flat, lex = held.value
        net = Network(flat)
        rows: list[tuple] = []
        symbols: list[np.ndarray] = []
        size = 0

        def finish():
            nonlocal rows, symbols, size
            ids, outs, fps, ns, known, base, part, th, tm = (sum((list(r[i]) for r in rows), []) for i in range(9))
            count = np.array(ns, dtype=np.int64)
            logs = score_documents(net, np.concatenate(symbols), np.cumsum(count) - count, count) / np.log(10)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, type=kind), pa.array(outs, pa.bool_()), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(np.array(part) + logs), pa.array(th, pa.list_(pa.int64())), pa.array(tm, pa.list_(pa.int32())),
                ],
                names=["doc_id", "held_out", "fp", "n_tokens", "known", "base", "part", "tail_word", "tail_n"],
            )
            rows, symbols, size = [], [], 0
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start, end, chunk in A.chunks(A.text_column(batch, "text"), lower=True, limit=CHUNK):
                n = end - start
                row, h, t = _tokens(chunk)
                s = lex.symbols(h, t)
                hit, at = lex._find(lex.words, h)
                # what the frequent words add; the class shares of all tail words; the rest comes from the join
                c = np.log10(lex.counts[at] + SMOOTH) if len(lex.counts) else np.zeros(len(h))
                base = A.by_row_sum(row[hit], c[hit], n) - base_log * (chunk.count + 1)
                tail = s >= WORDS
                part = A.by_row_sum(row[tail & hit], c[tail & hit], n) - A.by_row_sum(row[tail], lex.tail_log[s[tail] - WORDS], n)
                known = np.bincount(row[hit], minlength=n)
                begin = np.cumsum(chunk.count + 1) - chunk.count - 1
                fp = np.add.reduceat(h * (np.arange(len(h)) - begin[row] + 1).astype(np.uint64), begin)
                far_row, far = row[~hit], h[~hit]
                order = np.lexsort((far, far_row))
                far_row, far = far_row[order], far[order]
                new = np.flatnonzero(np.append(True, (far[1:] != far[:-1]) | (far_row[1:] != far_row[:-1]))) if len(far) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(far))).astype(np.int32)
                cut = np.searchsorted(far_row[new], np.arange(1, n))
                rows.append((
                    batch.column(0).slice(start, n).to_pylist(), batch.column(2).slice(start, n).to_pylist(), A.mix(fp).view(np.int64), chunk.count + 1, known, base, part,
                    np.split(far[new].view(np.int64), cut), np.split(times, cut),
                ))
                symbols.append(s)
                size += len(s)
                if size >= SCORE_TOKENS:
                    yield finish()
        if rows:
            yield finish()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, fp long, n_tokens long, known long, base double, part double, tail_word array<long>, tail_n array<int>"
    part = materialise(docs.mapInArrow(A.task(run), schema), "lm-parts")
    held.destroy()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    far = part.select(key, "fp", F.explode(F.arrays_zip("tail_word", "tail_n")).alias("e")).select("id", "fp", F.col("e.tail_word").alias("word"), F.col("e.tail_n").alias("m"))
    far = far.join(counts.select("word", "n"), "word", "left")
    far = far.groupBy("id", "fp").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("far_log"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("far_known")
    )
    same = part.groupBy(key, "fp").agg(F.count(F.lit(1)).alias("rows"))
    far = far.join(same, ["id", "fp"]).select("id", "fp", (F.col("far_log") / F.col("rows")).alias("far_log"), F.expr("far_known div rows").alias("far_known"))
    out = part.select("doc_id", key, "fp", "held_out", "n_tokens", "known", "base", "part").join(far, ["id", "fp"], "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + far_log).alias("base_score"), (F.col("part") + far_log).alias("score"),
    )


def op8_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0
    return score(table(spark, sf_dir, "documents"), held_out)
