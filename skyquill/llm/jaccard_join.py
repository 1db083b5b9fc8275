"""N-gram Jaccard join with adaptive multi-match prefixes, down to components.

A document's set holds its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle). Two documents link
when 100 * intersection >= 80 * union. All links between different sets are respected; equal sets are one class.

1. Classes. One pass gives each document's set size and a 128-bit fingerprint of its set; documents of equal fingerprints are one node,
   named by their smallest id. The same pass gives the number of documents by shingle as far as it shows within a task; shingles with an
   estimate of at least ``total / HEAVY`` (and ``HEAVY_LEAST``) are broadcast. There can be no more than ``HEAVY`` of them.
2. Prefixes. Shingles are ordered by the power of two of that estimate, then by hash. A set of n shingles with t = ceil(0.8 n)
   has the prefix of its first n - t + l. Each document takes the l (1 to ``MATCHES``) of the least cost: prefix length plus
   ``VERIFY`` times the estimated candidates, which are the sum of the estimates over l. Two linked documents share at least the
   smaller of their two l in their prefixes, whatever the order, so estimates bear on cost alone. Each node also gets two sketches, of
   ``SKETCH`` bits and of at least 2 n, the parities of its shingles by hash: two sets differ in no fewer shingles than their sketches in bits.
3. Stars. Each node is verified against one hub, a node whose prefix is most widely shared, as a copied text's is. In a large group of near
   copies this links nearly everything with as many verifications as nodes.
4. Rest. In each posting list that still holds several components, nodes outside of its largest one meet the nodes of other
   components whose size class is next to theirs. Two sizes fix the least intersection of a link, and with it the part of both prefixes
   that counts; a pair comes out of that join only if the shared shingle is in that part and the sketches allow a link. Pairs with
   enough of these shingles are verified: first the best one of each node, then all that still join two components.
5. Components by contraction to the least neighbour; each round's tables are written to the shared folder.

Verification intersects whole sets. Sets are read again from the texts of the documents that need it, found by a bitmap of fixed size
before the exact join.

Defined cases: null or empty texts have no shingles and link with nothing; rows without an id have a null component and link with
nothing; repeated rows get the same result, one row each; rows that share an id but not the text are one document with the links of
all its texts, each row with its own number of shingles; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import discard, materialise, release, small_batches, table

SHINGLE = 5
PERCENT = 80
HEAVY = 1 << 21
HEAVY_LEAST = 16
MATCHES = 4
VERIFY = 8.0
BITMAP = 1 << 26
NEEDED = 500_000
#: A task's counts of shingles are sent on when there are more than this.
COUNTED = 1_000_000
SEEN = 200_000
SKETCH = 512
LEAST_BITS = 1024
LOG_CLASS = float(np.log(100 / PERCENT + 0.01))
BEFORE = 3
LONGS = [f"s{i}" for i in range(SKETCH // 64)]

_U = np.uint64


def _sets(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, hashes = A.windows(chunk.word_hash(), chunk, SHINGLE)
    return A.row_sets(rows, hashes, chunk.n_rows)


def _fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit values of each row's set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x1111, 0x77777):
        sums = np.concatenate([[_U(0)], np.cumsum(A.mix(hashes + _U(salt)))])
        out.append(A.mix((sums[ends] - sums[ends - sizes]) + sizes.astype(np.uint64)))
    return out[0], out[1]


def describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, f, g) and, with null n, of counts within a task (words, times). f and g: the fingerprint of the set."""

    def run(batches):
        ids_type, held, seen = None, [], set()

        def counts():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            u, inverse = np.unique(h, return_inverse=True)
            return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)

        def flush(u, n):
            u, n = u[n >= 2], n[n >= 2]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([u.view(np.int64)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))],
                names=["doc_id", "n", "f", "g", "words", "times"],
            )

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for start, end, chunk in A.chunks(A.text_column(batch, "text"), lower=True):
                rows, hashes, sizes = _sets(chunk)
                node, check = _fingerprints(hashes, sizes)
                k = end - start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, k), pa.array(sizes.astype(np.int64)), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f", "g", "words", "times"],
                )
                new = np.zeros(k, bool)  # copies count once, as far as they are remembered
                if len(seen) > SEEN:
                    seen.clear()
                for i, f in enumerate(node.tolist()):
                    if f not in seen:
                        seen.add(f)
                        new[i] = True
                u, n = np.unique(hashes[new[rows]], return_counts=True)
                held.append((u, n))
                if sum(len(x[0]) for x in held) > COUNTED:
                    u, n = counts()
                    held[:] = [(u, n)]
                    if len(u) > COUNTED * 2 // 3:
                        yield flush(u, n)
        if held:
            yield flush(*counts())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(A.task(run), f"doc_id {kind}, n long, f long, g long, words array<long>, times array<long>")


def _ordered(rows, hashes, sizes, heavy, level, estimate):
    """Hashes of each row in the order of (level, hash), and their estimates."""
    own, guess = np.zeros(len(hashes), np.int8), np.ones(len(hashes))
    if len(heavy) and len(hashes):
        at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
        hit = heavy[at] == hashes
        own[hit], guess[hit] = level[at[hit]], estimate[at[hit]]
        order = np.lexsort((hashes, own, rows))
        hashes, guess = hashes[order], guess[order]
    return hashes, guess


def choose_prefixes(sizes: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matches l, prefix length) of each row by the least cost."""
    first = np.cumsum(sizes) - sizes
    others = np.concatenate([[0.0], np.cumsum(guess - 1)])
    need = -(-sizes * PERCENT // 100)
    best, matches, lengths = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for ell in range(1, MATCHES + 1):
        length = np.maximum(0, sizes - need + ell)
        cost = length + VERIFY * (others[np.minimum(first + length, first + sizes)] - others[first]) / ell
        use = (ell <= np.maximum(need, 1)) & (cost < best - 1e-9)
        best, matches, lengths = np.where(use, cost, best), np.where(use, ell, matches), np.where(use, np.minimum(length, sizes), lengths)
    return matches, lengths


def sketches(rows: np.ndarray, hashes: np.ndarray, n_rows: int, bits: int) -> np.ndarray:
    """Parity bits of each row's set (a row of bytes for each row): bit h mod ``bits`` for each hash h."""
    place = rows * bits + (hashes & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=n_rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_rows, bits), axis=1)


def long_sketches(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each row a sketch of at least twice as many bits as its set has shingles, a power of two."""
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * sizes, LEAST_BITS))).astype(np.int64))
    out = [b""] * len(sizes)
    for b in np.unique(bits):
        own = np.flatnonzero(bits == b)
        new = np.full(len(sizes), -1)
        new[own] = np.arange(len(own))
        for at in range(0, len(own), step := max(1, (1 << 24) // int(b))):
            part = own[at : at + step]
            use = (new[rows] >= at) & (new[rows] < at + len(part))
            for i, row in zip(part, sketches(new[rows[use]] - at, hashes[use], len(part), int(b))):
                out[i] = row.tobytes()
    return out


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits that differ when the longer sketch is folded to the length of the shorter: no more than the shingles that differ."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(BITMAP))


class Marks:
    """A broadcast bitmap of BITMAP bits over hashes of ids: without a bit, an id is not among them."""

    def __init__(self, ids: DataFrame, id_col: str):
        words = ids.select(_place(id_col).alias("p")).groupBy(F.expr("p div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b"))
        got = words.toArrow()  # BITMAP / 32 rows at most
        bits = np.zeros(BITMAP // 32, dtype=np.uint32)
        if got.num_rows:
            bits[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
        self.held = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def test(bits: np.ndarray, places: pa.Array) -> np.ndarray:
        p = places.to_numpy()
        return ((bits[p // 32] >> (p % 32).astype(np.uint32)) & 1).astype(bool)

    def destroy(self) -> None:
        self.held.destroy()


def prefixes(docs: DataFrame, reps: DataFrame, heavy: np.ndarray, estimate: np.ndarray) -> tuple[DataFrame, Callable[[], None]]:
    """node, n, ell, prefix (array of hashes) and sketches of the documents ``reps`` (node), and what ends the broadcasts."""
    place = np.argsort(heavy)
    heavy, estimate = heavy[place], estimate[place].astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((heavy, np.log2(np.maximum(estimate, 1)).astype(np.int8), estimate))  # HEAVY shingles at most
    marks = Marks(reps, "node")
    marked = marks.held

    def run(batches):
        heavy, level, estimate = held.value
        bits = marked.value
        for batch in batches:
            take = np.flatnonzero(Marks.test(bits, batch.column(2)))
            if not len(take):
                continue
            batch = batch.take(pa.array(take))
            for start, end, chunk in A.chunks(A.text_column(batch, "text"), lower=True):
                rows, hashes, sizes = _sets(chunk)
                sketch = sketches(rows, hashes, len(sizes), SKETCH).view(np.int64)
                long_ = long_sketches(rows, hashes, sizes)
                hashes, guess = _ordered(rows, hashes, sizes, heavy, level, estimate)
                matches, lengths = choose_prefixes(sizes, guess)
                first = np.cumsum(sizes) - sizes
                own = np.flatnonzero(sizes > 0)
                offsets = np.concatenate([[0], np.cumsum(lengths[own])])
                at = np.repeat(first[own] - offsets[:-1], lengths[own]) + np.arange(offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[at].view(np.int64)))
                ids = batch.column(0).slice(start, end - start).take(pa.array(own))
                longs = [pa.array(np.ascontiguousarray(sketch[own, i])) for i in range(len(LONGS))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[own].astype(np.int32)), pa.array(matches[own].astype(np.int32)), lists, pa.array([long_[i] for i in own], pa.binary()), *longs], names=["node", "n", "ell", "prefix", "sketch", *LONGS])

    def end():
        held.destroy()
        marks.destroy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in LONGS)
    found = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _place("doc_id").alias("p")).mapInArrow(A.task(run), f"node {kind}, n int, ell int, prefix array<long>, sketch binary, {longs}")
    return found.join(reps, "node", "left_semi"), end


def _needed_sets(docs: DataFrame, needed: DataFrame, marks: Marks) -> DataFrame:
    """``needed`` (doc_id and further columns) with the sets of its documents as ``tokens``: ascending 64-bit hashes.

    ``needed`` is broadcast if it has at most ``NEEDED`` rows, else joined by a shuffle.
    """
    held = marks.held

    def run(batches):
        bits = held.value
        for batch in batches:
            take = np.flatnonzero(Marks.test(bits, batch.column(2)))
            if not len(take):
                continue
            batch = batch.take(pa.array(take))
            for start, end, chunk in A.chunks(A.text_column(batch, "text"), lower=True):
                _, hashes, sizes = _sets(chunk)
                raw, cut = hashes.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 8
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _place("doc_id").alias("p")).mapInArrow(A.task(run), f"doc_id {kind}, tokens binary")
    return sets.join(F.broadcast(needed) if needed.count() <= NEEDED else needed, "doc_id").drop("doc_id")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The written pairs (a, b) of nodes whose whole sets link."""
    members = pairs.select("a", "b", F.col("a").alias("doc_id"))
    hubs = materialise(pairs.select("b").distinct().select("b", F.col("b").alias("doc_id")), "jaccard-hubs")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                    if len(x) > len(y):
                        x, y = y, x
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    of_members, of_hubs = Marks(members, "doc_id"), Marks(hubs, "doc_id")
    left = _needed_sets(docs, members, of_members).withColumnRenamed("tokens", "ta")
    right = _needed_sets(docs, hubs, of_hubs).withColumnRenamed("tokens", "tb")
    both = left.join(right, "b").select("a", "b", "ta", "tb")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = materialise(both.mapInArrow(A.task(run), f"a {kind}, b {kind}").distinct(), "jaccard-links")
    of_members.destroy()
    of_hubs.destroy()
    discard(hubs)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): equal labels where connected. Contraction to the least neighbour."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-edges")
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = None
    while not edges.isEmpty():
        least = materialise(both(edges).groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "cc-least")
        to = lambda old, new: least.select(F.col("u").alias(old), F.col("to").alias(new))  # noqa: B023, E731
        step = edges.join(to("a", "a2"), "a").join(to("b", "b2"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        step = materialise(step.filter("a < b").distinct(), "cc-edges")
        if labels is None:
            new = least.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            new = labels.join(to("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = materialise(new, "cc-labels")
        for old in (edges, least, labels):
            if old is not None:
                discard(old)
        edges, labels = step, new
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _may_meet() -> Column:
    """Sizes allow a link, and the shared shingle, the pa-th and the pb-th of its sets, is in the prefixes that the sizes of both ask for.

    A link between sets of na and nb shares at least o = ceil(80 (na + nb) / 180) shingles, so it shares l of the first
    na - o + l of the one and nb - o + l of the other, in any order of shingles, for any l up to o. These are parts of the stored prefixes, as o
    is at least 80 na / 100 and 80 nb / 100.
    """
    o = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT) - 1e-9)
    ell = F.least("la", "lb")
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return sizes & (F.col("pa") < F.col("na") - o + ell) & (F.col("pb") < F.col("nb") - o + ell)


def _may_link(x: str, y: str) -> Column:
    """Sketches (columns x0, y0 ...) allow a link: the union has at least (na + nb + differences) / 2 shingles."""
    apart = sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(1, len(LONGS))), F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0"))))
    both = F.col("na") + F.col("nb")
    return 100 * (both - apart) >= PERCENT * (both + apart)


def _size_class(n: str) -> Column:
    """Sets that link are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / LOG_CLASS)


def _side(rows: DataFrame, x: str, sketch: str = "") -> list[Column]:
    """Columns of one side of a pair: x (node), n, l, p and its sketch."""
    return [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("ell").alias(f"l{x}"), F.col("pos").alias(f"p{x}"), *[F.col(c).alias(f"{sketch}{i}") for i, c in enumerate(LONGS) if sketch]]


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and apart (bits) of the pairs (a, na, b, nb) whose long sketches allow a link."""

    def run(batches):
        for batch in batches:
            apart = np.array([bits_apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5))], dtype=np.int64)
            both = batch.column(1).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = pa.array(100 * (both - apart) >= PERCENT * (both + apart))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep), pa.array(apart).filter(keep)], names=["a", "b", "apart"])

    sketch = lambda node: nodes.select(F.col("node").alias(node), F.col("n").alias(f"n{node}"), F.col("sketch").alias(f"s{node}"))
    wide = pairs.select("a", "na", "b", "nb").join(sketch("b"), ["b", "nb"]).join(sketch("a"), ["a", "na"]).select("a", "na", "b", "nb", "sa", "sb")
    kind = nodes.schema["node"].dataType.simpleString()
    return wide.mapInArrow(A.task(run), f"a {kind}, b {kind}, apart long")


def _stars(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): for each node the hub whose sketch is nearest, of those with which it shares enough prefix shingles.

    The hub of a list is the node with the greatest share of its prefix in other sets, as the source of copies has.
    """
    share = F.col("c") / (F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + F.col("ell"))
    weight = posts.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    hubs = posts.join(weight, "node").groupBy("h").agg(F.max(F.struct(share.alias("share"), "c", "node", "n", "ell", "pos")).alias("m"))
    hubs = hubs.select("h", "m.*").select("h", *_side(hubs, "b"))
    near = posts.select("h", *_side(posts, "a")).join(hubs, "h").filter((F.col("a") != F.col("b")) & _may_meet())
    near = near.groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= F.least("la", "lb"))
    return _sketched(near, nodes).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _rest(posts: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b, apart): pairs of different components that share enough prefix shingles, of those that sizes and sketches allow.

    Where one shared shingle is enough, a pair comes out of few of the lists that it shares: not where one of the last BEFORE
    shingles of both is the same, as it has come out of that one's list.
    """
    posts = posts.join(part, "node", "left").select("h", "node", "n", "ell", "pos", F.coalesce("label", "node").alias("comp"))
    largest = posts.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k"))
    largest = largest.filter("k > 1").select("h", F.col("m.comp").alias("top"))
    open_ = posts.join(largest, "h").join(nodes.select("node", "n", *LONGS), ["node", "n"])
    order = W.partitionBy("node", "n").orderBy("pos")
    before = F.array(*[F.lag("h", k).over(order) for k in range(1, BEFORE + 1)])
    open_ = materialise(open_.withColumns({"size": _size_class("n"), "before": F.array_compact(before)}), "jaccard-open")
    x = open_.filter("comp <> top").select("h", *_side(open_, "a", "x"), F.col("comp").alias("ca"), F.col("before").alias("ea"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    # the least size of a class tells how long a prefix it can ask for
    least = F.greatest(F.exp(F.col("size") * LOG_CLASS), F.col("na") * PERCENT / 100)
    x = x.filter(F.col("pa") < F.col("na") - (F.col("na") + least) * PERCENT / (100 + PERCENT) + 1e-6 + F.col("la"))
    y = open_.select(F.col("h").alias("h2"), F.col("size").alias("size2"), *_side(open_, "b", "y"), F.col("comp").alias("cb"), F.col("before").alias("eb"), "top")
    fits = (F.col("h") == F.col("h2")) & (F.col("size") == F.col("size2")) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("top")) | (F.col("a") < F.col("b"))) & _may_meet() & _may_link("x", "y")
    pairs = x.join(y, fits & ((F.least("la", "lb") > 1) | ~F.arrays_overlap("ea", "eb")))
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(swap, F.col(f"{k}b")).otherwise(F.col(f"{k}a")).alias(f"{k}a") for k in "nl"], *[F.when(swap, F.col(f"{k}a")).otherwise(F.col(f"{k}b")).alias(f"{k}b") for k in "nl"])
    pairs = pairs.groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= F.least("la", "lb"))
    out = materialise(_sketched(pairs, nodes).groupBy("a", "b").agg(F.min("apart").alias("apart")), "jaccard-rest")
    discard(open_)
    return out


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_verified (links of its class that were verified to connect components) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = materialise(describe(docs), "jaccard-sets")
    ids = seen.filter("n IS NOT NULL").select("doc_id", "n", "f", "g")
    classes = materialise(ids.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f", "g").agg(F.min("doc_id").alias("node")), "jaccard-classes")
    total = ids.agg(F.sum("n")).first()[0] or 0
    counted = seen.filter("n IS NULL").select(F.explode(F.arrays_zip("words", "times")).alias("e")).select("e.words", "e.times")
    heavy = counted.groupBy("words").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(HEAVY_LEAST, -(-total // HEAVY))).toArrow()
    nodes, end = prefixes(docs, classes.select("node").distinct(), heavy.column("words").to_numpy().view(np.uint64), heavy.column("times").to_numpy())
    del heavy
    nodes = materialise(nodes, "jaccard-nodes")
    end()
    release(spark)

    posts = nodes.select("node", "n", "ell", F.posexplode("prefix").alias("pos", "h"))
    shared = posts.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("h")
    posts = materialise(posts.join(shared, "h").dropDuplicates(["h", "node", "n"]).select("h", "node", "n", "ell", "pos"), "jaccard-posts")
    star = materialise(_stars(posts, nodes), "jaccard-star")
    first = verify(docs, star)
    discard(star)
    part = components(first)
    release(spark)

    rest = _rest(posts, nodes, part)
    discard(posts)
    discard(nodes)
    # each node's best pair first: what that connects need not be verified
    ends = rest.select("a", "b", "apart", F.col("a").alias("end")).union(rest.select("a", "b", "apart", F.col("b").alias("end")))
    best = ends.groupBy("end").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    best = materialise(best, "jaccard-best")
    second = verify(docs, best)
    discard(part)
    part = components(first.union(second))
    name = lambda side: part.select(F.col("node").alias(side), F.col("label").alias(f"c{side}"))
    last = rest.select("a", "b").join(best, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
    last = materialise(last.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "jaccard-last")
    discard(rest)
    discard(best)
    third = verify(docs, last)
    discard(last)
    discard(part)
    release(spark)
    links = first.union(second).union(third)
    part = components(links)

    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    # a component's least node is its label, and a class's least id its node: the label is the smallest id that links reach
    of = classes.join(part, "node", "left").join(degree, "node", "left")
    of = of.select("f", "g", F.coalesce("label", "node").alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"))
    out = ids.join(of, ["f", "g"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"))
    out = materialise(out, "jaccard-result")
    for frame in (seen, classes, first, second, third, part):
        discard(frame)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``: of each component the document with the smallest id, once; every row without shingles or id stays.

    Only rows that the bitmap of dropped and repeated ids marks are shuffled; all others are kept where they are.
    """
    names = docs.columns
    result = join_components(docs, id_col, text_col)
    drop = result.filter("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    again = result.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("_drop"))
    held = Marks(drop.union(again), "_drop").held
    schema = docs.schema

    def part(marked: bool):
        def run(batches):
            bits = held.value
            for batch in batches:
                ids, places = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                hit = Marks.test(bits, places) & ids.to_numpy(zero_copy_only=False)
                rest = batch.select(list(range(batch.num_columns - 2)))
                yield rest.filter(pa.array(hit == marked))

        wide = docs.select(*[F.col(f"`{n}`") for n in names], F.col(id_col).isNotNull().alias("_has"), _place(id_col).alias("_place"))
        return wide.mapInArrow(A.task(run), schema)

    maybe = part(True)
    maybe = maybe.join(drop, maybe[id_col] == drop["_drop"], "left_anti")
    order = F.row_number().over(W.partitionBy(id_col).orderBy(*[F.col(f"`{n}`") for n in names if n != id_col]))
    maybe = maybe.withColumn("_rank", order).filter("_rank = 1").select(*[F.col(f"`{n}`") for n in names])
    return part(False).union(maybe)


def op7_adaptive_prefix_join(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, then everything within reach: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                          WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""
