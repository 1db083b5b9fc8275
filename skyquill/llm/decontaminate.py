"""Benchmark decontamination by template canonicalisation.

A text becomes a run of tokens: words without the marks around them, A-Z lower-cased; words without a letter or digit are no
tokens. Numbers, names and units become typed placeholders. A number starts with a digit; a unit is a word of ``UNITS``
after a number; a name starts with A-Z before a lower-case letter. What begins a sentence or line may be a name or a
plain word with a capital, so texts have both readings; and each is taken with every placeholder by itself and with a run
of names or of numbers as one (Anna, Mary Ann). Windows of ``WINDOW`` tokens of a reading are hashed, those of items if they
have at least ``LITERALS`` words that are plain in some reading, and the windows of documents join those of the benchmark on
the hash, each reading with the same one.

Matches of a document and an item are aligned by the difference of their places. Slots have to be consistent over the whole of an
alignment: a value of the item always stands for the same value of the document, and the other way round. A document leaks an item if
some alignment does so and covers ``RUN`` tokens of it, or all its windows; or if the windows without any changed value alone cover as
much. So a question with other numbers and names is found like a verbatim one, and one whose names or numbers do not go together is not.

Items are also compared by their words alone, values included, whatever their case: in windows of ``WINDOW`` tokens, so that capitals or small
letters throughout hide no copy. For items without a template window (short ones, or hardly a plain word) that is the only way: items of
``SHORT`` tokens and more anywhere in a document, in windows of up to ``WINDOW`` tokens; items of fewer tokens with whole documents.

The join is on the hash in either case. If the benchmark has at most ``HELD`` windows (a checked bound), tasks also hold
their hashes and emit no other windows; beyond that, all windows go to the join.

Defined cases: null and empty texts, and texts without a letter or digit, match nothing; repeated rows give one result for their id; rows
that share an id, and rows without one, are judged as one document; equal items are all found; further columns are ignored,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import materialise, small_batches, table

WINDOW = 8
LITERALS = 4
RUN = 13
SHORT = 4
HELD = 2_000_000
READINGS = [(0, 0), (1, 0), (0, 1), (1, 1)]  # see Tokens.reading
#: Numbers of the readings without placeholders: windows of that many tokens, and whole texts of that many.
EXACT, WHOLE = {n: 10 + n for n in range(SHORT, WINDOW + 1)}, {n: 30 + n for n in range(1, SHORT)}
# What counts as a unit after a number.
UNITS = (
    "% am apples bags bottles boxes cents cl cm coins days degrees dollar dollars eur euro euros feet foot ft g gallons gb gram grams hour hours hrs inch inches kb kg kilograms "
    "kilometers kilometres km kmh l lb lbs liters litres m marbles mb meters metres mg mi mile miles min minutes ml mm mph months ounces oz people pence percent pounds seconds "
    "sec tb times tons usd w watts weeks yards years"
).split()

_U = np.uint64
NUMBER, NAME, UNIT, WORD = 1, 2, 3, 0
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[[*range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _chunk_of(texts: list[str]) -> A.Chunk:
    return next(c for _, _, c in A.chunks(pa.array(texts, pa.string()), lower=True, limit=1 << 30))


_unit_hashes: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _unit_hashes:
        _unit_hashes.append(np.sort(_chunk_of(UNITS).word_hash()))
    return _unit_hashes[0]


class Tokens:
    """Tokens of a chunk: row, place within the row, kind, span, hash of what stands there, and whether it is plain."""

    def __init__(self, chunk: A.Chunk):
        data = chunk.data
        low = A.Chunk(A._LOWER[data], chunk.starts, chunk.ends, chunk.row, chunk.first, chunk.count)
        place = np.arange(len(data))
        alnum = _ALNUM[data]
        last_before = np.maximum.accumulate(np.where(alnum, place, -1)) if len(data) else place
        first_after = np.minimum.accumulate(np.where(alnum, place, len(data))[::-1])[::-1] if len(data) else place
        keep = np.flatnonzero(first_after[chunk.starts] < chunk.ends) if len(chunk.starts) else np.zeros(0, np.int64)
        self.start, self.end = first_after[chunk.starts[keep]], last_before[chunk.ends[keep] - 1] + 1
        self.row = chunk.row[keep]
        lines = np.cumsum(data == 10)
        begin = np.ones(len(keep), bool)
        if len(keep) > 1:
            same = self.row[1:] == self.row[:-1]
            begin[1:] = ~same | _STOP[data[chunk.ends[keep[:-1]] - 1]] | (lines[self.start[1:]] != lines[self.start[:-1]])
        number = _DIGIT[data[self.start]]
        second = data[np.minimum(self.start + 1, len(data) - 1)] if len(data) else data
        capital = _UPPER[data[self.start]] & (self.end - self.start > 1) & _SMALL[second]
        words = low.span_hash(self.start, self.end)
        after = np.zeros(len(keep), bool)
        if len(keep) > 1:
            after[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        units = _units()
        unit = after & (units[np.minimum(np.searchsorted(units, words), len(units) - 1)] == words)
        self.begin = begin
        self.kinds = [np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))) for name in (capital & ~begin, capital)]
        self.plain = self.kinds[0] == WORD
        self.value = words
        first = np.searchsorted(self.row, np.arange(chunk.n_rows))
        self.place = np.arange(len(keep)) - first[self.row]

    def exact(self, number: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(first token, hash of the words) of every window of a reading of EXACT or WHOLE, and its length."""
        size = number - 10 if number < 30 else number - 30
        n = len(self.value) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), size
        h = np.full(n, number, np.uint64)
        for j in range(size):
            h = h * _U(A._BASE) + self.value[j : n + j]
        fits = self.row[:n] == self.row[size - 1 :]
        if number >= 30:
            fits &= (self.place[:n] == 0) & (np.bincount(self.row, minlength=1)[self.row[:n]] == size)
        at = np.flatnonzero(fits)
        return at, A.mix(h[at]), size

    def reading(self, names: int, runs: int) -> "Reading":
        """``names``: 1 if what begins a sentence with a capital is a name; ``runs``: 1 if a run of names or of numbers is one."""
        kind = self.kinds[names]
        head = np.ones(len(kind), bool)
        if runs and len(kind) > 1:
            alike = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUMBER))
            head[1:] = ~(alike & (self.row[1:] == self.row[:-1]) & ~self.begin[1:])
        return Reading(self, kind, np.flatnonzero(head), names + 2 * runs)


class Reading:
    """Tokens of one reading: row, place, kind, hash and value, and the first and last of the text's tokens in each."""

    def __init__(self, tokens: Tokens, kind: np.ndarray, heads: np.ndarray, number: int):
        last = np.append(heads[1:], len(kind)) - 1
        self.number = number
        self.row, self.kind, self.plain = tokens.row[heads], kind[heads], tokens.plain[heads]
        self.first, self.last = tokens.place[heads], tokens.place[last] if len(heads) else tokens.place[heads]
        # a sentence's first word may be no part of the name it stands before, so the value of such a run leaves it out
        size = last - heads + 1
        without = np.repeat((size > 1) & tokens.begin[heads] & (self.kind == NAME), size)
        weight = np.arange(len(kind)) - np.repeat(heads, size) + 1 - without
        self.value = np.add.reduceat(tokens.value * weight.astype(np.uint64), heads) if len(heads) else tokens.value[heads]
        self.hash = np.where(self.kind == WORD, self.value, A.mix(self.kind.astype(np.uint64)))
        begin = np.searchsorted(self.row, self.row)
        self.place = np.arange(len(heads)) - begin

    def windows(self, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of every window with enough words that are plain when a sentence's first word is no name."""
        n = len(self.hash) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, self.number, np.uint64)
        for j in range(WINDOW):
            h = h * _U(A._BASE) + self.hash[j : n + j]
        plain = np.concatenate([[0], np.cumsum(self.plain)])
        at = np.flatnonzero((self.row[:n] == self.row[WINDOW - 1 :]) & (plain[WINDOW:] - plain[:-WINDOW] >= literals))
        return at, A.mix(h[at])


def template_windows(df: DataFrame, id_col: str, text_col: str, id_name: str, held: np.ndarray | None = None, exact: list[int] | None = None) -> DataFrame:
    """id_name, reading, place in it, first and last token, window (hash) and slots (kind and value of each placeholder, by place) of every window.

    ``exact``: the readings of EXACT and WHOLE to add. None for items: windows need LITERALS plain words, and each text gets its exact reading, too, if it has WINDOW tokens or no window.
    ``held``: hashes of the windows that are wanted.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(id_col).alias(id_name), F.col(text_col).cast("string").alias("text"))
    shared = None
    if held is not None:
        near = np.zeros(1 << 20, bool)
        near[(held & _U((1 << 20) - 1)).astype(np.int64)] = True
        shared = df.sparkSession.sparkContext.broadcast((near, np.sort(held)))  # HELD hashes at most

    slot_type = pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())])
    names_ = [id_name, "reading", "place", "first", "last", "window", "slots"]

    def wanted(at, h):
        near, all_ = shared.value
        maybe = np.flatnonzero(near[(h & _U((1 << 20) - 1)).astype(np.int64)])
        at, h = at[maybe], h[maybe]
        hit = all_[np.minimum(np.searchsorted(all_, h), len(all_) - 1)] == h if len(all_) else np.zeros(len(h), bool)
        return at[hit], h[hit]

    def run(batches):
        for batch in batches:
            for start, end, chunk in A.chunks(A.text_column(batch, "text"), lower=False):
                tokens, own = Tokens(chunk), batch.column(0).slice(start, end - start)

                def rows(row, reading, place, first, last, h, slots):
                    ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(row), reading), place, first, last)]
                    return pa.RecordBatch.from_arrays([own.take(pa.array(row)), *ints, pa.array(h.view(np.int64)), pa.array(slots, pa.list_(slot_type))], names=names_)  # noqa: B023

                bare = np.ones(end - start, bool)
                for number, (names, runs) in enumerate(READINGS):
                    t = tokens.reading(names, runs)
                    at, h = t.windows(LITERALS if exact is None else 0)
                    bare[t.row[at]] = False
                    if shared is not None:
                        at, h = wanted(at, h)
                    if len(at):
                        slots = [[{"at": int(t.place[k]), "kind": int(t.kind[k]), "value": int(t.value[k : k + 1].view(np.int64)[0])} for k in range(i, i + WINDOW) if t.kind[k]] if t.kind[i : i + WINDOW].any() else [] for i in at]
                        yield rows(t.row[at], number, t.place[at], t.first[at], t.last[at + WINDOW - 1], h, slots)
                size = np.minimum(np.bincount(tokens.row, minlength=end - start), WINDOW)
                for number in [*EXACT.values(), *WHOLE.values()] if exact is None else exact:
                    at, h, n = tokens.exact(number)
                    if exact is None:
                        use = (bare[tokens.row[at]] | (number == EXACT[WINDOW])) & (size[tokens.row[at]] == n)
                        at, h = at[use], h[use]
                    if shared is not None:
                        at, h = wanted(at, h)
                    if len(at):
                        yield rows(tokens.row[at], number, tokens.place[at], tokens.place[at], tokens.place[at] + n - 1, h, [[]] * len(at))

    kind = df.schema[id_name].dataType.simpleString()
    return df.mapInArrow(A.task(run), f"`{id_name}` {kind}, reading int, place int, first int, last int, window long, slots array<struct<at:int,kind:int,value:long>>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, item_id, n_matched and n_windows (of the best alignment and of the item), first and last token, n_changed slots; a row for each leak."""
    items = materialise(template_windows(benchmark, item_col, item_text_col, "item_id").distinct(), "template-items")
    exact = sorted(r["reading"] for r in items.filter(F.col("reading") >= 10).select("reading").distinct().collect())  # a few numbers
    held = None
    if items.count() <= HELD:
        held = items.select("window").distinct().toArrow().column("window").to_numpy().view(np.uint64)
    sizes = items.groupBy("item_id", F.col("reading").alias("item_reading")).agg(F.countDistinct("place").alias("n_windows"))
    bench = items.select("item_id", F.col("reading").alias("item_reading"), F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"))
    found = template_windows(docs, id_col, text_col, "doc_id", held, exact)
    pairs = F.transform(F.arrays_zip(F.col("slots.kind").alias("k"), F.col("slots.value").alias("d"), F.col("item_slots.value").alias("i")), lambda e: F.struct(e["k"].alias("k"), e["d"].alias("d"), e["i"].alias("i")))
    hits = found.join(bench, "window").select("doc_id", "item_id", "reading", "item_reading", (F.col("place") - F.col("item_place")).alias("shift"), "first", "last", "item_place", F.array_distinct(pairs).alias("pairs"))
    key = ["doc_id", "item_id", "reading", "item_reading", "shift"]
    changed = F.exists("pairs", lambda e: e["d"] != e["i"])
    verbatim = F.when(~changed, F.col("item_place"))
    # an alignment has no more windows, and so no more slots, than the item
    runs = hits.groupBy(*key).agg(
        F.size(F.collect_set("item_place")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.size(F.collect_set(verbatim)).alias("n_same"), F.min(F.when(~changed, F.col("first"))).alias("first_same"), F.max(F.when(~changed, F.col("last"))).alias("last_same"),
    )
    sides = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda e: F.struct(e["k"].alias("k"), e[side].alias("v")))))
    runs = runs.withColumn("one_to_one", (sides("d") == F.size("pairs")) & (sides("i") == F.size("pairs")))
    runs = runs.join(sizes.select(F.col("item_id").alias("_item"), F.col("item_reading").alias("_reading"), "n_windows"), F.expr("item_id <=> _item AND item_reading = _reading"))
    covers = lambda n: (F.col(n) > 0) & ((F.col(n) + WINDOW - 1 >= RUN) | (F.col(n) >= F.col("n_windows")))
    whole = F.col("one_to_one") & covers("n")
    runs = runs.filter(whole | covers("n_same"))
    pick = lambda a, b: F.when(whole, F.col(a)).otherwise(F.col(b))
    n_changed = F.when(whole, F.size(F.filter("pairs", lambda e: e["d"] != e["i"]))).otherwise(0).cast("long")
    runs = runs.select(*key, "n_windows", pick("n", "n_same").alias("n_matched"), pick("first", "first_same").alias("first"), pick("last", "last_same").alias("last"), n_changed.alias("n_changed"))
    best = runs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", -F.col("n_changed"), -F.col("shift"), "n_windows", "first", "last", "n_changed")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_matched", "m.n_windows", F.col("m.first").alias("first_token"), F.col("m.last").alias("last_token"), "m.n_changed")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document leaks no item."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]), "left_anti")


def op2_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
