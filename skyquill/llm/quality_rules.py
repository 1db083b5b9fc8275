"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base statistics come from the whole text of each document. Then each distinct
normalised line of a document (lower-cased, runs of white space as one space,
trimmed) is hashed; per host the number of distinct documents with the line is
counted. A line in more than ``max_docs`` of them and in more than ``max_share`` of the host's documents
is removed, but for the text in which it comes with the smallest id: so of a large group of
near copies one always stays whole. A document is
rejected when what is left is under ``min_left_words`` words or under
``min_left_share`` of its words.

Documents of one host with the same text count as one document: otherwise every
line of a widely copied page would look like boilerplate and no copy would stay.

Defined cases: a null text is empty (no words, rejected); a null host is a host of
its own; a null id is the smallest; empty tables give empty results; repeated rows are judged alike and give
one result row each; further columns are ignored. The ids need not be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm.common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
DROPPED = 500_000
MAX_DOCS = 20
MAX_SHARE = 0.1
MIN_LEFT_WORDS = 50
MIN_LEFT_SHARE = 0.2


#: Places of windows take so many low bits beside a window's hash; longer texts sort pairs of hash and place.
PLACE_BITS = 20


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-"))


def _print(text: Column) -> list[Column]:
    """96 bits that stand for the text within a host."""
    return [F.xxhash64(text).alias("_d1"), F.hash(text).alias("_d2")]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the columns in ``keep``."""
    keep = keep or []
    df = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k) for k in keep], _text(text_col).alias("_t"))
    has_word = lambda line: line.rlike(WORD)
    df = df.withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), "_l": F.filter(F.split("_t", "\n"), has_word)})
    h3 = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    symbols = F.when(F.col("_t").rlike(f"[{SYMBOLS}]"), F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).otherwise(0)
    df = df.select(
        "doc_id",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), h3)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # places of windows whose hash comes twice, by one sort: of single numbers (upper bits of the hash, then the place), whose
    # neighbours are compared by their whole hashes; of pairs in texts with more windows than PLACE_BITS can number
    df = df.withColumn("_d", F.size("_h") > F.size(F.array_distinct("_h")))
    low = (1 << PLACE_BITS) - 1
    packed = F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_s", F.when(F.col("_d") & (F.size("_h") <= low), packed))
    df = df.withColumn("_q", F.when(F.col("_d") & (F.size("_h") > low), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    full = lambda x: F.get("_h", x.bitwiseAND(F.lit(low)).cast("int"))
    twin = lambda x, k: (F.get("_s", k).bitwiseXOR(x).bitwiseAND(F.lit(~low)) == 0) & (full(F.get("_s", k)) == full(x))
    same = lambda x, k: F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False))
    places = F.sort_array(F.transform(F.filter("_s", same), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    beside = lambda p, k: F.coalesce(F.get("_q", k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("_q", k + 1)["h"] == p["h"], F.lit(False))
    of_pairs = F.array_sort(F.transform(F.filter("_q", beside), lambda p: p["i"]))
    df = df.withColumn("_p", F.when(F.col("_q").isNotNull(), of_pairs).when(F.col("_s").isNotNull(), places))
    steps = F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3))))
    covered = F.when(F.size("_p") > 0, F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_h", "_d", "_s", "_q", "_p")


def _lines(text: str) -> Column:
    """(_line, _words) of each normalised line of a text: its hash and its number of words."""
    t = F.col(text)
    flat = F.when(t.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(t, r"[\x09\x0B-\x0D\x20]+", " ")).otherwise(t)
    lines = F.filter(F.transform(F.split(F.lower(flat), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("_line"), words(x).alias("_words")))


def frequent_lines(lines: DataFrame, copies: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """_host, _line and the text that keeps it (_k1, _k2) of the lines above the limits.

    Documents are counted by line and text before the shuffle by line.
    """
    texts = lines.groupBy("_host", "_line", "_d1", "_d2").agg(F.min("_id").alias("_id"))
    often = texts.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_d1", "_d2")).alias("_k")).filter(F.col("_n") > max_docs)
    hosts = copies.groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    often = often.join(hosts, "_host").filter(F.col("_n") > F.col("_all") * F.lit(max_share))
    return often.select("_host", "_line", F.col("_k._d1").alias("_k1"), F.col("_k._d2").alias("_k2"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    min_left_words: int = MIN_LEFT_WORDS,
    min_left_share: float = MIN_LEFT_SHARE,
    with_key: bool = False,
) -> DataFrame:
    """Statistics, n_removed_words, base_failed and kept for every row of ``docs``; ``with_key``: also _host, _d1 and _d2.

    Texts are read once: their statistics and lines are written to the shared folder first, a small part of their size.
    """
    key = ["_host", "_d1", "_d2"]
    texts = docs.select(F.col(id_col).alias("_id"), _text(text_col).alias("_text"), _host(host_col).alias("_host"))
    texts = texts.select("*", *_print(F.col("_text")), _lines("_text").alias("_lines"))
    base = materialise(text_statistics(texts, "_id", "_text", [*key, "_lines"]), "quality-lines")
    lines = base.select(*key, F.col("doc_id").alias("_id"), F.inline("_lines"))
    copies = base.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    often = frequent_lines(lines, copies, max_docs, max_share)
    removed = lines.join(often, ["_host", "_line"]).filter((F.col("_d1") != F.col("_k1")) | (F.col("_d2") != F.col("_k2"))).groupBy(*key).agg(F.sum("_words").alias("_removed"))
    removed = removed.join(copies, key).select(*key, F.expr("_removed div _rows").alias("_removed"))
    out = base.drop("_lines").join(removed, key, "left").withColumn("n_removed_words", F.coalesce("_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (left >= min_left_words) & (left >= F.col("n_words") * F.lit(min_left_share))
    return out.withColumn("kept", kept).drop("_removed", *([] if with_key else key))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their columns.

    Verdicts are written first, by host and text; whole texts are only shuffled if more than ``DROPPED`` of them are rejected.
    """
    key = ["_host", "_d1", "_d2"]
    judged = materialise(judge(docs, id_col, text_col=text_col, host_col=host_col, with_key=True, **options), "quality-verdicts")
    drop = judged.filter(~F.col("kept")).select(*[F.col(k).alias(f"_x{k}") for k in key]).distinct()
    drop = F.broadcast(drop) if drop.count() <= DROPPED else drop
    place = [_host(host_col), *_print(_text(text_col))]
    same = place[0] == F.col("_x_host")
    for value, name in zip(place[1:], key[1:]):
        same = same & (value == F.col(f"_x{name}"))
    return docs.join(drop, same, "left_anti")


def op5_quality_line_frequency(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '-') AS host FROM documents),
w AS (SELECT doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 3)) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS raw FROM d),
lw AS (SELECT doc_id, host, t, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS n FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lw WHERE n <> '' GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT host, n, arg_min(t, doc_id) AS keeper FROM lw JOIN hosts USING (host) WHERE n <> '' GROUP BY host, n, docs
          HAVING count(DISTINCT t) > {MAX_DOCS} AND count(DISTINCT t) > docs * CAST({MAX_SHARE} AS DOUBLE)),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(n, '[^ ]+'))) AS n FROM lw JOIN often USING (host, n) WHERE t <> keeper GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT *, (NOT base_failed AND n_words - n_removed_words >= {MIN_LEFT_WORDS}
           AND n_words - n_removed_words >= n_words * CAST({MIN_LEFT_SHARE} AS DOUBLE)) AS kept FROM b
"""
