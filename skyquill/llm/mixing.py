"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w out of the sum W gets the mean repetition rate ``size * (w / W) / n`` for its n documents,
where ``size`` is the wanted number of rows. Each document's number of copies is the inverse of the Poisson
distribution at a uniform value from the md5 of seed, id and text: the same on every run and in any order of rows. Rates above
``MAX_RATE`` are the sum of independent draws of equal smaller rate, so no term of the distribution underflows.
Documents are exploded by their count, and the rows are dealt out and sorted by a hash of id and copy number, which
is a global shuffle: every output partition is a uniform draw from the mixture.

The rates are one row per source. Up to ``BROADCAST_SOURCES`` sources (counted first) they are broadcast, so documents are shuffled
once, by the hash; beyond that they are joined by source, where AQE splits a hot one. The copies of a document are spread by
the hash of their number.

Defined cases: a null source is a source of its own; sources without a weight get ``other_weight``; a weight of 0
drops a source; null texts are mixed like others; rows with the same id and text are each drawn with the same value, so
they get the same count; empty tables give empty results. All columns of the input keep their names and values; the new ones are ``copy``
(from 0) and ``shuffle_key``, with as many ``_`` behind as it takes to differ from the input's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm.common import table, unit_interval

SEED = 17
MAX_RATE = 4.0
TERMS = 40
BROADCAST_SOURCES = 100_000


def poisson_count(small: Column, parts: Column, uniform) -> Column:
    """Inverse Poisson distribution of the rate ``small * parts``. ``uniform(part)`` gives the value in [0, 1) for each partial draw."""

    def invert(u: Column) -> Column:
        # c: cumulated probability, t: last term, k: count of cumulated terms that are at most u
        start = F.struct(F.exp(-small).alias("c"), F.exp(-small).alias("t"), F.lit(0).alias("k"))
        step = lambda a, i: F.when(u < a["c"], a).otherwise(
            F.struct((a["c"] + a["t"] * small / i).alias("c"), (a["t"] * small / i).alias("t"), i.alias("k"))
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["k"])

    draws = F.transform(F.transform(F.sequence(F.lit(1), parts), uniform), invert)
    return F.when(small > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(0)


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    other_weight: float = 1.0,
    size: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The mixture: all columns of ``docs``, copy and shuffle_key. ``size`` is the number of rows of ``docs`` if not given."""
    weights = weights or {}
    names = docs.columns
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    weight = F.lit(float(other_weight))
    for source, w in weights.items():
        weight = F.when(F.col("_s") == ("-" if source is None else f"={source}"), F.lit(float(w))).otherwise(weight)
    stats = docs.groupBy(name(source_col).alias("_s")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", weight)
    totals = stats.agg(F.sum("_w").alias("w"), F.sum("_n").cast("double").alias("n"), F.count(F.lit(1)).alias("k")).first()  # three numbers
    wanted, whole = float(size) if size is not None else totals["n"] or 0.0, totals["w"] or 1.0
    rates = stats.withColumn("_rate", F.lit(wanted) * (F.col("_w") / F.lit(whole)) / F.col("_n"))
    rates = rates.select("_s", F.greatest(F.ceil(F.col("_rate") / MAX_RATE), F.lit(1)).cast("int").alias("_parts"), "_rate")
    rates = rates.select("_s", "_parts", (F.col("_rate") / F.col("_parts")).alias("_small"))
    wide = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], name(source_col).alias("_s"), F.col(id_col).cast("string").alias("_id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_m"))
    drawn = wide.join(F.broadcast(rates) if totals["k"] <= BROADCAST_SOURCES else rates, "_s").withColumn(
        "_k", poisson_count(F.col("_small"), F.col("_parts"), lambda p: unit_interval(F.lit(str(seed)), F.coalesce("_id", F.lit("")), F.col("_m"), p.cast("string")))
    )
    copies = drawn.filter("_k > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.coalesce("_id", F.lit("")), F.col("_m"), F.col("_copy").cast("string")))
    copies = copies.withColumn("_key", key)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = copies.repartition(parts, "_key").sortWithinPartitions("_key")
    taken = {n.lower() for n in names}
    free = lambda n: n if n not in taken else free(f"{n}_")
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], F.col("_copy").alias(free("copy")), F.col("_key").alias(free("shuffle_key")))


def op4_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Every source gets the same share of a mixture as large as the table."""
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    return f"""
WITH d AS (SELECT *, coalesce('=' || source, '-') AS s, md5(coalesce(text, '')) AS m, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
r AS (SELECT s, (SELECT CAST(sum(n) AS DOUBLE) FROM n) * (1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM n)) / n AS rate FROM n),
p AS (SELECT d.*, rate, greatest(ceil(rate / {MAX_RATE}), 1)::INTEGER AS parts FROM d JOIN r USING (s)),
u AS (SELECT doc_id, text, lang, source, n_chars, m, id, s, rate / parts AS small,
             unnest(range(1, parts + 1)) AS part FROM p),
v AS (SELECT *, CAST(('0x' || substr(md5('{SEED}|' || id || '|' || m || '|' || part), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM u),
t AS (SELECT *, unnest(range(0, {TERMS + 1})) AS i FROM v),
c AS (SELECT doc_id, text, lang, source, n_chars, m, id, part, x, i, exp(i * ln(small) - small - lgamma(i + 1)) AS q FROM t),
cc AS (SELECT *, sum(q) OVER (PARTITION BY id, m, part ORDER BY i) AS cum FROM (SELECT DISTINCT * FROM c)),
k AS (SELECT id, m, sum(LEAST(hits, {TERMS})) AS k FROM (SELECT id, m, part, count(*) FILTER (WHERE cum <= x) AS hits FROM cc GROUP BY id, m, part) GROUP BY id, m),
e AS (SELECT d.*, unnest(range(0, k.k::BIGINT)) AS copy FROM d JOIN k USING (id, m))
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('{SEED}s|' || id || '|' || m || '|' || copy) AS shuffle_key FROM e
"""


ORACLE = _sql()
