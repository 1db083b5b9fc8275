"""Bucket functions for GROUP BY: deterministic scalars that Catalyst folds into an ordinary hash aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def interval_micros(text: str) -> int:
    """Microseconds of ``15m``, ``1h``, ``500ms``; may be negative for offsets."""
    found = re.fullmatch(r"([+-]?\d+)(ms|s|m|h|d)", text.strip())
    if not found:
        raise ValueError(f"not an interval (a number and ms, s, m, h or d): {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def date_histogram(column: str | Column, interval: str, offset: str = "0ms") -> Column:
    """Start of the bucket of a timestamp or date."""
    step, off = interval_micros(interval), interval_micros(offset)
    if step <= 0:
        raise ValueError(f"the interval must be positive: {interval!r}")
    micros = F.unix_micros(_column(column).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(off), F.lit(step)))


def histogram(column: str | Column, width: float, offset: float = 0.0) -> Column:
    """Lower bound of the bucket of a number, as a double."""
    if not width > 0:
        raise ValueError(f"the width must be positive: {width!r}")
    return F.floor((_column(column).cast("double") - offset) / width).cast("double") * width + offset


def range_bucket(column: str | Column, *ranges: tuple[str, float | None, float | None]) -> Column:
    """Name of the range [from, to) that holds the number; NULL outside of all. Ranges must not overlap."""
    if not ranges:
        raise ValueError("at least one range is needed")
    spans = []
    for label, low, high in ranges:
        if low is None and high is None:
            raise ValueError(f"range {label!r} needs a bound")
        if low is not None and high is not None and not low < high:
            raise ValueError(f"range {label!r} is empty")
        spans.append((float("-inf") if low is None else low, float("inf") if high is None else high, label))
    spans.sort()
    for (_, end, a), (begin, _, b) in zip(spans, spans[1:]):
        if begin < end:
            raise ValueError(f"ranges {a!r} and {b!r} overlap")
    value, out = _column(column), None
    for low, high, label in spans:
        inside = F.lit(True)
        if low != float("-inf"):
            inside = inside & (value >= low)
        if high != float("inf"):
            inside = inside & (value < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bucket_counts(df: DataFrame, bucket: Column, *aggregates: Column, keys: tuple[str, ...] = (), min_doc_count: int = 1, label: str = "bucket", bounds: tuple | None = None) -> DataFrame:
    """Group by a bucket and further keys. NULL buckets are left out; ``bounds`` keeps buckets from the first to the last."""
    out = df.withColumn(label, bucket).filter(F.col(label).isNotNull())
    if bounds is not None:
        out = out.filter(F.col(label).between(*bounds))
    out = out.groupBy(label, *keys).agg(F.count(F.lit(1)).alias("doc_count"), *aggregates)
    return out.filter(F.col("doc_count") >= min_doc_count) if min_doc_count > 1 else out


def fill_histogram(counts: DataFrame, width: float, label: str = "bucket", bounds: tuple[float, float] | None = None) -> DataFrame:
    """Adds the empty buckets between the first and the last one (or ``bounds``), with a count of 0."""
    edges = counts.agg(F.min(label).alias("a"), F.max(label).alias("b"))
    if bounds is not None:
        edges = edges.select(F.least("a", F.lit(float(bounds[0]))).alias("a"), F.greatest("b", F.lit(float(bounds[1]))).alias("b"))
    grid = edges.filter("a IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(0), F.round((F.col("b") - F.col("a")) / width).cast("int")), lambda i: F.col("a") + i * width)).alias(label))
    return grid.join(counts, label, "left").na.fill(0, ["doc_count"])


#: Microseconds of the units of an interval's text.
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def _micros(text: str) -> str:
    """SQL for the microseconds of '15m', '1h', '-6h'; digits alone are microseconds. Catalyst folds it for literals."""
    unit = " ".join(f"WHEN '{u}' THEN {n}" for u, n in _UNITS.items())
    return f"(CAST(regexp_extract({text}, '^([+-]?[0-9]+)(ms|s|m|h|d|w)?$', 1) AS BIGINT) * CASE regexp_extract({text}, '^([+-]?[0-9]+)(ms|s|m|h|d|w)?$', 2) {unit} ELSE 1 END)"


def register(spark: SparkSession) -> None:
    """SQL functions, which Catalyst inlines.

    ``sq_histogram(x, width, offset)``; ``sq_date_histogram(ts, '1h', '15m')``, with numbers in microseconds; ``sq_range_bucket(x, names, lows, highs)``, NULL bounds being
    open; ``sq_match(text, words)`` and ``sq_match_phrase(text, words)`` on tokens; and the table function ``sq_tokens(text)``.
    """
    from skyquill.functions.text import token_sql

    make = lambda text: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    make("sq_histogram(x DOUBLE, width DOUBLE, off DOUBLE DEFAULT 0.0) RETURNS DOUBLE RETURN floor((x - off) / width) * width + off")
    make(f"sq_date_histogram(ts TIMESTAMP, step STRING, off STRING DEFAULT '0') RETURNS TIMESTAMP RETURN timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - {_micros('off')}, {_micros('step')}))")
    inside = "x IS NOT NULL AND (r.lows IS NULL OR x >= r.lows) AND (r.highs IS NULL OR x < r.highs)"
    make(f"sq_range_bucket(x DOUBLE, names ARRAY<STRING>, lows ARRAY<DOUBLE>, highs ARRAY<DOUBLE>) RETURNS STRING RETURN get(filter(arrays_zip(names, lows, highs), r -> {inside}), 0).names")
    own, asked = token_sql("t"), token_sql("q")
    make(f"sq_match(t STRING, q STRING) RETURNS BOOLEAN RETURN coalesce(size({asked}) > 0 AND forall({asked}, w -> array_contains({own}, w)), false)")
    make(f"sq_match_phrase(t STRING, q STRING) RETURNS BOOLEAN RETURN coalesce(size({asked}) > 0 AND contains(concat(' ', array_join({own}, ' '), ' '), concat(' ', array_join({asked}, ' '), ' ')), false)")
    make(f"sq_tokens(t STRING) RETURNS TABLE (token STRING) RETURN SELECT explode({own}) AS token")
