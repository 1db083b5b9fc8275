"""Tokenizers, compact text forms and size strings, as SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer tokens are dropped, not cut.
MAX_TOKEN = 255
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def quote(text: str) -> str:
    """A SQL string literal; backslashes are written twice, as Spark's parser reads escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column name, with struct fields after dots, quoted for SQL."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in column.split("."))


def token_sql(column_sql: str, tokenizer: str = "default", max_token: int = MAX_TOKEN) -> str:
    """SQL for the array of tokens. default: runs of letters and digits, lower-cased; whitespace: split at white space; raw: the value."""
    if tokenizer in ("default", "en_stem"):
        parts = f"split(lower({column_sql}), '[^\\\\p{{L}}\\\\p{{N}}]+')"
    elif tokenizer == "whitespace":
        parts = f"split({column_sql}, '\\\\s+')"
    elif tokenizer == "raw":
        parts = f"array({column_sql})"
    else:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return f"filter({parts}, t -> t <> '' AND length(t) <= {int(max_token)})"


def tokens(column: str, tokenizer: str = "default", max_token: int = MAX_TOKEN) -> Column:
    if tokenizer == "en_stem":
        from skyquill.functions.stem import stem_tokens

        return stem_tokens(F.expr(token_sql(name(column), "default", max_token)))
    return F.expr(token_sql(name(column), tokenizer, max_token))


def tokenize_query(text: str, tokenizer: str) -> list[str]:
    """The tokens of a query string, by the rules of token_sql."""
    if tokenizer == "raw":
        return [text]
    if tokenizer == "whitespace":
        return text.split()
    found = [t for t in re.split(r"[\W_]+", text.lower()) if t]
    if tokenizer == "en_stem":
        from skyquill.functions.stem import stem

        return [stem(t) for t in found]
    return found


def exact_hash(column: str) -> Column:
    """64-bit hash for equality tests on long identifiers; test the value too (see exact_equals)."""
    return F.xxhash64(F.col(column))


def exact_equals(column: str, hash_column: str, value: str) -> Column:
    """Equality through the stored hash, with the value itself as residual."""
    return (F.col(hash_column) == F.xxhash64(F.lit(value))) & (F.col(column) == value)


def strip_pattern(column: str, pattern: str = UUID) -> Column:
    """The text without what matches."""
    return F.regexp_replace(column, pattern, "")


def extract_pattern(column: str, pattern: str = UUID) -> Column:
    """All matches, as an array of exact terms."""
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def parse_size(text: str | int) -> int:
    """Bytes of ``100M``, ``5G``, ``512K`` or a plain number."""
    found = re.fullmatch(r"\s*(\d+)\s*([kKmMgGtT]?)[bB]?\s*", str(text))
    if not found or int(found[1]) <= 0:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) * 1024 ** " KMGT".index(found[2].upper() or " ")


def lenient_json(column: str) -> Column:
    """The parsed value, or an object with the text under ``_raw`` where it is not JSON."""
    return F.coalesce(F.try_parse_json(column), F.parse_json(F.to_json(F.struct(F.col(column).alias("_raw")))))


def lower_bound(text: str | None, width: int = 32) -> str | None:
    """A cut minimum is still a lower bound."""
    return text if text is None else text[:width]


def upper_bound(text: str | None, width: int = 32) -> str | None:
    """A cut maximum is rounded up; None where that cannot be done."""
    if text is None or len(text) <= width:
        return text
    cut = text[:width]
    while cut:
        if ord(cut[-1]) < 0xD7FF:
            return cut[:-1] + chr(ord(cut[-1]) + 1)
        cut = cut[:-1]
    return None
