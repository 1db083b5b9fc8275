"""IP addresses as 16-byte keys whose byte order is address order. IPv4 is stored as an IPv4-mapped IPv6 address."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAPPED = int.from_bytes(b"\x00" * 10 + b"\xff\xff" + b"\x00" * 4, "big")


def _number(text: str) -> int:
    address = ipaddress.ip_address(text)
    return int(address) + (_MAPPED if address.version == 4 else 0)


def _key(n: int) -> str:
    return f"X'{n:032X}'"


def range_of(text: str) -> tuple[int, int]:
    """First and last number of an address, a CIDR block, or IPv4 with trailing ``*`` octets."""
    text = text.strip()
    if "*" in text:
        parts = text.split(".")
        if len(parts) != 4 or not re.fullmatch(r"(\d+\.)*\*(\.\*)*", text):
            raise ValueError(f"wildcards must be the last octets of an IPv4 address: {text!r}")
        low, high = (".".join(p if p != "*" else end for p in parts) for end in ("0", "255"))
        return _number(low), _number(high)
    if "/" in text:
        block = ipaddress.ip_network(text, strict=False)
        return _number(str(block[0])), _number(str(block[-1]))
    return _number(text), _number(text)


def key_sql(column_sql: str) -> str:
    """SQL key of IPv4 text, in plain expressions; NULL for anything else."""
    octet = lambda i: f"lpad(hex(cast(regexp_extract({column_sql}, '^(\\\\d{{1,3}})\\\\.(\\\\d{{1,3}})\\\\.(\\\\d{{1,3}})\\\\.(\\\\d{{1,3}})$', {i}) AS int)), 2, '0')"
    valid = f"{column_sql} RLIKE '^((25[0-5]|2[0-4]\\\\d|1?\\\\d?\\\\d)\\\\.){{3}}(25[0-5]|2[0-4]\\\\d|1?\\\\d?\\\\d)$'"
    return f"CASE WHEN {valid} THEN unhex(concat('00000000000000000000FFFF', {', '.join(octet(i) for i in range(1, 5))})) END"


@F.pandas_udf(T.BinaryType())
def _any_key(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else _number(text.strip()).to_bytes(16, "big")
        except ValueError:
            return None

    return texts.map(one)


def ip_key(column: str, v4_only: bool = False) -> Column:
    """16-byte key; IPv6 text goes through a pandas UDF, IPv4 text stays in SQL with ``v4_only``."""
    from skyquill.functions.text import name

    return F.expr(key_sql(name(column))) if v4_only else _any_key(F.col(column))


def match_sql(key_sql_: str, text: str) -> str:
    """SQL test of a key against an address, block or wildcard."""
    low, high = range_of(text)
    return f"({key_sql_} = {_key(low)})" if low == high else f"({key_sql_} BETWEEN {_key(low)} AND {_key(high)})"
