"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where the characters before and after it are not ASCII letters or digits (border check). One strict
term, or ``soft_limit`` different soft terms, block the url. Rules go before the vocabulary: a rule fits its host
and all subdomains of it if the path of the url starts with the rule's path, and the longest rule wins.

Term and rule lists are parameters held by every task; their size does not depend on the table. The built-in ones are an example;
read_lists() takes real ones from a text file of ``strict``, ``soft``, ``block`` or ``allow``, white space and a term or rule on each line.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and its text is still
searched for terms (null: as an empty text, allowed). Repeated rows are judged alike, further columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
STRICT = ["adult", "casino", "escort", "hentai", "porn", "viagra", "xxx"]
SOFT = ["ads", "bet", "bets", "bonus", "cheap", "click", "deals", "farm", "free", "loan", "pills", "poker", "spam", "track", "win"]
SOFT_LIMIT = 2
MAX_LINES = 2_000_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    path = rest[stop:]
    end = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return rest[:stop].translate(_LOWER), path[:end]


class UrlJudge:
    """Rules by host and the automaton; built once in a task."""

    def __init__(self, rules, strict, soft, soft_limit):
        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.rules.setdefault(host, []).append((rule, "/" + path, verdict))
        self.soft_limit = soft_limit
        self.automaton = ahocorasick.Automaton()
        for term in soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        if strict or soft:
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            for rule, start, verdict in self.rules.get(".".join(labels[i:]), ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = (rule, verdict)
        return best

    def terms(self, url: str) -> tuple[set[str], set[str]]:
        """(strict, soft) terms of the url."""
        text = url.translate(_LOWER)
        strict, soft = set(), set()
        if len(self.automaton):
            for end, (term, is_strict) in self.automaton.iter(text):
                before, after = text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2]
                if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
                    (strict if is_strict else soft).add(term)
        return strict, soft

    def __call__(self, url: str | None):
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.terms(url or "")
        return host, path, rule, verdict or ("block" if strict or len(soft) >= self.soft_limit else "allow"), len(strict), len(soft)


def read_lists(spark, path: str) -> dict:
    """rules, strict and soft for judge_urls, from the lines of a file; empty lines and those that begin with # are passed over."""
    line = F.trim(F.col("value"))
    lines = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    if lines.count() > MAX_LINES:
        raise ValueError(f"more than {MAX_LINES} lines in {path}")
    out: dict = {"rules": [], "strict": [], "soft": []}
    for (text,) in lines.distinct().collect():  # MAX_LINES at most
        kind, what = [*text.split(None, 1), ""][:2]
        kind, what = kind.lower(), what.strip()
        if kind in ("block", "allow") and "/" in what:
            out["rules"].append((kind, what.partition("/")[0].translate(_LOWER) + "/" + what.partition("/")[2]))
        elif kind in ("strict", "soft") and what:
            out[kind].append(what.translate(_LOWER))
        else:
            raise ValueError(f"cannot read the line {text!r}")
    return {k: sorted(set(v)) for k, v in out.items()}


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """id_col, host, path, rule, verdict, n_strict and n_soft of every row."""
    df = df.select(id_col, url_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        judge = UrlJudge(rules, strict, soft, soft_limit)
        for batch in batches:
            rows = [judge(u) for u in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            arrays = [pa.array(list(c), type=t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int32()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return df.mapInArrow(A.task(run), f"`{id_col}` {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int")


def op6_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def _sql() -> str:
    fits = lambda rule: f"((host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    hit = lambda term: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, u, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM b),
d AS (SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)} END AS rule,
      {' + '.join(map(hit, STRICT))} AS n_strict, {' + '.join(map(hit, SOFT))} AS n_soft FROM c)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in longest)}
            WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM d
"""


ORACLE = _sql()
