"""The search language: a lexer, a recursive-descent parser, and a compiler to one boolean SQL expression.

    spark AND (streaming OR "structured streaming")     config*   *tion   con?ig   serch~1
    title:spark   score:[10 TO 20}   price:>=25   user.city:"Oslo"   ip:10.0.0.0/8   note:*   NOT note:*

Several bare terms mean AND unless ``default_operator`` says otherwise. A search test is never NULL: NOT of a test on a NULL
value holds. As the result is an ordinary expression, Catalyst plans it with everything else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from skyquill.functions import ip as ip_functions
from skyquill.functions.text import MAX_TOKEN, name, quote, token_sql, tokenize_query


class QuerySyntaxError(ValueError):
    """The search string cannot be read."""


class FieldError(ValueError):
    """A field is missing or of the wrong kind for the operator."""


@dataclass(frozen=True)
class Term:
    text: str
    quoted: bool = False
    fuzzy: int | None = None
    field: str | None = None


@dataclass(frozen=True)
class Range:
    low: str | None
    high: str | None
    low_in: bool
    high_in: bool
    field: str | None = None


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Both:
    op: str
    children: tuple


@dataclass(frozen=True)
class All:
    """Every row."""


_LEX = re.compile(
    r"""\s*(?:(?P<paren>[()])
    |(?P<range>[\[{]\s*(?P<low>"[^"]*"|[^\s\]}]+)\s+TO\s+(?P<high>"[^"]*"|[^\s\]}]+)\s*(?P<close>[\]}]))
    |(?P<compare>>=|<=|>|<)
    |(?P<phrase>"(?:[^"\\]|\\.)*")(?:~(?P<slop>\d*))?
    |(?P<field>[A-Za-z_][\w.\-]*):(?!//)
    |(?P<word>(?:\\.|[^\s()"\[\]{}:<>\\]|(?<=\S):(?=\S)|:)+))""",
    re.X,
)


def lex(text: str) -> list[tuple[str, str, dict]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        found = _LEX.match(text, at)
        if not found or found.end() == at:
            raise QuerySyntaxError(f"cannot read {text[at : at + 20]!r} in {text!r}")
        at = found.end()
        kind = found.lastgroup if found.lastgroup not in ("low", "high", "close", "slop") else "range" if found["range"] else "phrase"
        if found["phrase"]:
            kind = "phrase"
        out.append((kind, found[kind], found.groupdict()))
    return out


class _Parser:
    def __init__(self, text: str, default: str):
        self.text, self.tokens, self.at, self.default = text, lex(text), 0, default

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None, {})

    def word(self, *names) -> bool:
        kind, text, _ = self.peek()
        return kind == "word" and text in names

    def parse(self):
        if not self.tokens:
            return All()
        node = self.either(None)
        if self.at < len(self.tokens):
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return node

    def either(self, own):
        parts = [self.each(own)]
        while self.word("OR", "||"):
            self.at += 1
            parts.append(self.each(own))
        return parts[0] if len(parts) == 1 else Both("OR", tuple(parts))

    def each(self, own):
        parts, op = [self.single(own)], self.default
        loose = []
        while True:
            kind, text, _ = self.peek()
            if kind is None or (kind == "paren" and text == ")") or self.word("OR", "||"):
                break
            if self.word("AND", "&&"):
                self.at += 1
                parts.append(self.single(own))
            else:
                loose.append(len(parts))
                parts.append(self.single(own))
        if len(parts) == 1:
            return parts[0]
        if op == "OR" and loose:
            groups, group = [], [parts[0]]
            for i, p in enumerate(parts[1:], 1):
                if i in loose:
                    groups.append(group)
                    group = [p]
                else:
                    group.append(p)
            groups.append(group)
            return Both("OR", tuple(g[0] if len(g) == 1 else Both("AND", tuple(g)) for g in groups))
        return Both("AND", tuple(parts))

    def single(self, own):
        kind, text, groups = self.peek()
        if kind is None:
            raise QuerySyntaxError(f"the query ends too early: {self.text!r}")
        if self.word("NOT", "!"):
            self.at += 1
            return Not(self.single(own))
        if self.word("AND", "OR", "&&", "||"):
            raise QuerySyntaxError(f"{text} without a left side in {self.text!r}")
        self.at += 1
        if kind == "paren":
            if text == ")":
                raise QuerySyntaxError(f"unbalanced ) in {self.text!r}")
            node = self.either(own)
            if self.peek()[:2] != ("paren", ")"):
                raise QuerySyntaxError(f"unbalanced ( in {self.text!r}")
            self.at += 1
            return node
        if kind == "field":
            if self.peek()[0] is None:
                raise QuerySyntaxError(f"nothing after {text}: in {self.text!r}")
            return self.single(text)
        if kind == "range":
            low, high = (None if v == "*" else v.strip('"') for v in (groups["low"], groups["high"]))
            return Range(low, high, text[0] == "[", groups["close"] == "]", own)
        if kind == "compare":
            value = self.peek()
            if value[0] not in ("word", "phrase"):
                raise QuerySyntaxError(f"no value after {text} in {self.text!r}")
            self.at += 1
            bound = value[1].strip('"')
            return Range(bound, None, "=" in text, False, own) if text[0] == ">" else Range(None, bound, False, "=" in text, own)
        if kind == "phrase":
            if groups["slop"] not in (None, "0"):
                raise QuerySyntaxError("phrases with a distance are not supported")
            return Term(re.sub(r"\\(.)", r"\1", text[1:-1]), quoted=True, field=own)
        if text[0] in "+-" and len(text) > 1 and not re.fullmatch(r"[+-]?[\d.]+", text):
            node = self._term(text[1:], own)
            return Not(node) if text[0] == "-" else node
        return self._term(text, own)

    def _term(self, text, own):
        if text == "*" and own is None:
            return All()
        if len(text) > 2 and text[0] == text[-1] == "/":
            raise QuerySyntaxError("regular expressions are not supported")
        if "^" in text:
            raise QuerySyntaxError("boosts are not supported")
        found = re.fullmatch(r"(.+)~(\d?)", text)
        if found:
            distance = int(found[2] or 2)
            if distance > 2:
                raise QuerySyntaxError("the distance of a fuzzy term is 0, 1 or 2")
            return Term(found[1], fuzzy=distance, field=own)
        return Term(text, field=own)


def parse(text: str, default_operator: str = "AND"):
    return _Parser(text, default_operator).parse()


def fields_of(node) -> set:
    if isinstance(node, (Term, Range)):
        return {node.field}
    if isinstance(node, Not):
        return fields_of(node.child)
    return set().union(*map(fields_of, node.children)) if isinstance(node, Both) else set()


@dataclass
class FieldSpec:
    """How a column is searched. kind: text, string, json, ip; by default it follows from the column's type."""

    kind: str | None = None
    tokenizer: str = "default"
    token_column: str | None = None
    key_column: str | None = None
    max_token: int = MAX_TOKEN


@dataclass
class Compiler:
    """Columns of a frame, with what is known about them."""

    schema: T.StructType
    specs: dict[str, FieldSpec] = field(default_factory=dict)
    default_operator: str = "AND"
    max_fields: int = 10

    def type_of(self, path: str) -> T.DataType | None:
        kind: T.DataType = self.schema
        for part in path.split("."):
            if isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if isinstance(kind, T.StructType):
                match = [f for f in kind.fields if f.name.lower() == part.lower()]
                if not match:
                    return None
                kind = match[0].dataType
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            else:
                return None
        return kind

    def spec(self, path: str) -> FieldSpec:
        return self.specs.get(path) or FieldSpec()

    def kind(self, path: str) -> str:
        """text, string, ip, number, time, date, boolean, array, or json (a path into a text column)."""
        own = self.specs.get(path)
        if own and own.kind:
            return own.kind
        kind = self.type_of(path)
        if kind is None:
            root = path.split(".")[0]
            if "." in path and isinstance(self.type_of(root), T.StringType):
                return "json"
            raise FieldError(f"no field {path!r}; there are: {', '.join(self.schema.names)}")
        if isinstance(kind, T.StringType):
            return "string"
        if isinstance(kind, T.NumericType):
            return "number"
        if isinstance(kind, T.BooleanType):
            return "boolean"
        if isinstance(kind, T.DateType):
            return "date"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return "time"
        if isinstance(kind, T.ArrayType):
            return "array"
        raise FieldError(f"{path!r} is of type {kind.simpleString()}, which cannot be searched")

    def value_sql(self, path: str) -> str:
        if self.kind(path) == "json":
            root, rest = path.split(".", 1)
            return f"get_json_object({name(root)}, {quote('$.' + rest)})"
        return name(path)

    # ---- one field

    def test(self, node, path: str) -> str:
        kind = self.kind(path)
        if isinstance(node, Range):
            return self.range(node, path, kind)
        value = self.value_sql(path)
        if node.text == "*" and not node.quoted:
            return f"({value} IS NOT NULL)"
        if kind == "ip":
            spec = self.spec(path)
            key = name(spec.key_column) if spec.key_column else ip_functions.key_sql(value)
            try:
                return f"coalesce({ip_functions.match_sql(key, node.text)}, false)"
            except ValueError as error:
                raise QuerySyntaxError(str(error)) from None
        if kind == "array":
            element = self.type_of(path).elementType
            return f"coalesce(array_contains({value}, CAST({quote(node.text)} AS {element.simpleString()})), false)"
        if kind in ("number", "boolean", "date", "time"):
            return f"coalesce({self.cast(value, kind)} = {self.literal(node.text, kind)}, false)"
        if kind == "text":
            return f"coalesce({self.text(node, path)}, false)"
        return f"coalesce({self.exact(node, value)}, false)"

    def cast(self, value: str, kind: str) -> str:
        return f"CAST({value} AS TIMESTAMP)" if kind == "time" else value

    def literal(self, text: str, kind: str) -> str:
        if kind == "number":
            try:
                float(text)
            except ValueError:
                raise QuerySyntaxError(f"not a number: {text!r}") from None
            if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
                raise QuerySyntaxError(f"not a number: {text!r}")
            return text
        if kind == "boolean":
            if text.lower() not in ("true", "false"):
                raise QuerySyntaxError(f"not true or false: {text!r}")
            return text.lower()
        return f"CAST({quote(text.rstrip('Z') if kind == 'time' else text)} AS {'DATE' if kind == 'date' else 'TIMESTAMP'})"

    @staticmethod
    def like(pattern: str) -> str:
        return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in pattern)

    def text(self, node: Term, path: str) -> str:
        spec = self.spec(path)
        if spec.tokenizer == "en_stem" and not spec.token_column:
            raise FieldError(f"{path!r}: stemmed tokens need a token column")
        low = node.text.lower() if spec.tokenizer != "whitespace" else node.text
        wild = not node.quoted and ("*" in low or "?" in low)
        words = [low] if wild else tokenize_query(node.text, spec.tokenizer)
        if not words:
            return "false"
        if node.fuzzy and len(words) > 1:
            raise QuerySyntaxError(f"a fuzzy term is one word: {node.text!r}")
        if not spec.token_column and spec.tokenizer == "default":
            return self.unsplit(self.value_sql(path), words, wild, node.fuzzy, spec.max_token)
        column = name(spec.token_column) if spec.token_column else token_sql(self.value_sql(path), spec.tokenizer, spec.max_token)
        return self.among(column, words, wild, node.fuzzy)

    def among(self, column: str, words: list[str], wild: bool, fuzzy: int) -> str:
        """The test on an array of tokens."""
        if wild:
            return f"exists({column}, t -> t LIKE {quote(self.like(words[0]))})"
        if fuzzy:
            n = len(words[0])
            return f"exists({column}, t -> length(t) BETWEEN {n - fuzzy} AND {n + fuzzy} AND levenshtein(t, {quote(words[0])}, {fuzzy}) BETWEEN 0 AND {fuzzy})"
        if len(words) == 1:
            return f"array_contains({column}, {quote(words[0])})"
        return f"contains(concat(' ', array_join({column}, ' '), ' '), {quote(' ' + ' '.join(words) + ' ')})"

    def unsplit(self, value: str, words: list[str], wild: bool, fuzzy: int, longest: int) -> str:
        """The same test on a text that no one has split: what the text must contain first, then borders by one regular expression.

        Only fuzzy words, and wildcards over other marks than letters and digits, split the texts that are left.
        """
        low = f"lower({value})"
        if fuzzy:
            # of the parts of a word one is whole in any word that differs in so few places
            word, k = words[0], fuzzy + 1
            parts = [word[i * len(word) // k : (i + 1) * len(word) // k] for i in range(k)]
            needed = " OR ".join(f"contains({low}, {quote(p)})" for p in parts) if all(parts) else "true"
            return f"(({needed}) AND {self.among(token_sql(value, 'default', longest), words, wild, fuzzy)})"
        literals = [w for x in words for w in re.split(r"[*?]+", x) if w]
        needed = " AND ".join(f"contains({low}, {quote(w)})" for w in dict.fromkeys(literals)) or "true"
        if not all(w.isalnum() for w in literals) or max(map(len, literals), default=0) > longest:
            return f"({needed} AND {self.among(token_sql(value, 'default', longest), words, wild, fuzzy)})"
        letter, other = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
        if wild:
            # a token of the allowed length, of this form
            form = "".join({"*": f"{letter}*", "?": letter}.get(c, c) for c in words[0])
            pattern = f"(?<!{letter})(?={letter}{{1,{longest}}}(?!{letter})){form}(?!{letter})"
        else:
            # tokens that are too long do not count, so they may stand between the words of a phrase
            between = f"{other}+(?:{letter}{{{longest + 1},}}{other}+)*"
            pattern = f"(?<!{letter}){between.join(words)}(?!{letter})"
        return f"({needed} AND {low} RLIKE {quote(pattern)})"

    def exact(self, node: Term, value: str) -> str:
        if not node.quoted and ("*" in node.text or "?" in node.text):
            return f"{value} LIKE {quote(self.like(node.text))}"
        if node.fuzzy:
            return f"levenshtein({value}, {quote(node.text)}, {node.fuzzy}) BETWEEN 0 AND {node.fuzzy}"
        return f"{value} = {quote(node.text)}"

    def range(self, node: Range, path: str, kind: str) -> str:
        value, tests = self.value_sql(path), []
        if kind == "array":
            raise FieldError(f"no ranges on the array {path!r}")
        if kind == "ip":
            spec = self.spec(path)
            value = name(spec.key_column) if spec.key_column else ip_functions.key_sql(value)
            literal = lambda t: f"X'{ip_functions.range_of(t)[0]:032X}'"
        elif kind in ("text", "string"):
            literal = quote
        elif kind == "json":
            numeric = all(b is None or re.fullmatch(r"[+-]?[\d.]+", b) for b in (node.low, node.high))
            value = f"try_cast({value} AS DOUBLE)" if numeric else value
            literal = (lambda t: t) if numeric else quote
        else:
            value = self.cast(value, kind)
            literal = lambda t: self.literal(t, kind)
        if node.low is not None:
            tests.append(f"{value} {'>=' if node.low_in else '>'} {literal(node.low)}")
        if node.high is not None:
            tests.append(f"{value} {'<=' if node.high_in else '<'} {literal(node.high)}")
        return f"coalesce({' AND '.join(tests)}, false)" if tests else f"({value} IS NOT NULL)"

    # ---- whole queries

    def build(self, node, paths: list[str]) -> str:
        if isinstance(node, All):
            return "true"
        if isinstance(node, Not):
            return f"(NOT {self.build(node.child, paths)})"
        if isinstance(node, Both):
            return "(" + f" {node.op} ".join(self.build(c, paths) for c in node.children) + ")"
        if node.field is not None:
            return self.test(node, node.field)
        tests = []
        for path in paths:
            try:
                tests.append(self.test(node, path))
            except QuerySyntaxError:
                if len(paths) == 1:
                    raise  # among all fields, one whose type cannot hold the term does not match
        return "(" + " OR ".join(tests) + ")" if tests else "false"

    def searchable(self) -> list[str]:
        out = []
        for f in self.schema.fields:
            try:
                self.kind(f.name)
            except FieldError:
                continue
            out.append(f.name)
        hidden = {s.token_column for s in self.specs.values()} | {s.key_column for s in self.specs.values()}
        return [f for f in out if f not in hidden]

    def compile(self, query: str, column: str | None = None, mode: str = "indexquery") -> str:
        """SQL for ``column <mode> 'query'``, or for all fields without a column.

        textsearch wants tokenized fields and fieldmatch the others; indexquery takes any.
        """
        mode = mode.lower()
        if mode not in ("textsearch", "fieldmatch", "indexquery"):
            raise ValueError(f"unknown operator: {mode}")
        node = parse(query, self.default_operator)
        if column is not None:
            is_text = self.kind(column) == "text"
            if mode == "textsearch" and not is_text:
                raise FieldError(f"{column!r} is not tokenized; use FIELDMATCH")
            if mode == "fieldmatch" and is_text:
                raise FieldError(f"{column!r} is tokenized; use TEXTSEARCH")
            return self.build(node, [column])
        paths = self.searchable()
        if mode != "indexquery":
            texts = [p for p in paths if self.kind(p) == "text"]
            strings = [p for p in paths if self.kind(p) == "string"]
            if mode == "textsearch" and not texts or mode == "fieldmatch" and not strings:
                raise FieldError(f"no field that {mode.upper()} can search")
            if texts and strings:
                raise FieldError("tokenized and other text fields are mixed; name a field or use indexquery")
            paths = texts if mode == "textsearch" else strings
        if self.max_fields and len(paths) > self.max_fields and None in fields_of(node):
            raise FieldError(f"a query without fields over {len(paths)} fields (the limit is {self.max_fields})")
        return self.build(node, paths)
