"""Search on DataFrames and in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.functions import ip as ip_functions
from skyquill.functions.text import tokens
from skyquill.plans.query_language import Compiler, FieldError, FieldSpec
from skyquill.plans.sql_rewrite import rewrite, tables_of


def specs_from(schema) -> dict[str, FieldSpec]:
    """Field kinds kept in the columns' metadata (see index_fields)."""
    return {f.name: FieldSpec(**f.metadata["search"]) for f in schema.fields if "search" in (f.metadata or {})}


def _specs(df: DataFrame, text_fields, specs) -> dict[str, FieldSpec]:
    out = specs_from(df.schema)
    out.update({c: FieldSpec("text") for c in text_fields or ()})
    out.update(specs or {})
    return out


def condition(df: DataFrame, query: str, column: str | None = None, mode: str = "indexquery", text_fields=None, specs=None, default_operator: str = "AND", max_fields: int = 10) -> Column:
    """The test as a Column, for filters, joins, projections and aggregates."""
    return F.expr(Compiler(df.schema, _specs(df, text_fields, specs), default_operator, max_fields).compile(query, column, mode))


def search(df: DataFrame, query: str, column: str | None = None, mode: str = "indexquery", max_rows: int | None = None, **options) -> DataFrame:
    """Rows that match. ``max_rows`` is off unless asked for; its first round then reads as many partitions as there are cores."""
    out = df.filter(condition(df, query, column, mode, **options))
    if max_rows is None:
        return out
    df.sparkSession.conf.set("spark.sql.limit.initialNumPartitions", str(df.sparkSession.sparkContext.defaultParallelism))
    return out.limit(max_rows)


def text_search(df: DataFrame, column: str | None, query: str, **options) -> DataFrame:
    return search(df, query, column, "textsearch", **options)


def field_match(df: DataFrame, column: str | None, query: str, **options) -> DataFrame:
    return search(df, query, column, "fieldmatch", **options)


def index_fields(df: DataFrame, kinds: dict[str, str], tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Adds token and key columns once, so that later searches do not tokenize. Kinds go to the columns' metadata."""
    for column, kind in kinds.items():
        meta: dict = {"kind": kind}
        if kind == "text":
            meta |= {"tokenizer": (tokenizers or {}).get(column, "default"), "token_column": f"__tok_{column}"}
            df = df.withColumn(meta["token_column"], tokens(column, meta["tokenizer"]))
        elif kind == "ip":
            meta["key_column"] = f"__ip_{column}"
            df = df.withColumn(meta["key_column"], ip_functions.ip_key(column))
        df = df.withMetadata(column, {"search": meta})
    return df


def inverted(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(term, id): a side table for selective terms; partition or sort it by term."""
    token = f"__tok_{column}" if f"__tok_{column}" in df.columns else None
    words = F.col(token) if token else tokens(column)
    return df.select(F.col(id_col), F.explode(F.array_distinct(words)).alias("term"))


def search_inverted(df: DataFrame, index: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """Rows with all terms, by a semi-join on the side table."""
    hits = index.filter(F.col("term").isin(*terms)).groupBy(id_col).agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(set(terms)))
    return df.join(hits.select(id_col), id_col, "left_semi")


def search_expr(df: DataFrame, text: str, text_fields=None, specs=None, **options) -> Column:
    """A SQL expression with search operators over the columns of ``df``, as ``expr`` would read one without them."""
    compiler = Compiler(df.schema, _specs(df, text_fields, specs), **options)
    return F.expr(rewrite(text, lambda column, query, op: compiler.compile(query, column, op)))


def search_sql(spark: SparkSession, statement: str, df: DataFrame | None = None, text_fields=None, specs=None, **options) -> DataFrame:
    """Runs SQL with search operators.

    Their columns are those of ``df``, or, without it, of the tables and views that the statement names: a column with an alias is its table's,
    another one's is the first table that has it. ``text_fields`` and ``specs`` add to what the columns' metadata says of their kinds (see index_fields).
    """
    if df is not None:
        compiler = Compiler(df.schema, _specs(df, text_fields, specs), **options)
        bare = lambda c: c if c is None or compiler.type_of(c) is not None or "." not in c else c.split(".", 1)[1]
        return spark.sql(rewrite(statement, lambda column, query, op: compiler.compile(query, bare(column), op)))
    tables: dict[str, DataFrame] = {}
    for table, alias in tables_of(statement):
        if alias not in tables and spark.catalog.tableExists(table):  # names of a WITH are none
            tables[alias] = spark.table(table)

    def test(column: str | None, query: str, op: str) -> str:
        if not tables:
            raise FieldError("the statement names no table that could be searched")
        if column is None:
            if len(tables) > 1:
                raise FieldError(f"all fields of which table? There are: {', '.join(tables)}")
            own = next(iter(tables.values()))
            return Compiler(own.schema, _specs(own, text_fields, specs), **options).compile(query, None, op)
        alias, _, rest = column.partition(".")
        if rest and alias in tables:
            own = tables[alias]
            # the alias as a struct of the table's columns: the compiler then writes alias.column
            kinds = {f"{alias}.{c}": _under(alias, s) for c, s in _specs(own, text_fields, specs).items()}
            return Compiler(T.StructType([T.StructField(alias, own.schema)]), kinds, **options).compile(query, column, op)
        own = next((t for t in tables.values() if column.split(".")[0].lower() in map(str.lower, t.columns)), next(iter(tables.values())))
        return Compiler(own.schema, _specs(own, text_fields, specs), **options).compile(query, column, op)

    return spark.sql(rewrite(statement, test))


def _under(alias: str, spec: FieldSpec) -> FieldSpec:
    """The spec with its side columns under the alias."""
    place = lambda c: f"{alias}.{c}" if c else c
    return replace(spec, token_column=place(spec.token_column), key_column=place(spec.key_column))
