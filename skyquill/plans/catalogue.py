"""Registered queries, each with its SQL for other engines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquill.functions import buckets
from skyquill.functions.ip import ip_key
from skyquill.operators.search import condition, index_fields, inverted, search, search_expr, search_inverted, search_sql
from skyquill.plans.commands import Commands
from skyquill.plans.query_language import FieldSpec
from skyquill.sources.maintenance import compact, drop_partitions
from skyquill.sources.table import Table

_QUERIES: dict = {}
_SQL: dict = {}
TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def query(sql: str | None = None):
    def keep(run):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        ready.__name__, ready.__doc__ = run.__name__, run.__doc__
        _QUERIES[run.__name__] = ready
        if sql:
            _SQL[run.__name__] = sql
        return run

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def flagship(spark, sf_dir):
    return _QUERIES["search_group_by"](spark, sf_dir)


def money(c, scale=2):
    """Exact sum of a double that holds decimals."""
    return F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double")


def _texts(df, q):
    return search(df, q, "text", text_fields=["text"])


def _shared(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='skyquill-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- search: one query for each construct of the language

_SEARCHES = {
    "search_term": ("that", "list_contains({t}, 'that')"),
    "search_and": ("that AND edonre", "list_contains({t}, 'that') AND list_contains({t}, 'edonre')"),
    "search_bare_terms": ("the er", "list_contains({t}, 'the') AND list_contains({t}, 'er')"),
    "search_or": ("moron OR clown", "list_contains({t}, 'moron') OR list_contains({t}, 'clown')"),
    "search_not": ("that AND NOT with", "list_contains({t}, 'that') AND NOT list_contains({t}, 'with')"),
    "search_nested": ("(moron OR scum OR die) AND NOT (the OR und)", "(list_contains({t}, 'moron') OR list_contains({t}, 'scum') OR list_contains({t}, 'die')) AND NOT (list_contains({t}, 'the') OR list_contains({t}, 'und'))"),
    "search_phrase": ('"of the"', "contains(' ' || array_to_string({t}, ' ') || ' ', ' of the ')"),
    "search_prefix": ("disgu*", "len(list_filter({t}, lambda t: t LIKE 'disgu%')) > 0"),
    "search_suffix": ("*thless", "len(list_filter({t}, lambda t: t LIKE '%thless')) > 0"),
    "search_infix": ("pa*tic", "len(list_filter({t}, lambda t: t LIKE 'pa%tic')) > 0"),
    "search_qmark": ("?tupid", "len(list_filter({t}, lambda t: t LIKE '_tupid')) > 0"),
    "search_fuzzy1": ("idiots~1", "len(list_filter({t}, lambda t: levenshtein(t, 'idiots') <= 1)) > 0"),
    "search_fuzzy2": ("disgutin~2", "len(list_filter({t}, lambda t: levenshtein(t, 'disgutin') <= 2)) > 0"),
    "search_match_all": ("*", "true"),
}


def _add_search(name, text, test):
    def run(spark, t):
        return _texts(t("documents"), text).select("doc_id")

    run.__name__, run.__doc__ = name, f"Documents that match: {text}"
    query(f"SELECT doc_id FROM documents WHERE {test.format(t=TOK)}")(run)


for _name, (_text, _test) in _SEARCHES.items():
    _add_search(_name, _text, _test)


@query(f"SELECT doc_id, lang FROM documents WHERE (list_contains({TOK}, 'idiot') OR lang = 'de') AND n_chars >= 1000 AND n_chars < 4000")
def search_field_qualified(spark, t):
    return search(t("documents"), "(text:idiot OR lang:de) AND n_chars:[1000 TO 4000}", text_fields=["text"]).select("doc_id", "lang")


@query(f"SELECT conv_id, turn FROM conversations WHERE list_contains({TOK}, 'user') OR role = 'user'")
def search_all_fields(spark, t):
    return search(t("conversations"), "user", text_fields=["text"]).select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def fieldmatch_exact(spark, t):
    return search(t("orders"), '"1-URGENT"', "o_orderpriority", "fieldmatch").select("o_orderkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def fieldmatch_wild(spark, t):
    return search(t("part"), "p_brand:Brand#1*").select("p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12")
def range_inclusive(spark, t):
    return search(t("lineitem"), "l_quantity:[10 TO 12]", max_fields=0).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12")
def range_exclusive(spark, t):
    return search(t("lineitem"), "l_quantity:{10 TO 12}", max_fields=0).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value >= 50 AND user_id > 10 OR ts < TIMESTAMP '2024-01-01 12:00:00'")
def range_open(spark, t):
    return search(t("events"), '(value:[50 TO *] AND user_id:>10) OR ts:<"2024-01-01 12:00:00"').select("event_id")


@query("SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) >= 90 AND event_type IS NOT NULL")
def json_path_filter(spark, t):
    return search(t("events"), "props.k:>=90 AND event_type:*").select("event_id")


@query("SELECT CAST(props ->> '$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_path_agg(spark, t):
    return t("events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props ->> '$.k' AS INTEGER)) AS high FROM events GROUP BY event_type")
def json_path_sum(spark, t):
    """SUM and MAX of a nested path, of JSON text made a struct."""
    e = t("events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max("p.k").cast("int").alias("high"))


@query("SELECT event_id, '{\"k\":' || (props ->> '$.k') || ',\"t\":\"' || event_type || '\"}' AS made FROM events WHERE props ->> '$.k' IS NOT NULL")
def json_roundtrip(spark, t):
    """JSON text to a struct and back, with a further field."""
    e = t("events").withColumn("p", F.from_json("props", "k bigint")).filter("p.k IS NOT NULL")
    return e.select("event_id", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("made"))


@query("SELECT event_type, true AS close, count(*) AS rows FROM events GROUP BY event_type")
def agg_approx(spark, t):
    """Approximate distinct counts and medians are within their error bounds."""
    agg = t("events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.percentile("value", 0.5).alias("p"), F.stddev("value").alias("s"), F.count(F.lit(1)).alias("rows"),
    )
    close = (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n") + 1) & (F.abs(F.col("m") - F.col("p")) <= 0.05 * F.col("s") + 1e-9)
    return agg.select("event_type", close.alias("close"), "rows")


@query(f"SELECT doc_id FROM documents WHERE NOT (list_contains({TOK}, 'moron') OR lang = 'en') AND n_chars > 3000")
def search_mixed_sql(spark, t):
    """Search and SQL tests in one boolean expression."""
    d = t("documents")
    return d.filter(~(condition(d, "moron", "text", text_fields=["text"]) | (F.col("lang") == "en")) & (F.col("n_chars") > 3000)).select("doc_id")


@query(f"SELECT toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE list_contains({TOK}, 'stupid') GROUP BY toxic")
def search_join_dim(spark, t):
    return _texts(t("documents"), "stupid").join(t("labels"), "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE list_contains({TOK}, 'that') OR list_contains({TOK}, 'die') GROUP BY lang")
def search_group_by(spark, t):
    return _texts(t("documents"), "that OR die").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH hits AS (SELECT doc_id, source FROM documents WHERE list_contains({TOK}, 'idiot') AND NOT list_contains({TOK}, 'clown')) SELECT source, count(*) AS n FROM hits GROUP BY source")
def search_cte(spark, t):
    """Search operators inside SQL text, in a CTE."""
    d = t("documents")
    d.createOrReplaceTempView("sq_documents")
    return search_sql(spark, "WITH hits AS (SELECT doc_id, source FROM sq_documents WHERE text TEXTSEARCH 'idiot AND NOT clown') SELECT source, count(*) AS n FROM hits GROUP BY source", d, text_fields=["text"])


_OTHER = TOK.replace("coalesce(text", "coalesce(c.text")


@query(f"SELECT l.toxic, count(*) AS n FROM documents d JOIN conversations c ON d.doc_id = c.conv_id JOIN labels l ON l.doc_id = d.doc_id WHERE list_contains({TOK.replace('coalesce(text', 'coalesce(d.text')}, 'that') AND (c.role = 'user' OR list_contains({_OTHER}, 'the')) GROUP BY l.toxic")
def sql_search_join(spark, t):
    """Search operators on two tables of one statement; the views' metadata tell the kinds of their fields."""
    index_fields(t("documents"), {"text": "text"}).drop("__tok_text").withMetadata("text", {"search": {"kind": "text"}}).createOrReplaceTempView("sq_d")
    t("conversations").withMetadata("text", {"search": {"kind": "text"}}).createOrReplaceTempView("sq_c")
    t("labels").createOrReplaceTempView("sq_l")
    return search_sql(spark, "SELECT l.toxic, count(*) AS n FROM sq_d AS d JOIN sq_c c ON d.doc_id = c.conv_id JOIN sq_l l ON l.doc_id = d.doc_id WHERE d.text TEXTSEARCH 'that' AND (c.role FIELDMATCH 'user' OR c.text INDEXQUERY 'the') GROUP BY l.toxic")


@query(f"SELECT lang, count(*) AS n FROM documents WHERE n_chars > 500 AND (list_contains({TOK}, 'stupid') OR source = 'src1') GROUP BY lang")
def sql_search_view(spark, t):
    """A search on a view of a view."""
    t("documents").withMetadata("text", {"search": {"kind": "text"}}).createOrReplaceTempView("sq_base")
    spark.sql("CREATE OR REPLACE TEMP VIEW sq_long AS SELECT * FROM sq_base WHERE n_chars > 500")
    return search_sql(spark, "SELECT lang, count(*) AS n FROM sq_long WHERE text INDEXQUERY 'stupid' OR source FIELDMATCH 'src1' GROUP BY lang")


@query(f"SELECT doc_id, list_contains({TOK}, 'clown') AS hit FROM documents WHERE list_contains({TOK}, 'idiot')")
def search_expression(spark, t):
    """A search as an expression, in a filter and in a projection."""
    d = t("documents")
    return d.filter(search_expr(d, "text TEXTSEARCH 'idiot'", text_fields=["text"])).select("doc_id", search_expr(d, "text TEXTSEARCH 'clown'", text_fields=["text"]).alias("hit"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'that') AND list_contains({TOK}, 'scum')")
def search_indexed(spark, t):
    """Search on a token column of a written table."""
    path = _shared(spark, "indexed")
    index_fields(t("documents").select("doc_id", "text"), {"text": "text"}).write.parquet(path)
    df = spark.read.parquet(path)
    return search(df, "that scum", "text", specs={"text": FieldSpec("text", token_column="__tok_text")}).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'trash') AND list_contains({TOK}, 'idiot')")
def search_inverted_index(spark, t):
    """Selective terms through a written (term, id) side table, sorted by term, and a semi-join."""
    path, d = _shared(spark, "inverted"), t("documents").select("doc_id", "text")
    inverted(d, "doc_id", "text").repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)
    return search_inverted(d, spark.read.parquet(path), "doc_id", ["trash", "idiot"]).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey // 256 IN (1, 2, 3)")
def ip_cidr(spark, t):
    """A wildcard and a CIDR block on text addresses, through 16-byte keys."""
    n = F.col("c_custkey")
    c = t("customer").withColumn("ip", F.concat(F.lit("10."), F.floor(n / 65536).cast("string"), F.lit("."), F.floor(n % 65536 / 256).cast("string"), F.lit("."), (n % 256).cast("string")))
    c = c.withColumn("key", ip_key("ip", v4_only=True))
    return search(c, "10.0.1.* OR 10.0.2.0/23", "ip", specs={"ip": FieldSpec("ip", key_column="key")}).select("c_custkey")


# ---- buckets


@query("SELECT floor(l_extendedprice / 10000) * 10000 AS bucket, count(*) AS doc_count FROM lineitem GROUP BY 1")
def hist_price(spark, t):
    return buckets.bucket_counts(t("lineitem"), buckets.histogram("l_extendedprice", 10000))


@query("SELECT floor((l_quantity - 3) / 7) * 7 + 3 AS bucket, count(*) AS doc_count FROM lineitem GROUP BY 1 HAVING count(*) >= 100")
def hist_offset(spark, t):
    return buckets.bucket_counts(t("lineitem"), buckets.histogram("l_quantity", 7, 3), min_doc_count=100)


@query("SELECT floor(l_quantity / 10) * 10 AS bucket, l_returnflag, count(*) AS doc_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2")
def hist_sum(spark, t):
    return buckets.bucket_counts(t("lineitem"), buckets.histogram("l_quantity", 10), money("l_extendedprice").alias("total"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), keys=("l_returnflag",))


@query("SELECT 5.0::DOUBLE * i AS bucket, count(l_orderkey) AS doc_count FROM range(0, 13) r(i) LEFT JOIN lineitem ON floor(l_quantity / 5) = i GROUP BY 1")
def hist_fill(spark, t):
    return buckets.fill_histogram(buckets.bucket_counts(t("lineitem"), buckets.histogram("l_quantity", 5)), 5, bounds=(0, 60))


def _add_dates(name, interval, offset, sql_step, sql_offset, keys=()):
    def run(spark, t):
        out = buckets.bucket_counts(t("events"), buckets.date_histogram("ts", interval, offset), keys=keys)
        return out.withColumn("bucket", F.unix_micros("bucket"))

    run.__name__, run.__doc__ = name, f"Events in buckets of {interval}, offset {offset}"
    key = "".join(f", {k}" for k in keys)
    query(f"SELECT CAST(floor((epoch_us(ts) - {sql_offset}) / {sql_step}.0) AS BIGINT) * {sql_step} + {sql_offset} AS bucket{key}, count(*) AS doc_count FROM events GROUP BY ALL")(run)


_add_dates("date_hist_1h", "1h", "0ms", 3_600_000_000, 0)
_add_dates("date_hist_1d", "1d", "0ms", 86_400_000_000, 0)
_add_dates("date_hist_offset", "1d", "6h", 86_400_000_000, 21_600_000_000)
_add_dates("date_hist_multikey", "15m", "0ms", 900_000_000, 0, ("event_type",))


@query("SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS bucket, o_orderstatus, count(*) AS doc_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2")
def range_bucket_sum(spark, t):
    return buckets.bucket_counts(t("orders"), buckets.range_bucket("o_totalprice", ("low", None, 50000), ("mid", 50000, 200000), ("high", 200000, None)), money("o_totalprice").alias("total"), keys=("o_orderstatus",))


@query("SELECT CASE WHEN o_totalprice >= 1000 AND o_totalprice < 50000 THEN 'a' WHEN o_totalprice >= 60000 AND o_totalprice < 70000 THEN 'b' END AS bucket, count(*) AS doc_count FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 OR o_totalprice >= 60000 AND o_totalprice < 70000 GROUP BY 1")
def range_bucket(spark, t):
    return buckets.bucket_counts(t("orders"), buckets.range_bucket("o_totalprice", ("a", 1000, 50000), ("b", 60000, 70000)))


@query("SELECT floor(o_totalprice / 25000.0) * 25000.0 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def hist_sql_function(spark, t):
    """The bucket as a SQL function, inlined by Catalyst."""
    buckets.register(spark)
    t("orders").createOrReplaceTempView("sq_orders")
    return spark.sql("SELECT sq_histogram(o_totalprice, 25000.0D) AS bucket, count(*) AS n FROM sq_orders GROUP BY 1")


# ---- aggregates, filters, joins, windows, sets: Spark's own operators


def same(name, sql, tables, spark_sql=None, doc=None):
    """A query whose text both engines read."""

    def run(spark, t):
        for x in tables:
            t(x).createOrReplaceTempView(f"sq_{x}")
        text = spark_sql or sql
        for x in tables:
            text = text.replace(f"{{{x}}}", f"sq_{x}")
        return spark.sql(text)

    run.__name__, run.__doc__ = name, doc
    text = sql
    for x in tables:
        text = text.replace(f"{{{x}}}", x)
    query(text)(run)


@query("SELECT count(*) AS n, count(o_orderstatus) AS n_status, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(o_orderpriority) AS first_priority FROM orders")
def agg_simple(spark, t):
    return t("orders").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("n_status"), money("o_totalprice").alias("total"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), (money("o_totalprice") / F.count(F.lit(1))).alias("mean"), F.min("o_orderpriority").alias("first_priority"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_group(spark, t):
    return t("lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))


same("agg_filtered", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus", ["orders"])
same("agg_distinct", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem}", ["lineitem"])
same("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", ["lineitem"])
same("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", ["orders"])
same("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", ["orders"])
same("agg_six_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax", ["lineitem"])
same("filter_eq", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000", ["orders"])
same("filter_in", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')", ["customer"])
same("filter_nullsafe", "SELECT o_orderkey FROM {orders} WHERE nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL", ["orders"])
same("filter_like", "SELECT p_partkey FROM {part} WHERE p_type LIKE '%L' OR p_brand LIKE 'Brand#2%' OR p_name LIKE '%an%'", ["part"])
same("filter_null", "SELECT count(*) AS n FROM {customer} WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR NOT (c_acctbal IS NOT NULL)", ["customer"])
same("filter_date", "SELECT o_orderkey FROM {orders} WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'", ["orders"])
same("filter_rlike", "SELECT p_partkey FROM {part} WHERE regexp_like(p_brand, '^Brand#[13]')", ["part"], doc="A regular expression")
_SQL["filter_rlike"] = "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[13]')"
same("join_inner", "SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_orderpriority, c_mktsegment", ["orders", "customer"])
same("join_star", "SELECT r_name, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name", ["lineitem", "orders", "customer", "nation", "region"])
same("join_left", "SELECT n_name, count(s_suppkey) AS n FROM {nation} LEFT JOIN {supplier} ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY n_name", ["nation", "supplier"])
same("join_full", "SELECT c.k AS ck, s.k AS sk FROM (SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_nationkey < 15) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM {supplier} WHERE s_nationkey > 10) s ON c.k = s.k", ["customer", "supplier"])
same("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", ["customer", "orders"])
same("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", ["customer", "orders"])
same("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", ["region", "nation"], doc="Two tables of fixed size")
same("join_range", "SELECT n_name, count(*) AS n FROM {nation} JOIN {region} ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 6 GROUP BY n_name", ["nation", "region"])


@query("SELECT e.event_id, p.ts AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(spark, t):
    """The last purchase at or before each event: one sort by user and time instead of a range join."""
    e = t("events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("p"))
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return e.withColumn("last_purchase", F.max(F.when(F.col("p"), F.col("ts"))).over(w)).filter("NOT p").select("event_id", "last_purchase")


same("win_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS q FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)", ["orders"], doc="Ranks")
same("win_lag", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", ["events"])
same("win_frame", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS high, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {events}", ["events"])
same("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ["orders"])
same("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 40", ["orders"])
same("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) WHERE r <= 3", ["customer"])
same("setop_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", ["customer", "supplier"])
same("setop_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) GROUP BY k", ["customer", "supplier"])
same("setop_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", ["customer", "supplier"])
same("setop_except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0", ["orders", "customer"])
same("setop_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", ["customer", "supplier"])
same("setop_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}", ["customer", "supplier"])
same("join_right", "SELECT s_suppkey, n_name FROM {nation} RIGHT JOIN {supplier} ON n_nationkey = s_nationkey AND n_regionkey = 1", ["nation", "supplier"])
same("agg_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(avg(o_custkey), 4) AS customer FROM {orders} GROUP BY o_orderpriority", ["orders"])
same("agg_percentile", "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS low, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS mid FROM {lineitem} GROUP BY l_returnflag", ["lineitem"])
same("agg_moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_discount), 8) AS variance, round(corr(l_quantity, l_tax), 6) AS together FROM {lineitem} GROUP BY l_returnflag", ["lineitem"])
same("win_distribution", "SELECT c_custkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS d FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)", ["customer"])
same("win_value", "SELECT event_id, last_value(value) OVER w AS last, nth_value(value, 3) OVER w AS third FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", ["events"])
same("subquery_scalar", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})", ["part"])


# ---- tables, streams


def _written(spark, df, **options) -> Table:
    table = Table(spark, _shared(spark, "table"))
    table.write(df, **options)
    return table


@query("SELECT count(*) AS count FROM orders")
def count_metadata(spark, t):
    """COUNT(*) from the log of a written table; no data file is read."""
    return _written(spark, t("orders")).count()


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY o_orderstatus")
def group_count_metadata(spark, t):
    return _written(spark, t("orders"), partition_by=["o_orderstatus"]).count(["o_orderstatus"])


@query("SELECT * FROM nation")
def log_snapshot(spark, t):
    """The first version, read after an append and an overwrite."""
    table = _written(spark, t("nation"))
    table.write(t("nation"))
    table.write(t("nation").limit(1), "overwrite")
    return table.read(version=0)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def compact_preserves(spark, t):
    table = _written(spark, t("nation").repartition(6))
    compact(table)
    return table.read().groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def drop_partition(spark, t):
    table = _written(spark, t("nation"), partition_by=["n_regionkey"])
    drop_partitions(table, [("n_regionkey", "=", 2)])
    return table.read()


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def replace_where(spark, t):
    table = _written(spark, t("nation"))
    table.write(t("nation").filter("n_regionkey = 1").withColumn("n_name", F.upper("n_name")), "overwrite", replace_where=[("n_regionkey", "=", 1)])
    return table.read()


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def data_skipping(spark, t):
    table = _written(spark, t("orders").repartitionByRange(8, "o_orderkey"))
    return table.read([("o_orderkey", ">=", 100), ("o_orderkey", "<=", 200)])


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) < DATE '1995-02-01'")
def skip_date(spark, t):
    """Files skipped by dates."""
    import datetime

    table = _written(spark, t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).repartitionByRange(8, "day"))
    return table.read([("day", ">=", datetime.date(1995, 1, 1)), ("day", "<", datetime.date(1995, 2, 1))]).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-03 00:00:00'")
def skip_timestamp(spark, t):
    """Files skipped by timestamps: a text, and a date that stands for its midnight."""
    import datetime

    table = _written(spark, t("events").select("event_id", F.col("ts").cast("timestamp").alias("at")).repartitionByRange(8, "at"))
    return table.read([("at", ">=", "2024-01-01 06:00:00"), ("at", "<=", datetime.date(2024, 1, 3))]).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_orderkey % 7 = 0")
def skip_nan(spark, t):
    """NaN is above all numbers, in files with and without it."""
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return _written(spark, t("orders").select("o_orderkey", price.alias("price")).repartitionByRange(8, "o_orderkey")).read([("price", ">", 300000.0)]).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 05:00:00' AND ts < TIMESTAMP '2024-01-02 05:00:00'")
def skip_other_zone(spark, t):
    """Written in one time zone, read in another: midnights of New York."""
    table = _written(spark, t("events").select("event_id", F.col("ts").cast("timestamp").alias("at")).repartitionByRange(8, "at"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        day = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
        low, high = spark.range(1).select(*[F.unix_micros(d) for d in day]).first()
        found = table.read([("at", ">=", "2024-01-01"), ("at", "<", "2024-01-02")])
        kept = [f.path for f in found.select(F.col("_metadata.file_path").alias("path")).distinct().collect()] if table.last_scan.read else []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.schema(table.snapshot().schema).parquet(*kept) if kept else table.read().limit(0)
    return rows.filter(F.unix_micros("at").between(low, high - 1)).select("event_id")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 2000")
def format_roundtrip(spark, t):
    """Written and read as a Spark format; the pushed filters leave out files by partition and by bounds."""
    from skyquill.sources.format import register

    register(spark)
    path = _shared(spark, "format")
    t("orders").repartitionByRange(4, "o_orderkey").write.format("skyquill").mode("append").option("partitionBy", "o_orderstatus").save(path)
    return spark.read.format("skyquill").load(path).filter("o_orderstatus = 'F' AND o_orderkey < 2000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'idiot')")
def companion_search(spark, t):
    """A side index over Parquet files, synced once and searched alone."""
    from skyquill.sources.companion import search_index, sync

    source, index = _shared(spark, "source"), _shared(spark, "index")
    t("documents").select("doc_id", "text").repartition(3).write.parquet(source)
    sync(spark, source, index, {"text": "text"})
    return search_index(spark, index, "idiot", "text").select("doc_id")


@query("SELECT * FROM nation")
def stream_append(spark, t):
    """A stream into a table, run twice: each batch is committed once."""
    from skyquill.streaming.ingest import write_stream

    source, path, state = _shared(spark, "source"), _shared(spark, "table"), _shared(spark, "state")
    t("nation").repartition(3).write.parquet(source)
    for _ in range(2):
        write_stream(spark.readStream.schema(t("nation").schema).parquet(source), path, state, "nation").awaitTermination()
    return Table(spark, path).read()


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) * 3600000000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window(spark, t):
    """Hourly windows of a stream, all closed at the end of the run."""
    from skyquill.streaming.ingest import windowed

    source, out, state = _shared(spark, "source"), _shared(spark, "out"), _shared(spark, "state")
    events = t("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(source)
    counts = windowed(spark.readStream.schema(events.schema).parquet(source), "ts", "1 hour", keys=("event_type",))
    return _last(spark, counts, out, state).select(F.unix_micros("start").alias("start"), "event_type", "n")


def _last(spark, stream: DataFrame, out: str, state: str) -> DataFrame:
    """The whole result after the last batch of a stream, written by the tasks."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT CAST(floor(epoch_us(ts) / 1800000000.0) AS BIGINT) * 1800000000 - o * 1800000000 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY ALL")
def stream_sliding(spark, t):
    """Windows of an hour that begin every half hour."""
    from skyquill.streaming.ingest import windowed

    source, out, state = _shared(spark, "source"), _shared(spark, "out"), _shared(spark, "state")
    events = t("events").select(F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(source)
    counts = windowed(spark.readStream.schema(events.schema).parquet(source), "ts", "1 hour", slide="30 minutes")
    return _last(spark, counts, out, state).select(F.unix_micros("start").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) AS start, max(t) + 600000000 AS "end", count(*) AS n FROM k GROUP BY user_id, s""")
def stream_sessions(spark, t):
    """Sessions of a user's events with gaps under ten minutes."""
    from skyquill.streaming.ingest import sessions

    source, out, state = _shared(spark, "source"), _shared(spark, "out"), _shared(spark, "state")
    events = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(source)
    counts = sessions(spark.readStream.schema(events.schema).parquet(source), "ts", "10 minutes", ("user_id",))
    return _last(spark, counts, out, state).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


# ---- statements as text


def statement(sql: str):
    """Keeps a query that gets Commands, the table ``nation`` written in four files by region, and its path."""

    def keep(run):
        def ready(spark, t):
            table = _written(spark, t("nation").coalesce(1), partition_by=["n_regionkey"])
            for _ in range(2):
                table.write(t("nation").filter("n_regionkey < 2").coalesce(1))
            commands = Commands(spark)
            commands.register("sq_nations", table.path)
            return run(spark, commands, table)

        ready.__name__, ready.__doc__ = run.__name__, run.__doc__
        query(sql)(ready)
        return run

    return keep


_NATIONS = "(SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey < 2 UNION ALL SELECT * FROM nation WHERE n_regionkey < 2)"


@statement("SELECT '{\"n_regionkey\": \"' || n_regionkey || '\"}' AS partition, 3::BIGINT AS merged, 1::BIGINT AS files, 'merged' AS status FROM (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 2)")
def stmt_merge(spark, c, table):
    return c.sql("MERGE SPLITS sq_nations TARGET SIZE 10M MAX DEST SPLITS 9 MAX SOURCE SPLITS PER MERGE 9").select("partition", "merged", F.col("into").alias("files"), "status")


@statement("SELECT n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey = 1)")
def stmt_merge_precommit(spark, c, table):
    """Planned groups, nothing written."""
    out = c.sql(f"MERGE SPLITS '{table.path}' WHERE n_regionkey = 1 PRECOMMIT").filter("status = 'planned'")
    assert len(table.snapshot().files) == 9
    return out.select(F.get_json_object("partition", "$.n_regionkey").cast("int").alias("n_regionkey"))


@statement(f"SELECT * FROM {_NATIONS} WHERE n_regionkey <> 1")
def stmt_drop_partitions(spark, c, table):
    c.sql("DROP TABLE PARTITIONS FROM sq_nations WHERE n_regionkey = 1")
    return table.read()


@statement("SELECT 5::BIGINT AS gone")
def stmt_purge(spark, c, table):
    """Files that no version names any more: those of a write that was never committed."""
    table._write_files(table.read(version=0), ["n_regionkey"])
    return c.sql("PURGE TABLE sq_nations OLDER THAN 0 HOURS").filter("path LIKE '%.parquet' AND path NOT LIKE '%.crc'").agg(F.count_if("deleted").alias("gone"))


@statement(f"SELECT count(*) AS n FROM {_NATIONS}")
def stmt_repair(spark, c, table):
    """A clean log, read as the log of a copy."""
    target = _shared(spark, "repaired")
    c.sql(f"REPAIR TABLE TRANSACTION LOG '{table.path}' AT LOCATION '{target}'")
    return spark.read.text(target).select(F.sum(F.get_json_object("value", "$.add.stats.rows").cast("long")).alias("n"))


@statement("SELECT 9::BIGINT AS files, count(*) AS n FROM " + _NATIONS)
def stmt_describe_state(spark, c, table):
    return c.sql("DESCRIBE TABLE STATE sq_nations").select(F.col("num_files").alias("files"), F.col("num_rows").alias("n"))


@statement(f"SELECT 'add' AS action_type, count(*) AS n FROM {_NATIONS} UNION ALL SELECT 'metadata', 0 UNION ALL SELECT 'protocol', 0")
def stmt_describe_log(spark, c, table):
    log = c.sql("DESCRIBE TABLE TRANSACTION LOG sq_nations INCLUDE ALL")
    return log.groupBy("action_type").agg(F.coalesce(F.sum("num_records"), F.lit(0)).alias("n"))


@statement("SELECT 'n_name' AS component UNION ALL SELECT 'n_nationkey'")
def stmt_component_sizes(spark, c, table):
    return c.sql("DESCRIBE TABLE COMPONENT SIZES sq_nations WHERE n_regionkey = 2").filter("size_bytes > 0").select("component").distinct()


@statement(f"SELECT count(*) AS n FROM {_NATIONS} WHERE n_regionkey = 1")
def stmt_prewarm(spark, c, table):
    job = c.sql("PREWARM TABLE CACHE sq_nations FOR SEGMENTS (TERM_DICT) ON FIELDS (n_name) WITH PERWORKER PARALLELISM OF 2 WHERE n_regionkey = 1 ASYNC MODE").first()
    done = c.sql(f"WAIT FOR TABLE PREWARM JOBS sq_nations JOB '{job.job}' TIMEOUT 120")
    c.sql("FLUSH TABLE DISK CACHE")
    return done.select(F.col("rows").alias("n"))


@statement("SELECT 2::BIGINT AS version, 3::BIGINT AS left_over, 1::BIGINT AS after")
def stmt_checkpoint_truncate(spark, c, table):
    c.sql("CHECKPOINT TABLE sq_nations")
    before, _ = len(table.versions()), c.sql("TRUNCATE TABLE TIME TRAVEL sq_nations")
    return spark.createDataFrame([(table.snapshot().version, before, len(table.versions()))], "version long, left_over long, after long")


@statement("SELECT 'far' AS root_name, 's3://b/t' AS root_path")
def stmt_table_roots(spark, c, table):
    c.sql("SET TABLE TABLE ROOT 'near' = 'file:///x' AT sq_nations")
    c.sql("SET TABLE TABLE ROOT 'far' = 's3://b/t' AT sq_nations")
    c.sql("UNSET TABLE TABLE ROOT 'near' AT sq_nations")
    return c.sql("DESCRIBE TABLE TABLE ROOTS AT sq_nations")


@statement("SELECT 'INVALIDATE TABLE' AS statement, 1::BIGINT AS calls UNION ALL SELECT 'SELECT N_REGIONKEY,', 1")
def stmt_profiler(spark, c, table):
    """The profiler over a statement and a query that goes to Spark."""
    c.sql("ENABLE TABLE PROFILER")
    c.sql("INVALIDATE TABLE TRANSACTION LOG CACHE FOR sq_nations")
    c.sql("SELECT n_regionkey, count(*) AS n FROM sq_nations GROUP BY n_regionkey").collect()
    c.sql("DISABLE TABLE PROFILER")
    out = c.sql("DESCRIBE TABLE PROFILER CACHE").filter("statement NOT LIKE '%PROFILER%' AND statement NOT LIKE 'ENABLE%'").select("statement", "calls")
    c.sql("RESET TABLE PROFILER CACHE")
    return out


@statement("SELECT true AS known")
def stmt_environment(spark, c, table):
    return c.sql("DESCRIBE TABLE ENVIRONMENT").agg((F.count_if(F.col("name") == "spark.app.name") == 1).alias("known"))


@statement("SELECT n_nationkey FROM nation WHERE n_regionkey < 3 AND n_name = 'NATION_2'")
def stmt_companion(spark, c, table):
    source, index = _shared(spark, "source"), _shared(spark, "index")
    table.read(version=0).repartition(3).write.parquet(source)
    c.sql(f"BUILD TABLE COMPANION FOR PARQUET '{source}' INCLUDE COLUMNS ('n_nationkey', 'n_name', 'n_regionkey') INDEXING MODES ('n_name': 'exact_only') TARGET INPUT SIZE 1M WHERE n_regionkey < 3 AT LOCATION '{index}'")
    from skyquill.sources.companion import exact_in_index

    return exact_in_index(Table(spark, index).read(), "n_name", "NATION_2").select("n_nationkey")


# ---- further constructs of searches, functions and tables


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR p_size >= 45")
def search_struct_field(spark, t):
    """Fields of a struct."""
    p = t("part").select("p_partkey", F.struct(F.col("p_brand").alias("b"), F.col("p_size").alias("s")).alias("info"))
    return search(p, 'info.b:"Brand#12" OR info.s:>=45').select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus = 'R') AND NOT (l_returnflag = 'O' OR l_linestatus = 'O')")
def search_array(spark, t):
    """Elements of an array."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("flags"))
    return search(rows, "flags:R AND NOT flags:O").select("l_orderkey", "l_linenumber")


@query(f"SELECT conv_id, turn FROM conversations WHERE list_contains({TOK}, 'the') OR role = 'user'")
def textsearch_all(spark, t):
    """All tokenized fields at once."""
    from skyquill.operators.search import text_search

    return text_search(t("conversations"), None, "the OR user", text_fields=["text", "role"]).select("conv_id", "turn")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'")
def fieldmatch_all(spark, t):
    """All fields of whole values at once."""
    from skyquill.operators.search import field_match

    return field_match(t("customer"), None, "BUILDING").select("c_custkey")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'that') AND len(list_filter({TOK}, lambda t: t LIKE '%thless')) > 0 AND NOT len(list_filter({TOK}, lambda t: t LIKE '%ron')) > 0")
def search_leading_wildcard(spark, t):
    """Leading wildcards inside a boolean."""
    return _texts(t("documents"), "that AND *thless AND NOT *ron").select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey < 256 AND c_custkey <> 17")
def ip_v6(spark, t):
    """IPv6 addresses: a block, and one address in another spelling."""
    c = t("customer").withColumn("ip", F.concat(F.lit("2001:DB8::"), F.lower(F.hex("c_custkey"))))
    c = c.withColumn("key", ip_key("ip"))
    return search(c, '"2001:db8::/120" AND NOT "2001:0db8:0:0:0:0:0:11"', "ip", specs={"ip": FieldSpec("ip", key_column="key")}).select("c_custkey")


_UUID_SQL = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 21, 12)"


@query(f"SELECT doc_id, {_UUID_SQL} AS id, 'call  of ' || lang AS rest FROM documents")
def text_uuid(spark, t):
    """Identifiers split off a text."""
    from skyquill.functions.text import extract_pattern, strip_pattern

    m = F.md5(F.col("doc_id").cast("string"))
    parts = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    d = t("documents").select("doc_id", F.concat(F.lit("call "), F.concat_ws("-", *parts), F.lit(" of "), F.col("lang")).alias("text"))
    return d.select("doc_id", F.get(extract_pattern("text"), F.lit(0)).alias("id"), strip_pattern("text").alias("rest"))


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def exact_only(spark, t):
    """Equality through a stored hash of a written table."""
    from skyquill.functions.text import exact_equals, exact_hash

    path = _shared(spark, "hashed")
    t("documents").select("doc_id", "source", exact_hash("source").alias("h")).write.parquet(path)
    return spark.read.parquet(path).filter(exact_equals("source", "h", "src1")).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props ->> '$.k' AS BIGINT) END AS k, CASE WHEN event_id % 3 = 0 THEN 'not ' || event_type END AS raw FROM events")
def json_lenient(spark, t):
    """Text that is not JSON is kept beside what is."""
    from skyquill.functions.text import lenient_json

    e = t("events").withColumn("props", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("not "), F.col("event_type"))).otherwise(F.col("props"))).withColumn("v", lenient_json("props"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$._raw", "string").alias("raw"))


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) * 3600000000 AS hour, floor(value / 25) * 25 AS level, event_type, count(*) AS doc_count FROM events GROUP BY ALL")
def hist_two_buckets(spark, t):
    """Two buckets and a key in one GROUP BY."""
    e = t("events").withColumn("level", buckets.histogram("value", 25))
    out = buckets.bucket_counts(e, buckets.date_histogram("ts", "1h", "0ms"), keys=("level", "event_type"), label="hour")
    return out.withColumn("hour", F.unix_micros("hour"))


@query("SELECT CAST(floor((epoch_us(ts) - 900000000) / 7200000000.0) AS BIGINT) * 7200000000 + 900000000 AS start, CASE WHEN value < 10 THEN 'low' WHEN value >= 10 AND value < 60 THEN 'mid' WHEN value >= 60 THEN 'high' END AS tier, count(*) AS n FROM events GROUP BY ALL")
def buckets_sql(spark, t):
    """Bucket functions in SQL: an interval's text, and named ranges."""
    buckets.register(spark)
    t("events").select(F.col("ts").cast("timestamp").alias("ts"), "value").createOrReplaceTempView("sq_ev")
    return spark.sql("SELECT unix_micros(sq_date_histogram(ts, '2h', '15m')) AS start, sq_range_bucket(value, array('low', 'mid', 'high'), array(NULL, 10, 60), array(10, 60, NULL)) AS tier, count(*) AS n FROM sq_ev GROUP BY ALL")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' of the ')) AS phrase FROM documents WHERE list_contains({TOK}, 'the') AND list_contains({TOK}, 'er') GROUP BY lang")
def search_sql_function(spark, t):
    """Search as SQL functions, which Catalyst inlines."""
    buckets.register(spark)
    t("documents").createOrReplaceTempView("sq_docs")
    return spark.sql("SELECT lang, count(*) AS n, count_if(sq_match_phrase(text, 'Of the')) AS phrase FROM sq_docs WHERE sq_match(text, 'the er') GROUP BY lang")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({TOK.replace('text', 'p_name')}) AS token FROM part) GROUP BY token")
def tokens_table_function(spark, t):
    """A table function: a row for each token."""
    buckets.register(spark)
    t("part").createOrReplaceTempView("sq_parts")
    return spark.sql("SELECT token, count(*) AS n FROM sq_parts, LATERAL sq_tokens(p_name) GROUP BY token")


@query("SELECT c AS \"column\", low AS min, high AS max, nulls, (SELECT count(*) FROM orders) AS rows FROM (SELECT 'o_orderkey' AS c, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high, count(*) - count(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), 0 FROM orders)")
def log_statistics(spark, t):
    """Rows, bounds and nulls by the log alone."""
    table = _written(spark, t("orders").select("o_orderkey", "o_orderstatus").repartitionByRange(4, "o_orderkey"))
    return table.statistics().drop("bytes")


@query("SELECT o_orderkey, true AS skipped FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01' AND (o_totalprice > 1000 OR o_orderstatus = 'F')")
def skip_any_condition(spark, t):
    """Files skipped by an ordinary condition in SQL."""
    o = t("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    table = _written(spark, o.repartitionByRange(8, "o_orderdate"))
    out = table.filter("TIMESTAMP '1995-01-01' <= o_orderdate AND o_orderdate < DATE '1995-02-01' AND (o_totalprice > 1000 OR o_orderstatus = 'F')").select("o_orderkey")
    return out.withColumn("skipped", F.lit(table.last_scan.by_stats >= 6))


@query("SELECT * FROM nation")
def checkpoint_read(spark, t):
    """A state that is read from a checkpoint and the versions after it."""
    table = _written(spark, t("nation").limit(0))
    for k in range(11):
        table.write(t("nation").filter(F.col("n_nationkey") % 11 == k).coalesce(1))
    assert table.last_checkpoint() == 10
    return Table(spark, table.path).read()


@query("SELECT n_nationkey, n_name, n_regionkey, 2::BIGINT AS times FROM nation")
def stream_duplicates(spark, t):
    """Equal rows of different batches all stay, in a partitioned table."""
    from skyquill.streaming.ingest import write_stream

    source, path, state = _shared(spark, "source"), _shared(spark, "table"), _shared(spark, "state")
    for _ in range(2):
        t("nation").coalesce(1).write.mode("append").parquet(source)
        write_stream(spark.readStream.schema(t("nation").schema).parquet(source), path, state, "nation", partition_by=["n_regionkey"]).awaitTermination()
    return Table(spark, path).read([("n_regionkey", ">=", 0)]).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT user_id, sum(value) AS total, count(*) AS n FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS value FROM events) GROUP BY user_id")
def stream_stateful(spark, t):
    """A state for each key in a stream, in pandas."""
    import pandas as pd

    source, out, state = _shared(spark, "source"), _shared(spark, "out"), _shared(spark, "state")
    events = t("events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    events.repartition(3).write.parquet(source)

    def add(key, frames, kept):
        total, n = kept.get if kept.exists else (0, 0)
        for frame in frames:
            total, n = total + int(frame["value"].sum()), n + len(frame)
        kept.update((total, n))
        yield pd.DataFrame({"user_id": [key[0]], "total": [total], "n": [n]})

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    totals = stream.groupBy("user_id").applyInPandasWithState(add, "user_id long, total long, n long", "total long, n long", "update", "NoTimeout")
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.max_by("total", "batch").alias("total"), F.max_by("n", "batch").alias("n"))


# ---- what is refused, guards and reports


def _refused(run) -> bool:
    from skyquill.plans.query_language import FieldError, QuerySyntaxError
    from skyquill.sources.table import TableError

    try:
        run()
    except (FieldError, QuerySyntaxError, TableError, ValueError):
        return True
    return False


_BAD = ["((", "a AND", "OR b", '"open', "title^2", "/a.*b/", '"two words"~3', "doc_id:[1 TO", "nosuch:term", "n_chars:many"]


@query("SELECT unnest(['" + "', '".join(_BAD) + "']) AS q, true AS refused UNION ALL SELECT 'that', false")
def search_refused(spark, t):
    """Bad syntax, regular expressions, proximity, boosts, unknown fields and values of the wrong kind."""
    d = t("documents")
    return spark.createDataFrame([(q, _refused(lambda q=q: condition(d, q, text_fields=["text"]))) for q in [*_BAD, "that"]], "q string, refused boolean")


@query("SELECT unnest([5, 10, 11, 12]) AS width, unnest([false, false, true, true]) AS refused")
def search_width_guard(spark, t):
    """A query without fields over more fields than the limit."""
    wide = lambda n: t("nation").select(*[F.col("n_name").alias(f"c{i}") for i in range(n)])
    return spark.createDataFrame([(n, _refused(lambda n=n: condition(wide(n), "x"))) for n in (5, 10, 11, 12)], "width int, refused boolean")


@query(f"SELECT least(7, count(*)) AS n FROM documents WHERE list_contains({TOK}, 'that')")
def search_max_rows(spark, t):
    """The opt-in limit."""
    return search(t("documents"), "that", "text", text_fields=["text"], max_rows=7).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(['schema', 'reader', 'writer', 'exists', 'partition']) AS attempt, true AS refused")
def table_refused(spark, t):
    """Writes and reads that the schema, the protocol or the mode forbid."""
    n, table = t("nation"), _written(spark, t("nation"))
    out = [("schema", _refused(lambda: table.write(n.drop("n_name")))), ("exists", _refused(lambda: table.write(n, "error"))), ("partition", _refused(lambda: drop_partitions(table, [("n_name", "=", "x")])))]
    table.upgrade_protocol(1, 9)
    out.append(("writer", _refused(lambda: table.write(n))))
    other = _written(spark, n)
    other.upgrade_protocol(9, 1)
    out.append(("reader", _refused(lambda: Table(spark, other.path).read())))
    return spark.createDataFrame(out, "attempt string, refused boolean")


@query("SELECT * FROM orders")
def write_modes(spark, t):
    """Rows dealt by partition, balanced, and by a target size."""
    o = t("orders")
    table = _written(spark, o.filter("o_orderkey % 3 = 0"), partition_by=["o_orderstatus"], write_mode="hash")
    table.write(o.filter("o_orderkey % 3 = 1"), write_mode="balanced")
    table.write(o.filter("o_orderkey % 3 = 2"), target_bytes=100_000)
    return table.read().select(*o.columns)


@query("SELECT *, 1::BIGINT AS files FROM nation")
def merge_and_purge_on_write(spark, t):
    """Compaction in the background of a write, then a purge of what it replaced."""
    n = t("nation")
    table = _written(spark, n.filter("n_regionkey = 0").coalesce(1))
    for k in range(1, 5):
        table.write(n.filter(F.col("n_regionkey") == k).coalesce(1), merge_above=4, merge_in_background=True)
    table.merging.join()
    return table.read().withColumn("files", F.lit(len(table.snapshot().files)).cast("long"))


@query("SELECT 8::BIGINT AS considered, 4::BIGINT AS by_partition, 3::BIGINT AS by_stats, 1::BIGINT AS read")
def scan_report(spark, t):
    """What a read left out, and why."""
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") % 2).cast("int").alias("odd"))
    low = o.agg(F.min("o_orderkey")).first()[0]
    table = _written(spark, o.repartitionByRange(4, "o_orderkey"), partition_by=["odd"])
    table.read([("odd", "=", low % 2), ("o_orderkey", "=", low)]).count()
    r = table.last_scan
    return spark.createDataFrame([(r.considered, r.by_partition, r.by_stats, r.read)], "considered long, by_partition long, by_stats long, read long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0 AND lower(n_name) LIKE 'nation%'")
def companion_polling(spark, t):
    """A source that grows and shrinks between the rounds of a polling sync."""
    from skyquill.sources.companion import search_index
    from skyquill.streaming.ingest import poll_sync

    source, index = _shared(spark, "source"), _shared(spark, "index")
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    n.filter("n_regionkey = 0").write.parquet(source)
    poll_sync(spark, source, index, {"n_name": "text"}, interval_seconds=0.1, rounds=1)
    n.filter("n_regionkey <> 0").repartition(3).write.mode("overwrite").parquet(source)
    poll_sync(spark, source, index, {"n_name": "text"}, interval_seconds=0.1, rounds=2)
    return search_index(spark, index, "nation*", "n_name").select("n_nationkey", "n_name")


@statement("SELECT unnest(['FLUSH TABLE SEARCHER CACHE', 'FLUSH TABLE DISK CACHE', 'DESCRIBE TABLE DISK CACHE', 'DESCRIBE TABLE STORAGE STATS', 'DESCRIBE TABLE PREWARM JOBS', 'DESCRIBE TABLE MERGE JOBS']) AS said, unnest([1, 1, 1, 0, 1, 1])::BIGINT AS n")
def stmt_caches(spark, c, table):
    """Caches and jobs, described and flushed."""
    c.sql("MERGE SPLITS sq_nations TARGET SIZE 10M")
    c.sql("PREWARM TABLE CACHE sq_nations ON FIELDS (n_name)")
    rows = [(s, c.sql(s).count()) for s in ("DESCRIBE TABLE DISK CACHE", "FLUSH TABLE SEARCHER CACHE", "FLUSH TABLE DISK CACHE", "DESCRIBE TABLE STORAGE STATS", "DESCRIBE TABLE PREWARM JOBS", "DESCRIBE TABLE MERGE JOBS")]
    return spark.createDataFrame(rows, "said string, n long")


@statement(f"SELECT n_regionkey, count(*) AS n FROM {_NATIONS} WHERE n_name = 'NATION_1' OR n_regionkey = 2 GROUP BY n_regionkey")
def stmt_passthrough(spark, c, table):
    """A statement that is no command: SQL with a search operator over a registered table."""
    return c.sql("SELECT n_regionkey, count(*) AS n FROM sq_nations WHERE n_name FIELDMATCH 'NATION_1' OR n_regionkey = 2 GROUP BY n_regionkey")
