import random
import re

import pytest
from pyspark.sql import functions as F

from skyquill.functions.text import tokens
from skyquill.operators.search import condition, field_match, index_fields, search, search_expr, search_sql, text_search
from skyquill.plans.query_language import FieldError, FieldSpec, QuerySyntaxError, parse
from skyquill.plans.sql_rewrite import rewrite


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Northern lights guide harbour pilots at scale", "open", "sea"),
        (2, "night pilots with RadarCalibrator", "closed", "air"),
        (3, "lights streaming; Buoy radar", "open", "sea"),
        (4, "pilots to cook: chef@galley.org", "waiting", "kitchen"),
        (5, None, "open", None),
    ]
    return spark.createDataFrame(rows, "id int, content string, status string, category string")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("lights", [1, 3]), ("LIGHTS", [1, 3]), ("pilots", [1, 2, 4]), ("lights AND buoy", [3]), ("lights buoy", [3]), ("buoy OR night", [2, 3]), ("NOT pilots", [3, 5]),
        ("(lights OR night) AND NOT buoy", [1, 2]), ('"harbour pilots"', [1]), ('"pilots harbour"', []), ("radar*", [2, 3]), ("*calibrator", [2]), ("rad*ator", [2]), ("ra?ar", [3]),
        ("lihgts~2", [1, 3]), ("buoi~1", [3]), ("chef", [4]), ("chef@galley.org", [4]), ("", [1, 2, 3, 4, 5]), ("*", [1, 2, 3, 4, 5]), ("content:*", [1, 2, 3, 4]), ("NOT content:*", [5]),
        ("-lights pilots", [2, 4]), ("lights AND *radar", [3]),
    ],
)
def test_text_queries(docs, query, expected):
    assert ids(search(docs, query, "content", text_fields=["content"])) == expected


def test_operators_by_kind(docs):
    assert ids(text_search(docs, "content", "lights", text_fields=["content"])) == [1, 3]
    assert ids(field_match(docs, "status", "open", text_fields=["content"])) == [1, 3, 5]
    assert ids(field_match(docs, "status", "op*")) == [1, 3, 5]
    with pytest.raises(FieldError):
        text_search(docs, "status", "open", text_fields=["content"])
    with pytest.raises(FieldError):
        field_match(docs, "content", "lights", text_fields=["content"])
    with pytest.raises(FieldError):
        search(docs, "nosuch:x")
    with pytest.raises(FieldError):
        text_search(docs, None, "x", text_fields=["content"])
    with pytest.raises(FieldError):
        text_search(docs.select("id"), None, "x")


def test_all_fields(docs):
    assert ids(search(docs, "sea", text_fields=["content"])) == [1, 3]
    assert ids(search(docs, "open AND lights", text_fields=["content"])) == [1, 3]
    wide = docs.select("id", *[F.lit("x").alias(f"c{i}") for i in range(11)])
    with pytest.raises(FieldError):
        search(wide, "x")
    assert len(ids(search(wide, "x", max_fields=0))) == 5
    assert len(ids(search(wide, "c1:x"))) == 5


@pytest.mark.parametrize("bad", ["((", "(a", "a)", "a AND", "OR b", '"open', "f:", "a^2", "/re/", "x~7", "[1 TO", ">"])
def test_syntax_errors(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_typed_fields(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 10.5D, DATE '2024-01-01', TIMESTAMP '2024-01-01 10:00:00', true, '{\"user\": {\"city\": \"Oslo\", \"n\": 7}}', named_struct('a', 'x'), array('p', 'q')), "
        "(2, 99.0D, DATE '2024-02-01', TIMESTAMP '2024-02-01 10:00:00', false, 'not json', named_struct('a', 'y'), array('q')), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(id, num, d, ts, flag, doc, st, tags)"
    )
    for query, expected in {
        "num:[10 TO 99]": [1, 2], "num:[10 TO 99}": [1], "num:{10.5 TO *]": [2], "num:>10.5": [2], "num:<=10.5": [1], "num:10.5": [1], "d:2024-01-01": [1], 'ts:>"2024-01-15 00:00:00"': [2],
        "flag:true": [1], 'doc.user.city:"Oslo"': [1], "doc.user.n:>=7": [1], "st.a:y": [2], "tags:q": [1, 2], "NOT num:*": [3], "NOT flag:true": [2, 3],
    }.items():
        assert ids(search(df, query)) == expected, query
    with pytest.raises(QuerySyntaxError):
        search(df, "num:abc")


def test_ip_fields(spark):
    rows = [(1, "192.168.1.5"), (2, "192.168.2.5"), (3, "10.1.2.3"), (4, "2001:db8::1"), (5, "nonsense"), (6, None)]
    df = index_fields(spark.createDataFrame(rows, "id int, addr string"), {"addr": "ip"})
    for query, expected in {"192.168.1.0/24": [1], "192.168.*.*": [1, 2], "10.1.2.3": [3], '"2001:db8::/32"': [4], "addr:[10.0.0.0 TO 192.168.1.255]": [1, 3], "NOT 10.0.0.0/8": [1, 2, 4, 5, 6]}.items():
        assert ids(search(df, query, "addr")) == expected, query
    plain = spark.createDataFrame(rows, "id int, addr string")
    assert ids(search(plain, "192.168.1.0/24", "addr", specs={"addr": FieldSpec("ip")})) == [1]
    with pytest.raises(QuerySyntaxError):
        search(df, "10.*.1.*", "addr")


def test_indexed_equals_on_read(spark, docs):
    indexed = index_fields(docs, {"content": "text"})
    for q in ["lights", "pilots AND NOT night", "rad*", '"northern lights"', "buoi~1"]:
        assert ids(search(indexed, q, "content")) == ids(search(docs, q, "content", text_fields=["content"]))
    stemmed = index_fields(docs, {"content": "text"}, {"content": "en_stem"})
    assert ids(search(stemmed, "scales streamed", "content", default_operator="OR")) == [1, 3]


def test_sql_operators(spark, docs):
    docs.createOrReplaceTempView("docs")
    run = lambda text: ids(search_sql(spark, text, docs, text_fields=["content"]))
    assert run("SELECT id FROM docs WHERE content TEXTSEARCH 'lights'") == [1, 3]
    assert run("select id from docs d where d.content textsearch 'lights' and status FIELDMATCH 'open'") == [1, 3]
    assert run("SELECT id FROM docs WHERE NOT (content INDEXQUERY 'lights') OR id = 1") == [1, 2, 4, 5]
    forms = ["* INDEXQUERY 'sea'", "_indexall indexquery 'sea'", "indexqueryall('sea')", "`category` FIELDMATCH 'sea'"]
    assert all(run(f"SELECT id FROM docs WHERE {f}") == [1, 3] for f in forms)
    assert run("SELECT count(*) AS id FROM docs WHERE content TEXTSEARCH 'it''s'") == [0]
    assert run("WITH h AS (SELECT * FROM docs WHERE content TEXTSEARCH 'pilots') SELECT h.id FROM h JOIN docs d ON h.id = d.id") == [1, 2, 4]


def test_rewrite_leaves_literals_and_names():
    keep = "SELECT 'a TEXTSEARCH ''b''' AS x, textsearch, indexquery FROM t -- c TEXTSEARCH 'd'\nWHERE fieldmatch = 'x' /* e TEXTSEARCH 'f' */"
    assert rewrite(keep, lambda *a: 1 / 0) == keep
    assert rewrite("a.b TEXTSEARCH 'it''s'", lambda c, q, o: f"<{c}|{q}|{o}>") == "<a.b|it's|textsearch>"


def test_random_boolean_queries_match_brute_force(spark):
    rng, words = random.Random(5), ["red", "blue", "green", "tall", "short"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string").cache()

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            w = rng.choice(words)
            return w, lambda s, w=w: w in re.findall(r"\w+", s or "")
        op = rng.choice(["AND", "OR", "NOT"])
        a, fa = make(depth - 1)
        if op == "NOT":
            return f"NOT ({a})", lambda s: not fa(s)
        b, fb = make(depth - 1)
        return f"({a}) {op} ({b})", (lambda s: fa(s) and fb(s)) if op == "AND" else (lambda s: fa(s) or fb(s))

    for _ in range(12):
        text, test = make(3)
        assert ids(df.filter(condition(df, text, "t", text_fields=["t"]))) == [i for i, s in rows if test(s)], text


def test_plan_stays_in_spark(docs):
    plan = search(docs, "lights AND rad*", "content", text_fields=["content"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_unsplit_tests_equal_tests_on_tokens(spark):
    """The tests that do not split a text give what the tests on its tokens give: odd marks, long tokens, wildcards, phrases, fuzzy words."""
    import random

    rng = random.Random(6)
    pieces = ["Alpha", "beta", "ALPHABET", "alp", "bet4", "été", "x" * 255, "y" * 256, "gamma_delta", "a-b", "1.5", "ÄRGER", "日本", "betas", "b"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice([" ", ", ", "_", "-", "\n", ". ", ""]) for _ in range(rng.randint(0, 7)))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("tok", tokens("t")).cache()
    queries = ["alpha", "BETA", "alp*", "*bet", "*a*", "b?t*", "alpha~1", "betas~2", "b~1", "été", "é*", "ärger", "日*", "1", '"alpha beta"', '"beta alp alpha"', '"gamma delta"', "x*", "y*", "*y", "y" * 256, "gamma_d*", "a-*", "??", "*", "nothing"]
    for q in queries:
        plain = condition(df, q, "t", text_fields=["t"])
        split = condition(df, q, "t", specs={"t": FieldSpec("text", token_column="tok")})
        assert [r.id for r in df.filter(plain != split).collect()] == [], q


def test_search_in_statements_over_several_tables(spark):
    text = {"search": {"kind": "text"}}
    a = spark.createDataFrame([(1, "red fox", "x"), (2, "blue whale", "y"), (3, None, "x")], "id int, body string, tag string").withMetadata("body", text)
    b = spark.createDataFrame([(1, "quick brown"), (2, "very slow"), (3, "quick")], "id int, note string").withMetadata("note", text)
    a.createOrReplaceTempView("ta")
    b.createOrReplaceTempView("tb")
    run = lambda q: sorted(r[0] for r in search_sql(spark, q).collect())
    assert run("SELECT l.id FROM ta l JOIN tb AS r ON l.id = r.id WHERE l.body TEXTSEARCH 'fox' AND r.note TEXTSEARCH 'quick'") == [1]
    assert run("SELECT l.id FROM ta l, tb r WHERE l.id = r.id AND (body TEXTSEARCH 'whale' OR note INDEXQUERY 'quick')") == [1, 2, 3]
    assert run("SELECT id FROM ta WHERE tag FIELDMATCH 'x' AND id IN (SELECT id FROM tb WHERE note TEXTSEARCH 'brown')") == [1]
    assert run("SELECT ta.id FROM ta LEFT JOIN tb USING (id) WHERE NOT tb.note TEXTSEARCH 'quick'") == [2]
    assert run("SELECT id FROM ta WHERE _indexall INDEXQUERY 'whale OR x'") == [1, 2, 3]
    assert run("WITH c AS (SELECT * FROM ta WHERE body TEXTSEARCH 'fox') SELECT id FROM c") == [1]
    with pytest.raises(FieldError):
        run("SELECT l.id FROM ta l JOIN tb r ON l.id = r.id WHERE indexqueryall('fox')")
    assert [r.id for r in a.filter(search_expr(a, "id > 1 AND body TEXTSEARCH 'wh*'")).collect()] == [2]
