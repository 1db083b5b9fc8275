"""Queries with SQL against DuckDB, and defined cases of the operators behind them."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skyquill.llm import catalogue, chat, mixing, quality_rules, url_filter

DATA = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return sorted(str([_plain(r[c]) for c in columns]) for r in df.collect())


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    relation = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert rows(df) == sorted(str([_plain(r[i]) for i in order]) for r in relation.fetchall())


def test_native_queries_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c\nd", "s", "en", 7)], "doc_id long, text string, source string, lang string, n_chars long")
    for df in (quality_rules.judge(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("bits", [20, 3])
def test_statistics_match_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "a b c a b c", "é ü x é ü x é ü x", "x\nx\n\n \nx y\nx", "#*$ %&| <>", "w " * 3000, "a b c d " * 40 + "e f g", "one\r\ntwo\x0bthree\x0cfour"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.text_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(texts[r.doc_id]), texts[r.doc_id]


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    boiler = " ".join(f"b{k}" for k in range(80))
    docs = [(i, f"{own(i)}\n {boiler.upper()}  ", "h1") for i in range(6)]
    docs += [(10, f"{' '.join(own(10).split()[:40])}\n{boiler}", "h1"), (11, f"{own(11)}\n{boiler}", "h2"), (12, f"{' '.join(own(12).split()[:40])}\n{boiler}", None)]
    docs += [(20 + i, own(99), "h1") for i in range(9)]  # copies of one text count once
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in docs], "doc_id long, text string, source string, kept string")
    got = {r.doc_id: r for r in quality_rules.judge(df.drop("kept"), max_docs=5).collect()}
    assert got[0].n_removed_words == 0 and got[1].n_removed_words == 80 and got[1].kept and not got[10].kept and not got[10].base_failed
    assert got[11].n_removed_words == 0 and got[12].kept and all(got[20 + i].kept for i in range(9))
    kept = quality_rules.filter_documents(df, max_docs=5)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs if i != 10)
    assert quality_rules.judge(df.drop("kept").limit(0)).count() == 0
    few = {r.doc_id: r.n_removed_words for r in quality_rules.judge(df.drop("kept"), max_docs=5, max_share=0.9).collect()}
    assert not any(few.values())  # 7 of the host's 8 texts have the line


def test_one_of_many_near_copies_stays_whole(spark):
    lines = [" ".join(f"l{k}w{j}" for j in range(12)) for k in range(8)]
    docs = [(i, "\n".join([*lines[: i % 8], f"edit {i}", *lines[i % 8 + 1 :]]), "h") for i in range(40)]
    out = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert any(r.kept for r in out) and next(r for r in out if r.doc_id == 0).kept


def test_mixture_hits_target_weights(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") < 3600, "big").when(F.col("id") < 3990, "small").alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(docs, {"big": 1, "small": 2, None: 1})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1000) < 150 and abs(n["small"] - 2000) < 250 and abs(n[None] - 1000) < 150
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_", "shuffle_key"] and {r["copy"] for r in out.select("copy").distinct().collect()} == {1}
    assert sorted(r[0] for r in out.filter("doc_id = 3600").select("copy_").collect()) == list(range(out.filter("doc_id = 3600").count()))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7), {"big": 1, "small": 2, None: 1}).collect()))
    assert mixing.mix(docs, {"big": 0, "small": 1}, other_weight=0).filter("source = 'big' OR source IS NULL").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs, {"big": 1, "small": 2, None: 1}).collect()))
    assert abs(mixing.mix(docs, size=400).count() - 400) < 80


def test_urls(spark):
    judge = url_filter.UrlJudge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT, 2)
    for url, rule, verdict in [
        ("http://a.b.net/x", "net/", "block"), ("http://A.Example.NET/en/x", "example.net/en/", "allow"), ("http://notexample.net/en/x", "net/", "block"), ("http://net", None, "allow"),
        ("http://example.com/de/x?y", "example.com/de/", "block"), ("http://example.com/fr/x", None, "allow"), ("https://x.org/fr/casino", "org/fr/", "allow"), ("http://casino-win.com/a", None, "block"),
        ("http://cheap-pills.com", None, "block"), ("http://cheap.com/cheap", None, "allow"), ("http://winter.com/casinos", None, "allow"), ("casino", None, "block"), ("no scheme", None, "allow"), (None, None, "allow"),
    ]:
        got = judge(url)
        assert (got[2], got[3]) == (rule, verdict), url
    assert url_filter.split_url("http://Ab.C/D?e#f") == ("ab.c", "/D") and url_filter.split_url("http://x?y=/z") == ("x", "") and url_filter.split_url("x/y") == ("", "")
    df = spark.createDataFrame([(1, "http://a.net/"), (1, None)], "page_id long, url string")
    assert url_filter.judge_urls(df, "page_id", "url").count() == 2 and url_filter.judge_urls(df.limit(0), "page_id", "url").count() == 0


def test_url_lists_from_a_file(spark, tmp_path):
    (tmp_path / "lists.txt").write_text("# ours\nstrict Bad-Word\nsoft one\n\nsoft\ttwo\nblock Evil.example/x/\nallow ok.example/\nsoft one\n")
    lists = url_filter.read_lists(spark, f"file://{tmp_path}/lists.txt")
    assert lists == {"rules": [("allow", "ok.example/"), ("block", "evil.example/x/")], "strict": ["bad-word"], "soft": ["one", "two"]}
    df = spark.createDataFrame([(1, "http://a.b/bad-word"), (2, "http://a.b/one"), (3, "http://a.b/one-two"), (4, "http://q.evil.example/x/y"), (5, "http://ok.example/bad-word")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, "page_id", "url", **lists).collect()} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}
    (tmp_path / "bad.txt").write_text("nonsense")
    with pytest.raises(ValueError):
        url_filter.read_lists(spark, f"file://{tmp_path}/bad.txt")


def test_chat_keeps_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 64)
    a = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")]
    convs = {1: a[:2], 2: a, 3: a, 4: [(0, "user", "hi"), (1, "assistant", "other")], 5: a[:1], 6: [(None, None, None)], 7: [(i, "user", f"m{i}") for i in range(200)], 8: [(i, "user", f"m{i}") for i in range(130)], 9: [(0, "user", "x<|end|>")]}
    data = [(c, t, r, x, "extra") for c, turns in convs.items() for t, r, x in turns] * 2
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part string")
    out = chat.render(df).collect()
    assert sorted({r.conv_id for r in out}) == [2, 4, 6, 7, 9]
    assert [r.n_same for r in out if r.conv_id == 2] == [2] and len([r for r in out if r.conv_id == 7]) == 4
    text = "".join(r.text for r in sorted(out, key=lambda r: r.part) if r.conv_id == 7)
    assert text == "".join(f"<|user|>\nm{i}<|end|>\n" for i in range(200))
    assert next(r.text for r in out if r.conv_id == 9) == "<|user|>\nx< |end|><|end|>\n" and next(r.text for r in out if r.conv_id == 6) == "<|unknown|>\n<|end|>\n"
    assert chat.render(df.limit(0)).count() == 0
    monkeypatch.setattr(chat, "PART", 1024)
    whole = chat.render(df).collect()
    assert len(whole) == len({r.conv_id for r in whole}) == 5 and next(r.text for r in whole if r.conv_id == 7) == text


def test_chat_matches_brute_force(spark):
    import random

    rng = random.Random(2)
    convs = {c: tuple((t, "u", str(rng.randint(0, 1))) for t in range(rng.randint(1, 6))) for c in range(60)}
    df = spark.createDataFrame([(c, *turn) for c, turns in convs.items() for turn in turns], "conv_id long, turn long, role string, text string")
    covered = lambda c: any((len(o) > len(convs[c]) and o[: len(convs[c])] == convs[c]) or (o == convs[c] and d < c) for d, o in convs.items())
    assert sorted(r.conv_id for r in chat.maximal(df).collect()) == [c for c in convs if not covered(c)]
