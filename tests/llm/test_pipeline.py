import hashlib
import inspect
import math
import os
import random
import re

import pytest

import corpus_pipeline as cp
from skyquill.llm import decontaminate, jaccard_join, mixing, pipeline, quality_rules, toxicity
from skyquill.llm.common import table
from tests.llm.test_pairs import brute

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@data
def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)
    for name, stage in cp.STAGES[:-1]:
        ids = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, DATA)
        out = spark.createDataFrame(out.collect(), out.schema)
        assert out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and kept
        if name == "quality rules":
            assert ids - kept == {r.doc_id for r in quality_rules.judge(docs).filter("NOT kept").collect()}
        elif name == "toxicity":
            chain = toxicity.fit(docs, toxicity.training_labels(spark, DATA))
            assert ids - kept == {r.doc_id for r in toxicity.classify(docs, chain).filter("is_toxic").collect()}
        elif name == "n-gram Jaccard join":
            rows = jaccard_join.join_components(docs).collect()
            assert kept == {r.component_id for r in rows}
        else:
            gone = {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, DATA, "benchmark")).collect()}
            assert ids - kept == gone
            bench = [" ".join(r.text.lower().split()) for r in table(spark, DATA, "benchmark").collect()]
            words = lambda t: " ".join(re.sub(r"[|\s]+", " ", t.lower()).split())
            assert not [r.doc_id for r in out.collect() if any(b in words(r.text or "") for b in bench if len(b.split()) >= 13)]
        docs = out
    mixed = pipeline.mixed(spark, docs, DATA)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


@data
def test_run_and_registration(spark):
    import __spark_entry__ as entry

    out = cp.run(spark, DATA)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"} == set(out.columns) and out.count() > 0
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


# ---- every stage against plain Python, on made tables with odd rows

WORDS = [a + b + c for a in ("ka", "lo", "mi", "re", "su") for b in ("ba", "den", "fil", "gor", "hum") for c in ("", "n", "st", "ek")]
ITEM = "when the old clock in the tower strikes seven times how many birds leave the roof before the bell falls silent again"


def made(seed=3):
    """(doc_id, text, lang, source, n_chars, copy): plain documents, short and repetitive ones, toxic ones, near copies, leaks, repeated rows, nulls."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = {i: prose(rng.randint(60, 120)) for i in range(1, 121)}
    for i in range(1, 121, 6):
        texts[i] = " ".join(w if k % 9 else rng.choice(["zorgel", "blunk"]) for k, w in enumerate(prose(90).split()))
    for i in (10, 20, 30):
        near = texts[i].split()
        near[5] = "changed"
        texts[200 + i] = " ".join(near)
        texts[300 + i] = texts[i]
    texts |= {400: prose(70) + " " + ITEM, 401: "too short", 402: "same words here " * 40, 403: None, 404: "", 405: prose(9000)}
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "mine") for i, t in texts.items()]
    return [*rows, rows[14], rows[14], (None, prose(80), None, None, None, "mine"), (None, None, None, None, None, None)]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_whole_run_equals_brute_force(spark, tmp_path):
    rows = made()
    toxic = lambda t: "zorgel" in (t or "").split() or "blunk" in (t or "").split()
    labels = [(i, 1, int(toxic(t))) for i, t, *_ in rows if i is not None and i <= 120] + [(None, 1, 1), (7, None, None), (9999, 0, 1)]
    write(spark, f"file://{tmp_path}", rows, labels, [(1, ITEM), (2, None)])
    got = sorted(((r.doc_id, r.text, r.source, r["copy"], r["copy_"]) for r in cp.run(spark, f"file://{tmp_path}").collect()), key=str)

    def words(t):
        return re.findall(r"[^\x20\x09-\x0d]+", t or "")

    def good(t):
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen: dict = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        again = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    kept = [r for r in rows if good(r[1]) and not toxic(r[1])]
    group = brute([(i, t) for i, t in dict((r[0], r[1]) for r in kept if r[0] is not None).items()])
    once: dict = {}
    for r in kept:
        if r[0] is None or group[r[0]][1] == r[0]:
            once.setdefault(r[0], r)
    left = [r for r in once.values() if ITEM not in (r[1] or "")]
    by_source: dict = {}
    for r in left:
        by_source[r[3]] = by_source.get(r[3], 0) + 1
    expected = []
    for i, t, lang, source, n, mine in left:
        rate = len(left) / len(by_source) / by_source[source]
        parts = max(1, math.ceil(rate / mixing.MAX_RATE))
        k = 0
        for part in range(1, parts + 1):
            digest = hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}|{hashlib.md5(t.encode()).hexdigest()}|{part}".encode()).hexdigest()
            u, small = int(digest[:8], 16) / 2**32, rate / parts
            term = cumulated = math.exp(-small)
            own = 0
            while u >= cumulated and own < mixing.TERMS:
                own += 1
                term *= small / own
                cumulated += term
            k += own
        expected += [(i, t, source, mine, c) for c in range(k)]
    assert got == sorted(expected, key=str)
    assert {10, 20, 30} <= {r[0] for r in left} and not {210, 220, 230, 310, 400, 401, 402, 403, 404} & {r[0] for r in left}


def test_stages_on_empty_tables(spark, tmp_path):
    write(spark, f"file://{tmp_path}", [], [], [])
    docs = table(spark, f"file://{tmp_path}", "documents")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
