import html
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm import html_text as ht
from skyquill.llm import language_model as lm
from skyquill.llm import quality_model as qm
from skyquill.llm import toxicity as tx

DATA = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def text_of(rng, extra=(), n=40):
    return " ".join(rng.choices(["tree", "house", "river", "stone", "cloud", *extra], k=n))


def test_chain_learns_categories_in_order():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        a, b = i % 5 == 0, i % 7 == 0
        rows.append(text_of(rng) + (" idiot" if a else "") + (" trash" if b else ""))
        labels.append([a, b, a or b])
    chain = tx.fit_chain(rows, np.array(labels, float), ("a", "b", "c"))
    assert [len(m.chained) for m in chain.models] == [0, 1, 2]
    chunk = next(c for _, _, c in A.chunks(pa.array(["an Idiot here", "tree river", "", "trash", "idiot trash"]), lower=True))
    p = chain.predict(*chain.known_words(chunk), 5)
    assert (p[:, 2] > chain.threshold).tolist() == [True, False, False, True, True] and p[0, 0] > 0.5 > p[3, 0]
    none = tx.fit_chain([], np.zeros((0, 3)), ("a", "b", "c"))
    assert none.predict(np.zeros(0, int), np.zeros(0, np.uint64), 2).max() < 1e-6


def test_kinds_split_toxic_rows_by_their_words():
    rows = np.repeat(np.arange(40), 2)
    words = np.array([[0, 1] if i < 10 else [2, 3] if i < 20 else [4, 5] for i in range(40)]).ravel()
    kinds = tx.kinds_of(rows, words, np.array([1.0] * 20 + [0.0] * 20))
    assert kinds[20:].sum() == 0 and (kinds[:20].sum(axis=1) == 1).all()
    assert {tuple(k) for k in kinds[:10]} != {tuple(k) for k in kinds[10:20]} and len({tuple(k) for k in kinds[:10]}) == 1
    assert tx.kinds_of(np.zeros(0, int), np.zeros(0, int), np.ones(3)).sum() == 3 and tx.kinds_of(rows, words, np.zeros(40)).sum() == 0


def test_toxicity_on_frames(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, ["zarg", "blun"] if i % 4 == 0 else [], 30)) for i in range(200)] + [(900, None), (901, ""), (902, "zarg " * 20000), (902, "zarg " * 20000), (3, "another text"), (None, "zarg blun")]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, p_toxic double, is_toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(7777, 1), (3, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    chain = tx.fit(docs, labels)
    assert chain.names == ("kind_1", "kind_2", "toxic") and [len(m.chained) for m in chain.models] == [0, 1, 2]
    out = tx.classify(docs, chain)
    assert out.columns == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "is_toxic"]
    got = [(r.doc_id, r.is_toxic) for r in out.collect()]
    loud = spark.createDataFrame([(1, "TREE!! (ZARG!!) HOUSE"), (2, "tree, -- house!")], "doc_id long, text string")
    assert [r.is_toxic for r in tx.classify(loud, chain).orderBy("doc_id").collect()] == [True, False]
    assert dict(got)[902] and not dict(got)[900] and not dict(got)[901] and dict(got)[None] and len(got) == 206
    assert sum(t == (i % 4 == 0) for i, t in got if i is not None and i < 200) >= 198
    kept = tx.remove_toxic(docs, chain)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in got if not t)
    empty = tx.fit(docs, labels.limit(0))
    assert tx.classify(docs, empty).filter("is_toxic").count() == 0 and tx.classify(docs.limit(0), chain).count() == 0


def test_chain_of_frames_equals_the_chain_of_all_words(spark):
    """Words that no selection can pass are left out before the driver sees them: the fitted chain is the same as from all words."""
    rng = random.Random(5)
    rows = [(i, text_of(rng, ["zarg", "blun", "tew"] if i % 5 == 0 else ["fine", "calm"] if i % 3 == 0 else [], rng.randint(1, 40)) + f" own{i}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0 and i % 2), int(i % 5 == 0)) for i, _ in rows], "doc_id long, severe int, toxic int")
    chain = tx.fit(docs, labels, label_cols=("severe", "toxic"))
    order = sorted((r.h, i) for i, r in enumerate(docs.select(F.xxhash64("doc_id").alias("h")).collect()))
    own = [i for _, i in order]
    got = [A.row_sets(c.row, c.word_hash(), e - s)[:2] for s, e, c in A.chunks(pa.array([rows[i][1] for i in own]), lower=True)]
    y = np.array([[i % 5 == 0 and i % 2, i % 5 == 0] for i in own], float)
    plain = tx.fit_sets(got[0][0], got[0][1], y, ("severe", "toxic"), np.array([h % tx.FOLDS for h, _ in order]))
    for r in tx.classify(docs, chain).collect():
        words = np.unique(next(c for _, _, c in A.chunks(pa.array([rows[r.doc_id][1]]), lower=True)).word_hash())
        p = []
        for model in plain.models:  # word by word
            logit = model.bias + sum(float(w) for h, w in zip(model.words, model.weights) if h in words) + sum(c * q for c, q in zip(model.chained, p))
            p.append(1 / (1 + math.exp(-logit)))
        assert math.isclose(r.p_severe, p[0], abs_tol=1e-6) and math.isclose(r.p_toxic, p[1], abs_tol=1e-6) and r.is_toxic == (p[1] >= plain.threshold)


def test_subword_model_learns_marks_and_repeats(spark):
    rng = random.Random(3)
    good = [text_of(rng, n=rng.randint(10, 80)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in text_of(rng).split()) for _ in range(40)] + [" ".join([w] * 15) for w in (text_of(rng, n=2).split() * 40)[:60] for w in [w + str(rng.random())[2:5]]]
    docs = spark.createDataFrame([*enumerate(good + bad), (999, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(250) if i % 3], "doc_id long, quality int")
    model = qm.fit(docs, labels, "doc_id", "text", "quality")
    got = {r.doc_id: r.score for r in qm.score(docs, model).collect()}
    unseen = [i for i in range(250) if i % 3 == 0]
    assert np.mean([(got[i] > 0.5) == (i < 150) for i in unseen]) > 0.95 and 0 <= got[999] <= 1
    odd = spark.createDataFrame([(1, "a b", 0.5, True), (None, None, 0.1, False), (1, "a b", 0.5, True)], "doc_id long, text string, score double, held_out boolean")
    assert sorted((r.doc_id or 0, r.score) for r in qm.score(odd, model).collect())[1:] == [(1, qm.score(odd, model).filter("doc_id = 1").first().score)] * 2
    flat = qm.fit(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in qm.score(docs, flat).collect()} == {0.5} and qm.score(docs.limit(0), model).count() == 0


def test_feature_arrays_match_a_plain_count():
    texts = ["ab abc é ab ab", "", "x"]
    chunk = next(c for _, _, c in A.chunks(pa.array(texts), lower=False))
    parts = qm.features(chunk)
    n = np.zeros(3)
    for row, _ in parts:
        n += np.bincount(row, minlength=3)
    # five words; one word repeats the one before it (none the one two before); one 3-gram
    assert n.tolist() == [5 + 1 + 1, 0, 1]


def test_scores_equal_a_plain_sum_over_features(spark):
    rng = np.random.default_rng(7)
    model = {"score": rng.standard_normal(qm.BUCKETS).astype(np.float32), "bias": np.array([0.3])}
    texts = ["Ab abc é ab ab", "", None, "x", "same same other same", "long " * 3000, "Über-größe 12345 naïve"]
    one = lambda t: next(c for _, _, c in A.chunks(pa.array([t]), lower=False))
    mask = np.uint64(qm.BUCKETS - 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in qm.score(docs, model).collect()}
    for i, t in enumerate(texts):
        words, total = re.findall(r"[^\x20\x09-\x0d]+", t or ""), []
        for k, w in enumerate(words):
            total.append(int((one(w).word_hash()[0] ^ np.uint64(0x51)) & mask))
            total += [back for back in (1, 2) if k >= back and words[k - back] == w]
            for n in qm.GRAMS:
                for j in range(len(w) - n + 1):
                    edge = (j == 0) + 2 * (j + n == len(w))
                    total.append(int(A.mix(one(w[j : j + n]).word_hash()[:1] + np.uint64(edge) + np.uint64(7))[0] & mask))
        logit = 0.3 + float(np.mean([model["score"][b] for b in total])) if total else 0.3
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit)), abs_tol=1e-5), t


@data
def test_quality_query_on_held_out_rows(spark):
    df = qm.op9_subword_quality(spark, DATA)
    assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = df.filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


@data
def test_toxicity_query_on_held_out_rows(spark):
    rows = tx.op1_toxicity_chain(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("crc32(cast(doc_id AS string)) % 5 = 0").collect()
    assert np.mean([r.is_toxic == bool(r.toxic) for r in rows]) > 0.94


# ---- language model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = lm.Network(seed=1)
    symbols = rng.integers(0, lm.WORDS + lm.TAILS, 12)
    states = rng.standard_normal((12, lm.HIDDEN)).astype(np.float32)
    grad = lm._Gradient()
    _, back = net.log_probability(states, symbols, grad)
    loss = lambda: -net.log_probability(states, symbols).mean()
    for name in ("c", "cb", "w", "wb"):
        own, g = getattr(net, name), getattr(grad, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = own[at]
        own[at] = kept + 1e-2
        up = loss()
        own[at] = kept - 1e-2
        down = loss()
        own[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3
    at = np.unravel_index(np.abs(back).argmax(), back.shape)
    states[at] += 1e-2
    up = loss()
    states[at] -= 2e-2
    assert abs((up - loss()) / 2e-2 - back[at]) < 2e-3


def test_output_is_a_distribution_and_windows_carry_state():
    net = lm.Network(seed=2)
    state = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.WORDS + lm.TAILS)
    assert abs(np.exp(net.log_probability(np.repeat(state, len(every), 0), every)).sum() - 1) < 1e-4
    symbols = np.random.default_rng(2).integers(0, lm.WORDS, 100)
    first, count = np.array([0, 60, 97]), np.array([60, 37, 3])
    got = lm.score_documents(net, symbols, first, count)
    for f, c, g in zip(first, count, got):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for s in symbols[f : f + c]:
            total += net.log_probability(h, np.array([s]))[0]
            h, _ = net.step(h, np.array([s]))
        assert abs(g - total) < 1e-2


def test_training_learns_order():
    net = lm.Network(seed=3)
    run = np.array([0, *([5, 30, 200] * 7)] * 400)
    before = lm.score_documents(net, run[:22], np.array([0]), np.array([22]))[0]
    lm.train(net, run, 3, 0.01, most=64)
    assert lm.score_documents(net, run[:22], np.array([0]), np.array([22]))[0] > before * 0.3


@pytest.mark.parametrize("head", [1 << 22, 40])
def test_base_score_and_counts_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(80)], k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Never Seen never"), (502, "Never Seen never"), (503, "W1 " * 4000)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = lm.score(df, held).collect()
    is_held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c: dict = {}
    for i, t in rows:
        if not is_held(i):
            for w in tokens(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(r.doc_id), len(own), sum(c.get(w, 0) > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0
    assert lm.score(df.limit(0), held).count() == 0


@pytest.mark.parametrize("head", [1 << 22, 300])
def test_whole_score_matches_brute_force(spark, monkeypatch, head):
    """Words of the softmax, rarer words by their class's shares, and words never seen, one token at a time."""
    monkeypatch.setattr(lm, "HEAD", head)
    flat = lm.Network(seed=9).flat
    monkeypatch.setattr(lm, "_learn", lambda docs, lexicon: flat)
    rng = random.Random(8)
    words = [f"w{i}{'aenrst.,!1'[i % 10]}" for i in range(lm.WORDS + 700)]
    rows = [(i, " ".join(words)) for i in range(1, 3)] + [(i, " ".join(rng.choices(words[:4200], k=rng.randint(0, 300)))) for i in range(3, 60)] + [(70, "never seen, this"), (71, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 10 == 0).collect()}
    c: dict = {}
    for i, t in rows:
        if i % 10:
            for w in tokens(t):
                c[w] = c.get(w, 0) + 1
    hash_of = lambda w: int(lm.END) if w is None else int(next(x for _, _, x in A.chunks(pa.array([w]), lower=True)).word_hash()[0])
    tail_of = lambda w: 0 if w is None else int(lm._tail_class(np.array([w.encode()[-1]]))[0])
    ranked = _top_words(c, hash_of, -(-got[1].train_tokens // head))
    top = set(ranked)
    sums, kinds = np.zeros(lm.TAILS), np.zeros(lm.TAILS)
    for w, n in c.items():
        if w not in top:
            sums[tail_of(w)] += n
            kinds[tail_of(w)] += 1
    net, symbol = lm.Network(flat), {w: k for k, w in enumerate(ranked)}
    for i, t in rows[2:]:
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for w in tokens(t):
            k = symbol.get(w, lm.WORDS + tail_of(w))
            total += float(net.log_probability(h, np.array([k]))[0]) / math.log(10)
            if k >= lm.WORDS:
                total += math.log10((c.get(w, 0) + 0.1) / (sums[tail_of(w)] + 0.1 * (kinds[tail_of(w)] + 1)))
            h, _ = net.step(h, np.array([k]))
        assert math.isclose(got[i].score, total, rel_tol=1e-4, abs_tol=1e-3), i


def _top_words(c, hash_of, least):
    """The end and the most frequent words, of those in the head, in the order of their numbers."""
    return [None, *sorted((w for w in c if w is not None and c[w] >= least), key=lambda w: (-c[w], hash_of(w)))[: lm.WORDS - 1]]


def test_rounds_of_means_equal_one_weighted_mean(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(40 + i % 50))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    empty = np.zeros(0, np.int64)
    lexicon = lm.Lexicon(empty.astype(np.uint64), empty, [], empty)
    first = lm._learn(docs, lexicon)
    monkeypatch.setattr(lm, "FAN", 2)
    assert np.allclose(first, lm._learn(docs, lexicon), atol=1e-5)


def test_every_training_token_reaches_the_network(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 90))) for i in range(900)] + [(901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", F.col("doc_id") % 10 == 0)
    empty = np.zeros(0, np.int64)
    lexicon = lm.Lexicon(empty.astype(np.uint64), empty, [], empty)
    models = lm._models(docs, lm.Network().flat, lexicon).collect()
    assert sum(r.n for r in models) == sum(len(tokens(t)) for i, t in rows if i % 10) and len(models) == 3


@data
def test_model_beats_the_base_on_held_out_documents(spark):
    rows = lm.op8_recurrent_lm(spark, DATA).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


# ---- pages


@pytest.fixture(scope="module")
def model():
    return ht.default_model(250)


def test_messages_give_exact_marginals():
    tree = ht.parse("<div><p>one <b>two</b></p><ul><li>x</ul></div>")
    forest = ht.Forest([tree])
    rng = np.random.default_rng(0)
    weights, edges = rng.standard_normal(ht.BUCKETS), rng.standard_normal((16, 2, 2))
    p, _ = ht.marginals(forest, weights, edges)
    own = np.bincount(forest.node, weights=weights[forest.bucket], minlength=forest.size)
    total, each = 0.0, np.zeros(forest.size)
    for k in range(2**forest.size):
        s = [(k >> i) & 1 for i in range(forest.size)]
        e = math.exp(sum(own[i] * s[i] for i in range(forest.size)) + sum(edges[forest.edge[i], s[forest.parent[i]], s[i]] for i in range(1, forest.size)))
        total += e
        each += e * np.array(s)
    assert np.allclose(p, each / total)


def test_model_on_unseen_layouts(model):
    pages = ht.labelled_pages(120, seed=77)
    right = total = 0
    for page in pages:
        tree = ht.parse(page)
        y = ht.tree_labels(tree)
        tree.text = [x.replace(ht.MARK, "") for x in tree.text]
        p, _ = ht.marginals(ht.Forest([tree]), *model)
        for i, kind in enumerate(tree.kind):
            if kind == ht.TEXT and tree.text[i].strip():
                total += 1
                right += (p[i] > 0.5) == bool(y[i])
    assert right / total > 0.97


LONG = "The river rose for three days before it reached the lower bridge, and the people of the town carried what they could up the hill."
MORE = "On the fourth day the water fell again. Nobody had been hurt, but the mill and two of the old houses were gone for good."
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul>"
#: Pages laid out by hand, none of them by the generator of training pages: (html, text).
BY_HAND = [
    (f"<div>{LONG} {MORE}</div>", f"{LONG} {MORE}"),
    (f"<html><body><p>{LONG}</p><p>{MORE}</p></body></html>", f"{LONG} {MORE}"),
    (f"<body><article><h1>Flood</h1><p>{LONG}</p><p><a href='/map'>{MORE}</a></p></article></body>", f"Flood {LONG} {MORE}"),
    (f"<body><nav>{MENU}</nav><div id='content'><h1>Flood</h1><p>{LONG}</p><p>{MORE}</p></div><footer>&copy; 2024 The Paper</footer></body>", f"Flood {LONG} {MORE}"),
    (f"<body><div class='header'>{MENU}</div><div><div><div><p>{LONG}</p><div><p>{MORE}</p></div></div></div></div></body>", f"{LONG} {MORE}"),
    (f"<body><main><h1>Flood</h1><p>{LONG}<p>{MORE}</main><aside><h3>Related</h3>{MENU}</aside></body>", f"Flood {LONG} {MORE}"),
    (f"<body><div class='cookie-banner'>We use cookies to improve this site. <a href='/c'>Settings</a></div><article><p>{LONG}</p><blockquote><p>{MORE}</p></blockquote></article></body>", f"{LONG} {MORE}"),
    (f"<body><article><h2>Flood</h2><p>{LONG}</p><div class='advert'>Buy new boats today, cheap and fast.</div><p>{MORE}</p></article><section class='comments'><p>I saw it, terrible.</p><p>Me too, from the hill.</p></section></body>", f"Flood {LONG} {MORE}"),
    (f"<body><article><p>{LONG}</p><ul><li>{MORE}</li><li>The mill stood there since 1820.</li></ul></article><form><label>Mail</label><input><button>Send</button></form></body>", f"{LONG} {MORE} The mill stood there since 1820."),
    (f"<body><div class='sidebar'><h3>Popular</h3>{MENU}</div><section class='post'><h1>Flood</h1><div>{LONG}</div><div>{MORE}</div></section></body>", f"Flood {LONG} {MORE}"),
    (f"<body><article><svg width='1'/><p>{LONG}</p><p>It was <math><mi>x</mi></math> high. <svg><text>no</text></svg>{MORE}</p></article></body>", f"{LONG} It was x high. {MORE}"),
    (f"<table><tr><td>{MENU}</td><td><h1>Flood</h1><p>{LONG}</p><p>{MORE}</p></td></tr></table>", f"Flood {LONG} {MORE}"),
]


def test_pages_laid_out_by_hand(spark, model):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(BY_HAND)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract(df, model=model).collect()}
    assert [i for i, (_, text) in enumerate(BY_HAND) if got[i] != text] == []


def test_groups_of_pages_do_not_change_texts(spark, model, monkeypatch):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(BY_HAND)], "page_id long, url string, html string").coalesce(1)
    first = sorted(map(tuple, ht.extract(df, model=model).collect()))
    monkeypatch.setattr(ht, "GROUP_CHARS", 10)
    assert first == sorted(map(tuple, ht.extract(df, model=model).collect()))


def test_pages_with_defined_cases(spark, model):
    body = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav><article><h1>Big  news</h1><p>Caf&eacute; &amp;\n tea<br>today, and <b>so</b> on.</p><p>Second &lt;b&gt;</p></article><footer>&copy; site</footer></body></html>"
    rows = [(1, "u", body), (2, "u", None), (3, None, ""), (4, "u", "<"), (5, "u", "<p" * 20000), (6, "u", body[: len(body) // 2]), (1, "u", body), (7, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in ht.extract(df, model=model).collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert len(got) == 8 and all(n == len(t) for _, t, n in got)
    assert texts[1] == "Big news Café & tea today, and so on. Second <b>" and texts[2] == texts[3] == ""
    assert ht.extract(df.limit(0), model=model).count() == 0


@data
def test_articles_of_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in ht.op3_tree_model_extraction(spark, DATA).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        assert r.text == " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
