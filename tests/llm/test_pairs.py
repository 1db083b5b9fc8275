import random
import re

import numpy as np
import pytest

from skyquill.llm import arrays as A
from skyquill.llm import decontaminate as dc
from skyquill.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= 80 * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(400)]
    shared = rng.choices(vocabulary, k=70)
    texts = []
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        texts.append(base)
        for _ in range(rng.randint(0, 9)):
            near = list(base)
            for _ in range(rng.randint(0, 8)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(near)
    texts += [rng.choices(vocabulary, k=30) + shared + rng.choices(vocabulary, k=30) for _ in range(25)]
    rows = [(i, " ".join(t) if i % 3 else " ".join(t).upper()) for i, t in enumerate(texts)]
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, rows[0][1]), (n + 6, "solo"), (n + 7, "the " * 5000)]


@pytest.mark.parametrize("seed", [3, 4])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, node string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(df).collect()}
    assert got == brute(rows)


def test_components_with_few_common_shingles_are_heavy(spark, monkeypatch):
    monkeypatch.setattr(jj, "HEAVY_LEAST", 3)
    monkeypatch.setattr(jj, "VERIFY", 50.0)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join_components(df).collect()} == brute(rows)


def test_repeated_rows_empty_tables_and_one_of_each(spark):
    rows = corpus(3)
    twice = [*rows, *rows[:10]]
    df = spark.createDataFrame([(i, t, "a") for i, t in twice], "doc_id long, text string, _rank string")
    expected = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in jj.join_components(df).collect()) == sorted((i, expected[i][1]) for i, _ in twice)
    kept = sorted(r.doc_id for r in jj.keep_one(df.withColumnRenamed("_rank", "extra")).collect())
    assert kept == sorted(i for i, (_, c) in expected.items() if i == c)
    assert jj.join_components(df.limit(0)).count() == 0


def test_longer_prefixes_ask_for_more_matches():
    sizes = np.array([100, 100, 3, 0])
    guess = np.ones(203)
    guess[100:200] = 500.0
    matches, lengths = jj.choose_prefixes(sizes, guess)
    assert matches[0] == 1 and lengths[0] == 21 and matches[1] > 1 and lengths[1] == 20 + matches[1] and lengths[3] == 0


def test_chunks_agree_with_a_plain_split():
    import pyarrow as pa

    texts = ["Ab  c", "", "\n", "é x y", "end", None, "tail "]
    array = pa.array(texts, pa.string()).fill_null("")
    seen = {}
    for start, end, chunk in A.chunks(array, lower=True, limit=6):
        words = chunk.word_hash()
        for i in range(start, end):
            k = i - start
            own = words[chunk.first[k] : chunk.first[k] + chunk.count[k]].tolist()
            plain = WORD.findall((texts[i] or "").translate(LOWER))
            assert len(own) == len(plain)
            for w, h in zip(plain, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


ITEM = "If Anna buys 5 apples and Bob sells 17 apples for 3 dollars each, how much money does Anna then have left over at the end?"


def test_changed_parameters_are_found_and_inconsistent_ones_are_not(spark):
    other = "If Carl buys 9 apples and Dora sells 21 apples for 4 dollars each, how much money does {} then have left over at the end?"
    docs = [
        (1, "Some words before. " + ITEM + " And after."), (2, other.format("Carl")), (3, other.format("Emil")), (4, None), (5, ""),
        (6, "A clean text about apples and dollars that asks how much money is left over at all."), (7, ITEM.replace(" ", " | ")), (8, "x " * 3000 + ITEM), (2, other.format("Carl")),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.find_leaks(df, bench).collect()}
    assert set(got) == {1, 2, 7, 8}
    assert got[1].n_changed == 0 and got[2].n_changed > 0 and got[2].n_matched == got[2].n_windows
    assert sorted(r.doc_id for r in dc.remove_leaks(df, bench).collect()) == [3, 4, 5, 6]
    assert dc.find_leaks(df.limit(0), bench).count() == 0 and dc.find_leaks(df, bench.limit(0)).count() == 0


def test_generated_items_with_every_kind_of_change(spark):
    """Templates with slots: changed one to one is found, bound twice or to two is not, unless plain words alone cover a run."""
    rng = random.Random(11)
    people = ["Anna", "Bob", "Carl", "Dora", "Emil", "Fritz", "Gina", "Hugo", "Ines", "Jost"]
    nouns = ["stones", "rivers", "clouds", "houses", "trees", "lamps", "chairs", "plates"]
    items, docs, expected = [], [], set()
    for i in range(12):
        words = [f"q{i}{rng.choice(nouns)}" for _ in range(14)]
        # a slot after every two or three words, so no plain run is long enough by itself
        make = lambda a, b, x, y, w=words: f"when {a} {w[0]} {w[1]} {x} {w[2]} {w[3]} {b} {w[4]} {w[5]} {y} {w[6]} {w[7]} {a} {w[8]} {w[9]} {x} {w[10]} {w[11]} {b} {w[12]} {w[13]} {y}"
        a, b, c, d = rng.sample(people, 4)
        x, y, u, v = rng.sample(range(2, 90), 4)
        items.append((i, make(a, b, x, y)))
        good = make(c, d, u, v)
        first = good.index(c)
        wrong_name = good[: first + len(c)] + good[first + len(c) :].replace(f" {c} ", f" {a} ", 1)
        merged = make(c, c, u, v)
        wrong_number = make(c, d, u, v)[::-1].replace(str(v)[::-1], str(u + 100)[::-1], 1)[::-1]
        for k, (text, leak) in enumerate([(make(a, b, x, y), True), (good, True), (make(f"{c} Maria", d, u, v), True), (wrong_name, False), (merged, False), (wrong_number, False), (" ".join(make(c, d, u, v).split()[:9]), False)]):
            n = 100 * i + k
            docs.append((n, f"some words stand before it and then {text} ends the text"))
            if leak:
                expected.add((n, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()} == expected


def test_short_items_are_compared_by_their_words(spark):
    items = [(1, "What is 17 times 23?"), (2, "one two three four five six seven"), (3, "Capital city"), (4, "1 2 3 4 5 6 7 8 9 10"), (5, "?!")]
    docs = [(1, "So: what is 17 times 23, he asked."), (2, "What is 18 times 23?"), (3, "x one two three four five six seven y"), (4, "The capital city of it."), (5, "capital CITY!"), (6, "0 1 2 3 4 5 6 7 8 9 10 11"), (7, "1 2 3 4 5 6 7 8 9 11"), (8, "?!")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()} == {(1, 1), (3, 2), (5, 3), (6, 4)}


def test_names_that_begin_sentences_or_have_more_words_are_found(spark):
    items = [(1, "Anna has 5 apples. Bob has 3 apples. How many apples do they have together?"), (2, "when Anna walks past the old bridge then Bob swims across while Eve waits there")]
    docs = [
        (1, "Carl has 9 apples. Dora has 4 apples. How many apples do they have together?"), (2, "when Mary Ann walks past the old bridge then Bob swims across while Eve waits there"),
        (3, "Carl has 9 apples. Dora has 4 apples. How many pears do they have together?"), (4, "A text about Anna, Bob and 5 apples. How many apples do they have together?"),
    ]
    df, bench = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    assert (got[1, 1].first_token, got[1, 1].last_token) == (0, 14) and (got[2, 2].first_token, got[2, 2].last_token) == (0, 15)


def test_capitals_and_small_letters_hide_no_copy(spark):
    docs = [(1, ITEM.upper()), (2, "so " + ITEM.lower() + " then"), (3, ITEM.upper().replace("ANNA", "CARL")), (4, ITEM.title())]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.find_leaks(df, bench).collect()}
    assert {1, 2, 4} <= set(got) and got[1].n_changed == 0 and got[1].n_matched == got[1].n_windows


def test_both_ways_of_the_join_agree(spark, monkeypatch):
    rng = random.Random(1)
    words = ["v" + str(i) for i in range(50)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(6)]
    docs = [(i, " ".join(rng.choices(words, k=60)) + (" " + items[i % 6][1] if i % 4 == 0 else "")) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    first = sorted(map(tuple, dc.find_leaks(d, b).collect()))
    monkeypatch.setattr(dc, "HELD", 0)
    assert first == sorted(map(tuple, dc.find_leaks(d, b).collect()))
    assert {(r[0], r[1]) for r in first} == {(i, i % 6) for i in range(0, 60, 4)}
