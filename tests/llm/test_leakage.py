import random

import numpy as np
import pytest

from lodestone.llm import leakage as L
from lodestone.llm.fingerprints import grams, unicode_words, winnow

D, I = "doc_id bigint, text string", "item_id bigint, suite string, text string"


def brute(docs, items, span=12):
    held = {}
    for i, _, t in items:
        w = unicode_words(t)
        for j in range(len(w) - span + 1):
            held.setdefault(tuple(w[j : j + span]), set()).add(i)
    words = [(d, unicode_words(t)) for d, t in docs]
    return {(d, i) for d, w in words for j in range(len(w) - span + 1) for i in held.get(tuple(w[j : j + span]), ())}


def data(seed=1):
    rng = random.Random(seed)
    items = [(i, "s", " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    items += [(100, "s", items[0][2][:80]), (101, "s", None), (102, "s", "")]
    docs = []
    for d in range(150):
        w = [f"v{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            part = rng.choice(items[:30])[2].split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.choice([11, 12, 13, 30])]
            w[5:5] = [x.upper() if rng.random() < 0.5 else f"**{x}**" for x in part]
        docs.append((d, rng.choice([" ", "\n", " -- ", "_"]).join(w)))
    return docs + [(900, None), (901, "")], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs, items = data(seed)
    got = {tuple(r) for r in L.leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()}
    want = brute(docs, items)
    assert got == want and want


def test_hot_fingerprints_are_salted(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_ROWS", 3)
    docs, items = data(4)
    docs += [(2000 + i, items[3][2] if len(unicode_words(items[3][2])) >= 12 else items[1][2]) for i in range(40)]
    d, i = spark.createDataFrame(docs, D), spark.createDataFrame(items, I)
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == brute(docs, items)


def test_a_million_equal_words_and_many_items(spark):
    rng = random.Random(6)
    items = [(i, "s", " ".join(f"v{rng.randrange(400)}" for _ in range(20))) for i in range(10_000)] + [(20_000, "s", "word " * 1_000_000), (20_001, "s", "word " * 12), (20_002, "s", "word " * 11)]
    docs = [(1, "word " * 1_000_000), (2, "word " * 11 + "x " + items[77][2]), (3, "a " + "word " * 12 + "b"), (4, items[5][2].upper())]
    got = {tuple(r) for r in L.leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()}
    assert got == {(1, 20_000), (1, 20_001), (3, 20_000), (3, 20_001), (2, 77), (4, 5)}


def test_report(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, "x " + " ".join(words) + " y"), (2, " ".join(words[:20])), (3, "nothing")]
    rows = {r["doc_id"]: r for r in L.leak_report(spark.createDataFrame(docs, D), spark.createDataFrame([(7, "s", " ".join(words))], I)).collect()}
    assert set(rows) == {1, 2} and rows[1]["whole"] and rows[1]["share"] == 1 and not rows[2]["whole"] and 0 < rows[2]["share"] < 0.6


def test_case_and_ligatures_and_empty_tables(spark):
    text = "One two three four five six seven eight nine ten profile straße"
    docs = [(1, "x " + text.upper().replace("PROFILE", "PROﬁLE") + " y"), (2, text.replace("ten", "tenth"))]
    d, i = spark.createDataFrame(docs, D), spark.createDataFrame([(7, "s", text)], I)
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == {(1, 7)}
    assert L.leaked_items(d.limit(0), i).count() == 0
    assert L.leaked_items(d, i.limit(0)).count() == 0


def test_every_window_keeps_a_fingerprint():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 300).astype(np.uint64)
    rows = np.sort(rng.integers(0, 6, 300))
    h, r, _ = grams(words, rows, 3)
    kept = set(winnow(h, r, 4))
    for a in range(len(h) - 3):
        if r[a] == r[a + 3]:
            assert kept & set(range(a, a + 4))
