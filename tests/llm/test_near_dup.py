import random
import re

import pytest

from lodestone.llm import near_dup as N

SCHEMA = "chunk_id bigint, content string"


def shingles(text):
    w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", text or "", re.A)]
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset()


def brute(rows, threshold):
    sets = [(i, s) for i, t in dict(rows).items() if (s := shingles(t))]
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if len(a & b) / len(a | b) >= threshold}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [w[at], w[at]]])
    return w


def corpus(seed=1, families=25):
    rng = random.Random(seed)
    licence = [f"lic{i}" for i in range(30)]
    rows, i = [], 0
    for _ in range(families):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 120))]
        for n in range(rng.randrange(1, 6)):
            rows.append((i, " ".join((licence if rng.random() < 0.5 else []) + edited(rng, words, n * 2))))
            i += 1
    return rows


def pairs(spark, rows, threshold=0.6):
    links, members = N.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold)
    return {tuple(r) for r in N.expand_links(links, members).collect()}


def test_pairs_against_brute_force(spark):
    rows = corpus()
    want = brute(rows, 0.6)
    got = pairs(spark, rows)
    assert got <= want and len(want - got) <= 0.01 * len(want)


@pytest.mark.parametrize("limit", [4, 8])
def test_long_lists_are_posted_again_not_cut(spark, monkeypatch, limit):
    """Tiny lists force several rounds; the result stays whole."""
    rows = corpus(2, 12)
    want = pairs(spark, rows)
    monkeypatch.setattr(N, "LIST_LIMIT", limit)
    assert pairs(spark, rows) == want


def test_a_hot_group(spark):
    """A third of all texts share a long passage but are not alike."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(25)]
    rows = [(i, " ".join((shared if i % 3 == 0 else []) + [f"u{rng.randrange(10**6)}" for _ in range(60)])) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1] + " tail")]
    assert pairs(spark, rows) == brute(rows, 0.6)


def test_many_texts_that_are_all_alike(spark, monkeypatch):
    """One family of slightly different texts and one of copies, both longer than a list may be."""
    monkeypatch.setattr(N, "LIST_LIMIT", 8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["odd"] + words[i:])) for i in range(60)] + [(500 + i, "the same text again and again") for i in range(40)]
    assert pairs(spark, rows) == brute(rows, 0.6)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_tiles_make_each_pair_once(spark, block):
    rows = [("g", i) for i in range(17)] + [("h", 1), ("h", 1), (None, 4), (None, 5), ("k", None), ("k", 2), ("l", 8), ("l", 9)]
    got = [tuple(r) for r in N.tiled_pairs(spark.createDataFrame(rows, "g string, i bigint"), ["g"], "i", block).collect()]
    assert len(got) == len(set(got)) and set(got) == {("g", a, b) for a in range(17) for b in range(a + 1, 17)} | {("l", 8, 9)}


def test_copies_and_dirty_rows(spark):
    text = "One two THREE four five six"
    rows = [(1, text), (1, text), (2, text.lower()), (3, "one-two three four five six"), (4, None), (5, ""), (6, "only four words here"), (7, "a b c d e"), (None, text)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS a", "'x' AS text")
    links, members = N.similar_pairs(df, 0.6)
    assert {tuple(r) for r in N.expand_links(links, members).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {r["chunk_id"] for r in members.collect()} == {1, 2, 3, 7}
    groups = {r["chunk_id"]: (r["class_id"], r["n_links"]) for r in N.duplicate_groups(df).collect()}
    assert groups == {1: (1, 0), 2: (1, 0), 3: (1, 0), 7: (7, 0)}
    assert N.duplicate_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.similar_pairs(df, 0.5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (200, 202)]
    got = dict(map(tuple, N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert N.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
