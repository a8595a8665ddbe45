import numpy as np
import pytest

from lodestone.llm import mixing as M

S, T = "doc_id bigint, source string, source_key string, n_tokens bigint", "source string, target_share double, max_repeats int"


def test_plan():
    uses = M.plan_uses({"a": 1000, "b": 100, "z": 5}, {"a": (0.5, 1), "b": (0.5, 3), "missing": (0.1, 2)})
    assert np.isclose(uses["a"] * 1000, 300) and np.isclose(uses["b"], 3)
    capped = M.plan_uses({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, total_tokens=1000)
    assert np.isclose(capped["b"], 3) and np.isclose(capped["a"] * 1000, 700)
    assert M.plan_uses({}, {"a": (1.0, 1)}) == {} and M.plan_uses({"a": 0}, {"a": (1.0, 1)}) == {}
    full = M.plan_uses({"a": 10}, {"a": (1.0, 2)}, total_tokens=1e9)
    assert np.isclose(full["a"], 2)


def test_pivot_keeps_tokens_and_expectation():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, 40).astype(float)
    p = rng.uniform(0.05, 0.95, 40)
    taken = np.zeros(40)
    for seed in range(400):
        out = M.settle(np.zeros(40, int), np.arange(40), w, p, seed)
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert np.isclose((out * w).sum(), (p * w).sum())
        taken += out
    assert np.abs(taken / 400 - p).max() < 0.12
    two = M.settle(np.arange(40) % 2, np.arange(40), np.where(np.arange(40) < 4, 0, w), p, 1)
    assert (two[:4] == 0).all() and all(((two[s::2] > 0) & (two[s::2] < 1)).sum() <= 1 for s in (0, 1))


@pytest.mark.parametrize("long_first", [True, False])
def test_a_very_long_document_leaves_no_gap(spark, long_first):
    rows = [(i, s, s, 100) for s, at in (("a", 0), ("b", 10_000)) for i in range(at, at + 3000)] + [(99_000, "a", "a", 10_000), (99_001, "b", "b", 10_000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], T)
    taken = []
    for seed in range(6):
        df = spark.createDataFrame(rows[::-1] if long_first else rows, S)
        mixed, shares = M.mix_sources(df, targets, total_tokens=200_000, seed=seed)
        for r in shares.collect():
            assert abs(r["used_tokens"] - 100_000) <= 0.01 * 100_000
        taken += [r["doc_id"] for r in mixed.where("n_tokens > 100").collect()]
    assert 0 < len(taken) < 12


def sizes(spark, rows, parts=7):
    return spark.createDataFrame(rows, S).repartition(parts)


@pytest.mark.parametrize(("fan", "group"), [(2, 20), (64, 100_000)])
def test_shares_and_caps(spark, monkeypatch, fan, group):
    monkeypatch.setattr(M, "FAN_IN", fan)
    monkeypatch.setattr(M, "GROUP_ROWS", group)
    rng = np.random.default_rng(2)
    rows = [(i, "big", "big", int(rng.integers(1, 60))) for i in range(600)] + [(1000 + i, " Small", "small", int(rng.integers(1, 60))) for i in range(20)] + [(2000 + i, "other", "other", 10) for i in range(20)] + [(3000, None, None, 5), (3001, "big", "big", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("SMALL", 0.1, None), ("none", 0.1, 2)], T)
    mixed, shares = M.mix_sources(sizes(spark, rows, 13), targets)
    got = mixed.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert {r["source_key"] for r in got} == {"big", "small"}
    by = {r["source_key"]: r for r in shares.collect()}
    assert set(by) == {"big", "small", "none"} and by["none"]["share"] == 0
    assert by["small"]["max_repeats"] == 1 and by["small"]["most_uses"] <= 1
    assert abs(by["big"]["used_tokens"] - by["big"]["expected_uses"] * by["big"]["available_tokens"]) < 60
    assert abs(by["big"]["share"] - 0.6) < 0.06 and abs(by["small"]["share"] - 0.4) < 0.06
    again = {tuple(r) for r in M.mix_sources(sizes(spark, rows, 13), targets)[0].select("doc_id").collect()}
    assert len(again) > 0


def test_repeats(spark):
    rows = [(i, "a", "a", 10) for i in range(40)] + [(100 + i, "b", "b", 10) for i in range(4)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], T)
    mixed, shares = M.mix_sources(sizes(spark, rows), targets)
    uses = {r["doc_id"]: r["uses"] for r in mixed.collect()}
    assert all(uses[100 + i] == 3 for i in range(4)) and sum(v for k, v in uses.items() if k < 100) == 12


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], T)
    none = spark.createDataFrame([], S)
    for a, b in ((none, targets), (none, targets.limit(0)), (sizes(spark, [(1, "a", "a", 3)]), targets.limit(0))):
        mixed, shares = M.mix_sources(a, b)
        assert mixed.count() == 0 and shares.where("share > 0").count() == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "Code-File", "hello world"), (2, None, None), (3, " x ", "")], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: (r["source_key"], r["n_tokens"]) for r in M.tokenizer_sizes(docs).collect()}
    assert got == {1: ("code_file", 2), 2: (None, 0), 3: ("x", 0)}
