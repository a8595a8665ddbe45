import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import dense, fusion, ranking, sparse

CHUNKS = "chunk_id bigint, file_path string, start_line int, end_line int, language string, content string"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, p, 1, 1, lang, c) for i, (p, lang, c) in enumerate(rows)], CHUNKS)


def auth(spark):
    return chunks(spark, ("src/auth/middleware.go", "go", "func authenticate middleware token"), ("src/ui/button.go", "go", "func render button"), ("src/auth/login.go", "go", "func login user"))


def test_keyword_goldens(spark):
    assert sparse.top_k(sparse.scan_scores(auth(spark), "authenticate middleware"), 3).first()["chunk_id"] == 0


def test_scan_and_index_agree_with_the_formula(spark):
    df = auth(spark).union(chunks(spark, ("a", None, None), ("b", None, "")).withColumn("chunk_id", F.col("chunk_id") + 10))
    tokens = sparse.chunk_tokens(df)
    docs = {r[0]: r[1] for r in tokens.collect()}
    assert len(docs) == 5
    avg = sum(map(len, docs.values())) / 5
    want = {}
    for term in sparse.query_terms("auth login auth func"):
        n = sum(term in t for t in docs.values())
        for i, t in docs.items():
            tf = t.count(term)
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    for scores in (sparse.scan_scores(df, "auth login auth func"), sparse.index_scores(sparse.postings(tokens), sparse.lengths(tokens), "auth login auth func")):
        got = {r[0]: r[1] for r in scores.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_no_terms_and_no_rows(spark):
    assert sparse.scan_scores(auth(spark), "  !!").count() == 0
    assert sparse.scan_scores(auth(spark).limit(0), "auth").count() == 0
    tokens = sparse.chunk_tokens(auth(spark))
    assert sparse.index_scores(sparse.postings(tokens), sparse.lengths(tokens), "").count() == 0


def test_filters_bind_the_result_only(spark):
    full = {r[0]: r[1] for r in sparse.scan_scores(auth(spark), "func").collect()}
    part = {r[0]: r[1] for r in sparse.scan_scores(auth(spark), "func", selected=F.col("chunk_id") == 1).collect()}
    assert part == {1: full[1]}
    assert sparse.scan_scores(auth(spark), "func", selected=F.lit(None).cast("boolean")).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0)], "chunk_id bigint, score double")
    assert [r[0] for r in sparse.top_k(df, 2).collect()] == [2, 1]


def test_quantize_golden(spark):
    row = spark.createDataFrame([([0.5, -0.25, 0.125, 0.0],), ([0.0, 0.0],), ([],)], "v array<float>").select(dense.quantize(F.col("v")).alias("q")).collect()
    assert row[0]["q"]["codes"] == [127, -64, 32, 0]
    assert abs(row[0]["q"]["scale"] - 0.5 / 127) < 1e-8
    assert (row[1]["q"]["codes"], row[1]["q"]["scale"]) == ([0, 0], 1.0)
    assert (row[2]["q"]["codes"], row[2]["q"]["scale"]) == ([], 1.0)


def test_quantisation_error_is_half_a_step(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=8).astype(np.float32)] for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    for r in df.select("v", dense.quantize(F.col("v")).alias("q")).collect():
        assert max(abs(c * r["q"]["scale"] - x) for c, x in zip(r["q"]["codes"], r["v"])) <= r["q"]["scale"] / 2 * 1.001


def test_nearest_limits(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "chunk_id bigint, embedding array<float>")
    assert [r[0] for r in dense.nearest(df, [1.0, 0.0], 9).collect()] == [1, 2]
    with pytest.raises(ValueError):
        dense.nearest(df, [1.0, 0.0], 0)
    q = df.where("size(embedding) = 2").select("chunk_id", dense.quantize(F.col("embedding")).alias("q")).select("chunk_id", "q.*")
    got = dense.nearest_int8(q, [1.0, 0.0], 2).collect()
    assert got[0]["chunk_id"] == 1 and abs(got[0]["distance"]) < 1e-5


def test_windows(spark):
    df = spark.createDataFrame([("x" * 1300,), ("é" * 1301,), ("",), ("ab" * 2000,)], "t string")
    sizes = [[len(w) for w in r[0]] for r in df.select(dense.windows(F.col("t"))).collect()]
    assert sizes == [[1300], [1300, 121], [0], [1300, 1300, 1300, 460]]


def test_pooling_is_a_unit_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    got = {r[0]: r[1] for r in dense.mean_pool(df, ["k"], "v").collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and got[2] == [0.0, 0.0]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "chunk_id bigint, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "chunk_id bigint, score double")
    got = {r[0]: r[1] for r in fusion.fused(fusion.reciprocal_rank(a, 10), fusion.reciprocal_rank(b, 10), 0.3).collect()}
    assert np.allclose([got[1], got[2], got[3]], [0.3 / 61, 0.3 / 62 + 0.7 / 61, 0.7 / 62])


def test_query_classes():
    assert ranking.resolve_alpha("FooBar") == 0.3
    assert ranking.resolve_alpha("find auth") == 0.5
    assert ranking.resolve_alpha("find auth", 0.7) == 0.7
    assert all(map(ranking.is_symbol_query, ["pkg::Type", "a.b", "a->b", "a\\b", "_x", "Foo", "fooBar", "foo_bar"]))
    assert not any(map(ranking.is_symbol_query, ["foo", "two words", "a.", ""]))
    assert ranking.is_location_query("where is the entry point") and ranking.is_entry_point_query("where is the entry point")
    assert ranking.candidate_count("where is it", 3) == 30 and ranking.candidate_count("it", 3) == 15
    assert [ranking.symbol_name(x) for x in ("a::b", "a.b.c", "x->y", "p\\q", " z ")] == ["b", "c", "y", "q", "z"]


def test_tests_rank_below_sources(spark):
    df = spark.createDataFrame([(1, "tests/auth_test.go", "", 1.0), (2, "src/auth.go", "", 1.0)], "chunk_id bigint, file_path string, content string, score double")
    assert [r[0] for r in ranking.saturated(df, 2).collect()] == [2, 1]
    assert [r[0] for r in ranking.saturated(df, 2, penalize=False).collect()] == [1, 2]


def greedy(rows, k):
    """Pick by falling score, halving what a file gave before; stop when no pick can be beaten."""
    seen, out = {}, []
    for i, f, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        out.append((s * 0.5 ** seen.get(f, 0), i))
        seen[f] = seen.get(f, 0) + 1
    return [i for _, i in sorted(out, key=lambda x: (-round(x[0], 9), x[1]))[:k]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 8)), min_size=1, max_size=12), st.integers(1, 6))
def test_saturation_equals_greedy(spark, rows, k):
    data = [(i, f, "", float(s)) for i, (f, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "chunk_id bigint, file_path string, content string, score double")
    assert [r[0] for r in ranking.saturated(df, k, penalize=False).collect()] == greedy([(i, f, s) for i, f, _, s in data], k)


def test_implementation_hints_hold_back_equal_stems(spark):
    df = spark.createDataFrame([(1, "src/router.ts", "", 1.0), (2, "src/session.py", "", 1.0)], "chunk_id bigint, file_path string, content string, score double")
    assert [r["score"] for r in ranking.boost_exact_stems(df, "session router", 1.0).orderBy("chunk_id").collect()] == [1.0, 1.0]
    assert [r["score"] for r in ranking.boost_exact_stems(df, "session cart", 1.0).orderBy("chunk_id").collect()] == [1.0, 1.75]


def test_boosts_without_candidates(spark):
    df = spark.createDataFrame([], "chunk_id bigint, file_path string, content string, score double")
    assert ranking.boosted(df, df.drop("score"), "where is FooBar").count() == 0


def test_special_characters_in_symbols(spark):
    df = spark.createDataFrame([("class operator+ {",), ("class a.b\n",), ("nothing",)], "c string")
    assert [r[0] for r in df.select(ranking.defines(F.col("c"), ["operator+"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(ranking.defines(F.col("c"), ["a.b"])).collect()] == [False, True, False]


# --- goldens of the boosts over ten small chunks ------------------------------------------------------------
FIXTURE = [
    (1, "src/auth/session_manager.go", "go", "package auth\nfunc SessionManager(x int) {\n}\n"),
    (2, "src/auth/login.go", "go", "// uses SessionManager\nfunc login() { SessionManager(1) }\n"),
    (3, "tests/session_manager_test.go", "go", "func TestSessionManager(t *T) {}\n"),
    (4, "lib/SessionManagers.py", "python", "class SessionManager:\n    pass\n"),
    (5, "db/schema.sql", "sql", "create table SessionManager (id int);\n"),
    (6, "bin/start.js", "javascript", "#!/usr/bin/env node\nasync function main() {}\n"),
    (7, "src/installer/hooks.ts", "typescript", "export const hook = () => 1;\n"),
    (8, "package.json", "json", "[package entry] bin: start.js\n"),
    (9, "src/router.ts", "typescript", "export class Router { route() {} }\n"),
    (10, "src/session.py", "python", "def session():\n    return SessionManager()\n"),
]
HELD = {2: 1.0, 3: 0.8, 7: 0.5, 9: 0.9, 10: 0.4}


@pytest.fixture()
def held(spark):
    rows = spark.createDataFrame([(i, p, c) for i, p, _, c in FIXTURE], "chunk_id bigint, file_path string, content string")
    return rows, ranking.with_chunks(spark.createDataFrame(list(HELD.items()), "chunk_id bigint, score double"), rows)


def scores(df):
    return {r["chunk_id"]: round(r["score"], 6) for r in df.collect()}


def test_symbol_definitions_gain_and_enter(held):
    rows, scored = held
    # the type defined in lib/SessionManagers.py enters, the function in the file named after it too; other definitions only gain
    want = HELD | {1: 4.5, 4: 4.5}
    assert scores(ranking.boost_symbol_definitions(scored, rows, "SessionManager", 1.0)) == want
    assert scores(ranking.boost_symbol_definitions(scored, rows.union(rows), "SessionManager", 1.0)) == want


def test_embedded_symbols_gain_half(held):
    rows, scored = held
    assert scores(ranking.boost_embedded_symbols(scored, rows, "who calls SessionManager first", 1.0)) == HELD | {1: 2.25}


def test_exact_stems(held):
    rows, scored = held
    assert scores(ranking.boost_exact_stems(scored, "session login main", 1.0)) == HELD | {2: 1.75, 10: 1.15}
    # a handler is asked for and there: another equal stem does not count
    more = scored.union(scored.limit(1).selectExpr("99L", "'src/handler.go'", "''", "0.1D"))
    assert scores(ranking.boost_exact_stems(more, "login handler", 1.0))[2] == 1.0


def test_locations_and_installer(held):
    rows, scored = held
    assert scores(ranking.boost_locations(scored, rows, "where is the entry point", 1.0)) == HELD | {6: 2.5, 8: 2.5}
    assert scores(ranking.penalize_installer(scored, "where is the entry point")) == HELD | {7: 0.175}
    assert scores(ranking.penalize_installer(scored, "how to install the hook")) == HELD


def test_repeated_chunks_count_once_in_the_index(spark):
    df = auth(spark)
    for table in (sparse.postings, sparse.lengths):
        assert sorted(map(tuple, table(sparse.chunk_tokens(df)).collect())) == sorted(map(tuple, table(sparse.chunk_tokens(df.union(df))).collect()))
    assert max(r["tf"] for r in sparse.postings(sparse.chunk_tokens(df)).collect()) >= 2
    plan = sparse.postings(sparse.chunk_tokens(df))._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in line for line in plan.splitlines() if "Exchange" in line)
