import os

import pytest

from lodestone.plans import queries as core

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.assert_equal(spark, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


BOOSTS = ("symbol_definition_boost", "embedded_symbol_boost", "exact_stem_boost")


@pytest.mark.parametrize("name", BOOSTS)
def test_boosts_read_the_tables(spark, name):
    plain = {r["chunk_id"]: r["score"] for r in core.rounded(core._candidates(spark, oracle.DATA), "score").collect()}
    boosted = {r["chunk_id"]: r["score"] for r in core.queries()[name](spark, oracle.DATA).collect()}
    assert set(plain) <= set(boosted) and any(boosted[i] > plain[i] for i in plain)


def test_filtered_search_finds_a_definition(spark):
    rows = core.queries()["hybrid_filtered_defined"](spark, oracle.DATA).select("chunk_id")
    chunks = core.corpus(spark, oracle.DATA)
    symbol = core._defined(chunks.where(core.navigate.selection(["typescript"])))
    assert rows.join(chunks, "chunk_id").where(core.ranking.defines(core.F.col("content"), [symbol])).count() > 0


@pytest.mark.parametrize("size", [2, 4096])
def test_every_fiftieth_row_is_a_query(spark, monkeypatch, size):
    monkeypatch.setattr(core.dense, "QUERY_BLOCK", size)
    want = {r[0] for r in core.int8_vectors(spark, oracle.DATA).where("chunk_id % 50 = 0").select("chunk_id").collect()}
    rows = core.queries()["knn_int8_every50"](spark, oracle.DATA).collect()
    assert len(want) > 2 and {r["query_id"] for r in rows} == want and len(rows) == 10 * len(want)
    first = core.int8_vectors(spark, oracle.DATA).orderBy("chunk_id").first()["chunk_id"]
    if first in want:
        single = {(r["chunk_id"], r["distance"]) for r in core.knn_int8(spark, oracle.DATA).collect()}
        assert {(r["chunk_id"], r["distance"]) for r in rows if r["query_id"] == first} == single
