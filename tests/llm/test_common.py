import os

from lodestone.llm import common


def test_written_tables_are_shared_and_released(spark):
    df = common.written(spark.range(5).selectExpr("id AS a", "CAST(NULL AS string) AS b"), "numbers")
    assert df.columns == ["a", "b"] and df.count() == 5
    path = df.inputFiles()[0]
    assert "numbers-" in path and os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert common.release(spark) >= 1
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_label_key(spark):
    rows = spark.createDataFrame([(" Issue-Thread",), ("ISSUE_THREAD",), ("issue thread ",), (None,)], "s string")
    assert [r[0] for r in rows.select(common.label_key(rows.s)).collect()] == ["issue_thread"] * 3 + [None]
