from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces as P


def check(text, limit=60, overlap=10):
    found, data, inside = P.cut(text, limit, overlap)
    lines = [m[0] for m in P._LINE.finditer(data)]
    assert inside == (len(data) > limit and any(len(x) > limit for x in lines))
    assert b"".join(data[b:e] for _, b, e in found) == data
    ends, at = set(), 0
    for line in lines:
        at += len(line)
        ends.add(at)
    for back, begin, end in found:
        assert 0 < end - back <= limit and 0 <= begin - back <= overlap
        data[back:end].decode()
        assert inside or end in ends
    return found, data


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "漢", "😀", " ", "\n", "\r\n", "\r", "word " * 3, "x" * 50, "y" * 200]), max_size=60))
def test_limits_round_trip_and_line_ends(parts):
    check("".join(parts))


def test_least_count_and_balance():
    text = "".join(f"line {i:03d}\n" for i in range(60))  # 540 bytes
    found, data = check(text, 200, 20)
    assert len(found) == 3
    sizes = [e - b for _, b, e in found]
    assert max(sizes) - min(sizes) <= 54


def test_units_are_preferred():
    body = "".join("    x = 1\n" for _ in range(8))
    text = f"def a():\n{body}\ndef b():\n{body}\ndef c():\n{body}"
    found, data = check(text, 100, 0)
    assert [data[b:e].lstrip()[:5] for _, b, e in found] == [b"def a", b"def b", b"def c"]


def test_operator(spark):
    long = "é" * 700 + "\n" + "z" * 800 + "\n"
    rows = [(1, 10, long, "p"), (1, 10, long, "p"), (2, 1, None, "p"), (3, 1, "", "p"), (4, None, "q\n" * 1000, "p"), (5, 5, "w" * 4000, "p"), (6, 1, "x" * 1500, "p")]
    df = spark.createDataFrame(rows, "chunk_id bigint, start_line int, content string, piece_no string")
    got = P.split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in got} == {1, 4, 5}
    one = [r for r in got if r["chunk_id"] == 1]
    assert [(r["piece_no"], r["start_line"], r["end_line"]) for r in one] == [(0, 10, 10), (1, 10, 11)] or [(r["start_line"], r["end_line"]) for r in one] == [(10, 10), (11, 11)]
    assert all(len(r["content"].encode()) <= 1500 for r in got)
    assert all(r["start_line"] is None for r in got if r["chunk_id"] == 4)
    assert {r["cut_kind"] for r in got if r["chunk_id"] == 5} == {"inside"}
    assert {tuple(r) for r in P.cut_kinds(df).collect()} == {(1, "line"), (4, "line"), (5, "inside")}
    assert P.split_oversized(df.limit(0)).count() == 0
