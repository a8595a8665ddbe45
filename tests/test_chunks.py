import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import chunking, locate, navigate, snippet


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [("a\nb\n", 1500, ["a\nb\n"]), ("hello", 1500, ["hello"]), ("line1\nline2\nline3\n", 20, ["line1\nline2\nline3\n"]), ("line1\nline2\nline3\n", 12, ["line1\nline2\n", "line3\n"]), ("x" * 30 + "\ny\n", 10, ["x" * 30 + "\n", "y\n"])],
)
def test_line_chunks(text, size, want):
    data = text.encode()
    assert [data[a:b].decode() for a, b in chunking.line_chunks(data, size)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é\r\n"), max_size=200), st.integers(1, 40))
def test_line_chunks_reassemble(text, size):
    data = text.encode()
    spans = chunking.line_chunks(data, size)
    assert b"".join(data[a:b] for a, b in spans) == data


PYTHON = "import os\n\n@deco\ndef first():\n    return 1\n\nclass Box:\n    size = 1\n\n    def one(self):\n        pass\n\n    def two(self):\n        pass\n\ndef last():\n    pass\n"


def test_python_units():
    data = PYTHON.encode()
    units = [data[a:b].decode() for a, b in chunking.python_units(data)]
    assert units[0] == "import os\n\n@deco\n"
    assert any(u.startswith("@deco\ndef first") for u in units)
    assert any(u.startswith("class Box") and "one" in u and "two" not in u for u in units)
    assert any(u.startswith("    def two") for u in units)
    assert any(u.startswith("def last") for u in units)


def test_brace_units():
    go = b"package x\n\nfunc a() {\n\tif y {\n\t}\n}\n\ntype T struct {\n}; \nfunc b() {}\n"
    units = [go[a:b] for a, b in chunking.brace_units(go, "go")]
    assert units == [b"package x\n\n", b"func a() {\n\tif y {\n\t}\n}\n", b"type T struct {\n}; \n", b"func b() {}\n"]
    assert chunking.structural_chunks(b"x", "rust") is None
    assert chunking.structural_chunks(b"no units here", "go") is None


def test_tree_chunks_cover_the_file():
    data = (PYTHON * 20).encode()
    spans = chunking.python_tree_chunks(data, 300)
    assert b"".join(data[a:b] for a, b in spans) == data
    assert chunking.python_tree_chunks(b"def broken(:") is None


def test_chunk_files_handles_dirty_rows(spark):
    rows = [("a.py", "python", PYTHON), ("b.txt", None, "x\ny"), ("c", None, None), ("d", None, ""), ("e", None, " \n\t\n"), ("f", "go", "日本\r\nx\r"), ("a.py", "python", PYTHON)]
    df = spark.createDataFrame(rows, "file_path string, language string, text string").withColumnRenamed("text", "text")
    for how in ("cascade", "lines", "tree"):
        got = chunking.chunk_files(df, how=how).collect()
        assert {r["file_path"] for r in got} == {"a.py", "b.txt", "f"}
        assert all(1 <= r["start_line"] <= r["end_line"] for r in got)
    b = [r for r in chunking.chunk_files(df).collect() if r["file_path"] == "b.txt"]
    assert [(r["start_line"], r["end_line"]) for r in b] == [(1, 2)]
    assert chunking.chunk_files(df.limit(0)).count() == 0


SOURCES = [(1, "src/config.ts", 10, 12, "typescript", "const a = 1\nREDIS_HOST = x\nend"), (2, "a.go", 1, 2, "go", "foo\nbar foo"), (3, "b.go", 5, 5, "go", "HelloWorld"), (4, "a.go", 2, 3, "go", "bar foo\nbaz"), (5, "n.go", 1, 1, None, None), (6, None, 1, 1, None, "foo")]


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame(SOURCES, "chunk_id bigint, file_path string, start_line int, end_line int, language string, content string")


def lines(df):
    return {(r["file_path"], r["line"]) for r in df.collect()}


def test_locate(chunks):
    assert lines(locate.locate(chunks, "REDIS_HOST")) == {("src/config.ts", 11)}
    assert lines(locate.locate(chunks, ["foo"])) == {("a.go", 1), ("a.go", 2)}
    assert lines(locate.locate(chunks, "helloworld")) == set()
    assert lines(locate.locate(chunks, "helloworld", ignore_case=True)) == {("b.go", 5)}
    assert lines(locate.locate(chunks, "hello_world", variants=True)) == {("b.go", 5)}
    assert lines(locate.locate(chunks, ["foo", "REDIS"], exclude=["*.go"])) == {("src/config.ts", 11)}
    assert lines(locate.locate(chunks, ["foo", "REDIS"], include=["/a.go"])) == {("a.go", 1), ("a.go", 2)}
    assert lines(locate.locate(chunks, [])) == set() == lines(locate.locate(chunks, ""))


def test_locate_context_and_modes(chunks):
    hits = locate.locate(chunks, "REDIS_HOST", context=1).first()
    assert (hits["context"], hits["context_start_line"]) == (["const a = 1", "REDIS_HOST = x", "end"], 10)
    found = locate.locate(chunks, "foo")
    assert tuple(locate.summary(found, 1).first()) == (2, 1, True)
    assert locate.shown(found, "lines", 0).count() == 1
    assert locate.shown(found, "count").count() == 0
    assert locate.compact(found).orderBy("hit").first()[0] == '{"f":"a.go","l":1,"t":"foo"}'


def test_variants():
    assert locate.needles_of("tensorQueue", True) == ["tensorQueue", "TensorQueue", "tensor_queue", "tensor-queue", "TENSOR_QUEUE"]
    assert locate.identifier_words("parseHTTPHeader2Go") == ["parse", "HTTP", "Header2", "Go"]
    assert locate.needles_of(["", "x", "x"]) == ["x"]


def test_resolve_prefers_the_chunk_that_goes_on(chunks):
    assert navigate.resolve(chunks, "a.go", 2).first()["chunk_id"] == 4
    assert navigate.resolve(chunks, "a.go", 9).count() == 0
    asked = chunks.sparkSession.createDataFrame([("a.go", 2), ("a.go", 2), ("b.go", 5), ("x", 1), (None, 1)], "file_path string, line int")
    got = {(r["file_path"], r["line"]): r["chunk_id"] for r in navigate.resolve_many(chunks, asked).collect()}
    assert got == {("a.go", 2): 4, ("b.go", 5): 3, ("x", 1): None, (None, 1): None}


def test_expand(chunks):
    got = navigate.expand(chunks, "a.go", 2).collect()
    assert [(r["chunk_id"], r["is_anchor"]) for r in got] == [(2, False), (4, True)]
    assert navigate.expand(chunks, "zzz", 1).count() == 0


def test_selection(chunks):
    assert navigate.selection() is None
    assert {r[0] for r in chunks.where(navigate.selection(["go"], ["a.go"])).select("chunk_id").collect()} == {2, 4}
    assert chunks.where(navigate.selection(["none"])).count() == 0
    assert {r[0] for r in chunks.where(navigate.selection(paths=["src/"])).select("chunk_id").collect()} == {1}


def test_snippets(spark, chunks):
    text = "\n".join(f"line {i}" for i in range(40)).replace("line 20", "the scheduler queue")
    df = spark.createDataFrame([(1, "f", 100, 139, None, text), (2, "g", 1, 1, None, "short"), (3, "h", 1, 1, None, None)], chunks.schema)
    got = {r["chunk_id"]: r for r in snippet.snippets(df, "where is the scheduler queue", 3).collect()}
    assert (got[1]["anchor_line"], got[1]["truncated"], got[1]["start_line"], got[1]["end_line"]) == (120, True, 117, 123)
    assert got[1]["full_end_line"] == 139 and got[1]["content"].count("\n") == 6
    assert not got[2]["truncated"] and got[2]["content"] == "short"
    assert not got[3]["truncated"] and got[3]["content"] is None


def test_nested_trees(monkeypatch):
    go = b'package main\n\nimport "fmt"\n\nfunc hello() {\n\tfmt.Println("hi")\n}\n\nfunc world() {\n\tfmt.Println("world")\n}\n'
    assert chunking.chunk_spans(go, "go", 1500, trees=True) == [(0, len(go))]
    spans = chunking.chunk_spans(go, "go", 60, trees=True)
    assert spans[0][0] == 0 and spans[-1][1] == len(go) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert go.index(b"func world") in [a for a, _ in spans]
    deep = b"".join(b" " * i + b"if (x) {\n" for i in range(2000)) + b"}\n" * 2000
    spans = chunking.nested_tree_chunks(deep, 300)
    assert spans[0][0] == 0 and spans[-1][1] == len(deep)
    assert chunking.nested_tree_chunks(b"") is None
    monkeypatch.setenv("LODESTONE_TREE_CHUNKING", "0")
    assert chunking.chunk_spans(go, "go", 60, trees=True) == chunking.chunk_spans(go, "go", 60)


def test_units_take_linear_time():
    import time

    began = time.time()
    chunking.python_units(b"".join(b" " * (i % 300) + (b"class A:\n" if i % 2 else b"def f():\n") for i in range(40_000)))
    chunking.brace_units(b"func a() {\n" * 40_000 + b"}\n" * 40_000, "go")
    assert time.time() - began < 20
