import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.functions.wordpiece import WordPiece, load_tokenizer, wordpiece_count


@pytest.mark.parametrize(
    ("token", "parts"),
    [
        ("foo", ["foo"]),
        ("foo_bar", ["foo_bar", "foo", "bar"]),
        ("FooBar", ["foobar", "foo", "bar"]),
        ("XMLParser", ["xmlparser", "xml", "parser"]),
        ("getHTTPResponse", ["gethttpresponse", "get", "http", "response"]),
        ("_x", ["_x"]),
    ],
)
def test_identifier_parts(spark, token, parts):
    assert text.identifier_parts_of(token) == parts
    assert spark.createDataFrame([(token,)], "t string").select(text.identifier_parts(F.col("t"))).first()[0] == parts


def test_tokens_keep_order_and_take_nulls(spark):
    rows = spark.createDataFrame([("hello FooBar world",), ("",), (None,)], "t string").select(text.tokens(F.col("t")).alias("x")).collect()
    assert [r[0] for r in rows] == [["hello", "foobar", "foo", "bar", "world"], [], []]


def test_lines_are_lossless(spark):
    s = "a\r\nb\rc\n\n\nd"
    lines = spark.createDataFrame([(s,)], "t string").select(text.lines_with_ends(F.col("t"))).first()[0]
    assert "".join(lines) == s
    assert lines == ["a\r\n", "b\r", "c\n", "\n", "\n", "d"]


def test_wordpiece_goldens():
    w = WordPiece(["[UNK]", "hello", "world", "run", "##ing", "##n", "cafe", "中", "文", "!", "the"])
    assert w.encode("Hello world") == ["hello", "world"]
    assert w.encode("runing") == ["run", "##ing"]
    assert w.encode("Café") == ["cafe"]
    assert w.encode("中文") == ["中", "文"]
    assert w.encode("hello!") == ["hello", "!"]
    assert w.encode("the\x00\tunknownword") == ["the", "[UNK]"]
    assert w.encode("a" * 101) == ["[UNK]"]
    assert w.encode(None) == [] and w.count("") == 0


def test_wordpiece_column_and_loader(spark, tmp_path):
    f = tmp_path / "tokenizer.json"
    f.write_text('{"model": {"type": "WordPiece", "vocab": {"[UNK]": 0, "a": 1, "##b": 2}}, "normalizer": {"lowercase": true}}')
    assert load_tokenizer(str(f)).encode("AB ab c") == ["a", "##b", "a", "##b", "[UNK]"]
    f.write_text('{"model": {"type": "BPE", "vocab": {}}}')
    with pytest.raises(ValueError):
        load_tokenizer(str(f))
    rows = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(wordpiece_count(spark, F.col("t"), ["a", "##b"])).collect()] == [2, 0, 0]


@pytest.mark.parametrize(
    ("pattern", "hit", "miss"),
    [
        ("*.go", ["a.go", "x/y/a.go"], ["a.gox", "go"]),
        ("/src/*.py", ["src/a.py"], ["x/src/a.py", "src/b/a.py"]),
        ("src/*.py", ["src/a.py", "x/src/a.py"], ["x/y/src/a.py", "src/b/a.py"]),
        ("**/a.ts", ["b/a.ts", "c/b/a.ts"], ["a.ts", "d/c/b/a.ts"]),
        ("[ab]?.c", ["ax.c", "d/bx.c"], ["cx.c", "a/x.c"]),
    ],
)
def test_globs(spark, pattern, hit, miss):
    rows = spark.createDataFrame([(p,) for p in hit + miss], "p string")
    assert {r[0] for r in rows.where(paths.matches_any_glob(F.col("p"), [pattern])).collect()} == set(hit)
    assert paths.glob_regex("  ") is None


def test_path_parts(spark):
    df = spark.createDataFrame([("src/Foo.Test.PY",), ("Dockerfile",), ("x",), (None,)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.extension(p), paths.stem(p), paths.parent_name(p), paths.language_of(p)).collect()]
    assert got == [(".py", "Foo.Test", "src", "python"), ("", "Dockerfile", "", "dockerfile"), ("", "x", "", None), (None, None, None, None)]
