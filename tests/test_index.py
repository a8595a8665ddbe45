import io
import json
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import incremental, sparse
from lodestone.operators.chunking import chunk_files
from lodestone.plans import render, server
from lodestone.plans.index import Index, tool_top_k
from lodestone.sources import bundle, scan, settings
from lodestone.sources.embedders import EndpointEmbedder, FunctionEmbedder, HashEmbedder, HttpEmbedder, TooLarge, chosen_embedder, clean_input, embed_chunks, parse_embedding
from lodestone.streaming import refresh

FILES = {
    "sample.go": "package main\n\nfunc Login(user string) bool {\n\treturn user != \"\"\n}\n",
    "src/auth/session_store.py": "class SessionStore:\n    def open(self):\n        return 1\n",
    "node_modules/x/index.js": "function hidden() {}\n",
    "README.md": "# readme about login\n",
    "blank.py": "  \n\n",
    "big.py": "x = 1\n" * 200_000,
    "conf/app.yaml": "login: true\n",
}


@pytest.fixture()
def folder(tmp_path):
    for path, text in FILES.items():
        f = tmp_path / "repo" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path / "repo")


def test_scan(spark, folder):
    rows = {r["file_path"]: r for r in scan.read_folder(spark, folder).collect()}
    assert set(rows) == {"sample.go", "src/auth/session_store.py", "conf/app.yaml"}
    assert rows["sample.go"]["language"] == "go" and rows["sample.go"]["text"] == FILES["sample.go"]
    assert {r[0] for r in scan.read_folder(spark, folder, ("docs",)).select("file_path").collect()} == {"README.md"}
    with pytest.raises(FileNotFoundError):
        scan.read_folder(spark, folder + "/none")


def test_sources():
    assert [scan.is_remote(s) for s in ("https://x/y", "git@host:a/b", "git@host:/a", "/local", "file:///x")] == [True, True, False, False, True]
    assert scan.may_read("https://x/y") and not scan.may_read("ssh://x/y") and not scan.may_read("http://x/y")
    assert scan.in_workspace("/a/b", None) and not scan.in_workspace("/etc", "/root") and scan.in_workspace("/root/x", "/root")
    assert scan.resolve_content() == ("code", "config")
    assert scan.resolve_content(["all"]) == ("code", "docs", "config")
    assert scan.resolve_content(["docs", "bogus"]) == ("docs",)
    assert scan.source_key("https://x", "v1") != scan.source_key("https://x")
    with pytest.raises(PermissionError):
        scan.clone("ssh://nowhere/x")


def test_end_to_end(spark, folder):
    index = Index.from_path(spark, folder, embedder=FunctionEmbedder(lambda texts: [[1.0, 0.0, 0.0] for _ in texts], 3))
    hits = index.search("login user", 5, languages=["go"], paths=["sample.go"], rerank=False).collect()
    assert [h["file_path"] for h in hits] == ["sample.go"]
    assert index.search("   ").count() == 0
    top = index.search("SessionStore").first()
    assert top["file_path"] == "src/auth/session_store.py"
    assert all(r["language"] == "go" for r in index.search("SessionStore", languages=["go"]).collect())
    assert index.search("login", languages=["cobol"]).count() == 0
    assert [r["file_path"] for r in index.find_related("sample.go", 3).collect()] == []
    assert index.expand("sample.go", 3).count() == 1
    shown = render.search_payload("login", index.snippets(index.search("login"), "login"))
    assert shown["results"][0]["score"] == "100%" and shown["results"][0]["chunk"]["location"].startswith(("sample.go:", "conf/app.yaml:"))
    located = render.locate_payload("func", index.locate("func"), "lines", 5)
    assert located["n"] == 1 and located["hits"][0]["l"] == 3
    assert render.locate_text(located).startswith("1 lines in 1 files")


def test_repeated_searches_agree(spark, folder):
    index = Index.from_path(spark, folder)
    a, b = ([tuple(r) for r in index.search("session open login").collect()] for _ in range(2))
    assert a == b and a
    stored = index.cached()
    assert [tuple(r) for r in stored.search("session open login").collect()] == a
    index.close()


def test_bundle(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setenv("LODESTONE_CACHE", str(tmp_path / "cache"))
    built = Index.from_source(spark, folder)
    assert not built.from_disk
    built.save_to_cache(folder)
    again = Index.from_source(spark, folder)
    assert again.from_disk
    want, got = ([tuple(r) for r in i.search("session login").collect()] for i in (built, again))
    assert got == want
    path = bundle.bundle_path(folder)
    assert bundle.missing_parts(spark, path) == []
    # an edit makes the bundle stale
    time.sleep(0.01)
    with open(os.path.join(folder, "sample.go"), "a") as f:
        f.write("// more\n")
    assert not Index.from_source(spark, folder).from_disk
    bundle.clear(spark, folder)
    assert "metadata" in bundle.missing_parts(spark, path)


def test_bundle_reasons():
    good = {"index_epoch": bundle.cache_epoch(), "embedding_model": "m", "embedding_dimensions": 4, "vector_storage": "int8", "content_type": ["code"]}
    assert bundle.invalid_because(good, "m", 4, "int8", ["code"]) == []
    assert bundle.invalid_because({}, "m", 4, "int8", ["code"]) == ["index_epoch", "embedding_model", "embedding_dimensions", "vector_storage", "content_type"]


def test_vector_files(spark, tmp_path):
    q = spark.createDataFrame([(0, [1, -2], 0.5), (1, [3, 4], 0.25)], "chunk_id bigint, codes array<tinyint>, scale float")
    bundle.write_vector_files(q, str(tmp_path / "q"))
    assert bundle.read_vector_files(spark, str(tmp_path / "q")).orderBy("chunk_id").collect() == q.collect()
    v = spark.createDataFrame([(0, [0.5, 0.25])], "chunk_id bigint, embedding array<float>")
    bundle.write_vector_files(v, str(tmp_path / "v"))
    assert bundle.read_vector_files(spark, str(tmp_path / "v")).collect() == v.collect()
    with pytest.raises(ValueError):
        bundle.write_vector_files(q, str(tmp_path / "x"), most_rows=1)
    t = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "chunk_id bigint, tokens array<string>")
    bundle.write_postings_json(t, str(tmp_path / "t"))
    assert sorted(bundle.read_postings_json(spark, str(tmp_path / "t")).collect()) == sorted(t.collect())


def test_session_cache_drops_the_oldest_and_keeps_no_failures():
    class Fake:
        closed = False

        def close(self):
            self.closed = True

    cache, made = bundle.SessionCache(2), []
    for name in "abc":
        made.append(cache.get(name, Fake))
    assert made[0].closed and not made[1].closed
    assert cache.get("b", Fake) is made[1]
    with pytest.raises(ZeroDivisionError):
        cache.get("bad", lambda: 1 / 0)
    assert isinstance(cache.get("bad", Fake), Fake)


COLUMNS = "chunk_id bigint, file_path string, start_line int, end_line int, language string, content string"


def test_next_ids_are_dense(spark):
    rows = spark.range(100).select(F.format_string("f%03d", F.col("id")).alias("file_path"))
    got = incremental.next_ids(rows.repartition(5), ["file_path"], 6).orderBy("file_path").collect()
    assert [r["chunk_id"] for r in got] == list(range(7, 107))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_hold_for_many_wide_rows(spark, adaptive):
    n = 200_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(n).select(F.format_string("d%03d/f%06d", F.col("id") % 97, F.col("id") % 60_000).alias("file_path"), F.col("id").cast("int").alias("start_line"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("content"))
        got = incremental.next_ids(rows, ["file_path", "start_line"], -1)
        # the numbers are the same in every later plan over them
        pair = got.select("chunk_id", "content").join(got.select("chunk_id", F.col("content").alias("again")), "chunk_id")
        line = pair.agg(F.count(F.lit(1)), F.count_distinct("chunk_id"), F.min("chunk_id"), F.max("chunk_id"), F.count_if(F.col("content") != F.col("again"))).first()
        assert tuple(line) == (n, n, 0, n - 1, 0)
        w = Window.orderBy("chunk_id")
        steps = got.select((F.struct("file_path", "start_line") > F.lag(F.struct("file_path", "start_line")).over(w)).alias("up"))
        assert steps.where("not up").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ids_agree_across_the_tables_of_a_refresh(spark):
    n = 30_000
    files = spark.range(n).select(F.format_string("src/f%05d.py", "id").alias("file_path"), F.lit("python").alias("language"), F.lit(900).cast("bigint").alias("size_bytes"), F.col("id").alias("mtime_ms"), F.concat(F.lit("def f"), "id", F.lit("():\n    return "), F.repeat(F.concat(F.lit("word"), "id", F.lit(" + ")), 30), F.lit("1\n")).alias("text"))
    index = Index.from_chunks(incremental.next_ids(chunk_files(files), ["file_path", "pos"], -1), HashEmbedder(8), files=files)
    changed = files.where("mtime_ms % 3 = 0").select("file_path")
    later = files.withColumn("text", F.concat(F.col("text"), F.lit("# later\n")))
    fresh = index.apply_changes(changed, later)
    for t in ("chunks", "lengths", "vectors"):
        assert tuple(getattr(fresh, t).agg(F.count(F.lit(1)), F.count_distinct("chunk_id")).first()) == (n, n), t
    held = sparse.postings(sparse.chunk_tokens(fresh.chunks))
    assert held.exceptAll(fresh.postings).count() == 0 and fresh.postings.exceptAll(held).count() == 0


def test_apply_changes(spark):
    old = spark.createDataFrame([(0, "a", 1, 1, None, "x"), (1, "b", 1, 1, None, "y"), (2, "b", 2, 2, None, "z")], COLUMNS)
    new = spark.createDataFrame([(0, "b", 1, 1, None, "new"), (0, "c", 1, 1, None, "c")], COLUMNS)
    changed = spark.createDataFrame([("b",), ("c",), ("gone",), ("b",)], "file_path string")
    got = incremental.apply_changes(old, changed, new).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["file_path"], r["content"]) for r in got] == [(0, "a", "x"), (3, "b", "new"), (4, "c", "c")]
    assert incremental.apply_changes(old, changed.limit(0), new.limit(0)).count() == 3
    assert incremental.apply_changes(old.limit(0), changed, new).count() == 2


def test_index_refresh_equals_rebuild(spark, folder):
    index = Index.from_path(spark, folder)
    files = scan.read_folder(spark, folder)
    changed = spark.createDataFrame([("sample.go",), ("conf/app.yaml",)], "file_path string")
    later = files.where("file_path <> 'conf/app.yaml'").withColumn("text", F.when(F.col("file_path") == "sample.go", F.lit("package main\nfunc Other() {}\n")).otherwise(F.col("text")))
    fresh = index.apply_changes(changed, later)
    assert {r[0] for r in fresh.chunks.select("file_path").distinct().collect()} == {"sample.go", "src/auth/session_store.py"}
    rebuilt = Index.from_chunks(fresh.chunks)
    for t in ("postings", "lengths", "vectors"):
        assert sorted(map(tuple, getattr(fresh, t).collect())) == sorted(map(tuple, getattr(rebuilt, t).collect()))


def test_stream_equals_batch(spark, tmp_path):
    events = str(tmp_path / "events")
    state = {"chunks": spark.createDataFrame([], COLUMNS)}
    versions = [
        [("a.py", "python", 1, 1, "def a():\n    pass\n", False), ("b.txt", None, 1, 1, "old\n", False)],
        [("b.txt", None, 1, 2, "new\n", False), ("b.txt", None, 1, 1, "older\n", False), ("c.txt", None, 1, 2, "c\n", None)],
        [("a.py", "python", 0, 3, None, True)],
    ]
    for i, rows in enumerate(versions):
        spark.createDataFrame(rows, refresh.FILE_SCHEMA).coalesce(1).write.parquet(f"{events}/v{i}")
        time.sleep(0.02)

    def write(chunks, batch):
        chunks.write.mode("overwrite").parquet(str(tmp_path / f"state{batch}"))
        state["chunks"] = spark.read.parquet(str(tmp_path / f"state{batch}"))

    stream = spark.readStream.schema(refresh.FILE_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(events)
    refresh.refresh(stream, str(tmp_path / "checkpoint"), lambda: state["chunks"], write).awaitTermination(120)
    assert {(r["file_path"], r["content"]) for r in state["chunks"].collect()} == {("b.txt", "new\n"), ("c.txt", "c\n")}


def test_embedders(spark):
    h = HashEmbedder(16)
    assert h.embed_query("a b") == h.embed_query("a b") and len(h.embed_query("")) == 16
    df = spark.createDataFrame([(1, "x " * 1000), (2, None), (3, "")], "chunk_id bigint, content string")
    got = {r[0]: r[1] for r in embed_chunks(df, h).collect()}
    assert set(got) == {1, 3} and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert parse_embedding({"dtype": "i8", "values": [1, 3], "scale": 0.5, "zero_point": 1}) == [0.0, 1.0]
    assert clean_input("a\\b", "strip") == "a/b" and clean_input("a\\", "quad") == "a" + "\\" * 4 and clean_input("\ud800x") == "�x"


def test_http_embedder():
    import http.server
    import threading

    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(len(body["input"]))
            code = 503 if len(calls) == 1 else 413 if len(body["input"]) > 2 or any(len(t) > 10 for t in body["input"]) else 200
            data = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}).encode() if code == 200 else b""
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{s.server_port}/", "m", 2)
    assert e.embed(["a", "bb", "ccc", "d"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [1.0, 1.0]]
    assert abs(sum(x * x for x in e.embed(["x" * 16])[0]) - 1) < 1e-9
    s.shutdown()


def test_server(spark, folder):
    requests = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "locate", "arguments": {"literal": "func", "repo": folder}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "SessionStore", "repo": folder, "top_k": "2"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "expand", "arguments": {"repo": "ssh://no", "file_path": "x", "line": 1}}},
        {"id": 6, "method": "nope"},
        {"id": 7, "method": "tools/call", "params": {"name": "nope"}},
        {"id": 8, "method": "tools/call", "params": {"name": "find_related", "arguments": {"repo": folder, "file_path": "sample.go", "line": 3}}},
        {"id": 9, "method": "ping"},
    ]
    out = io.StringIO()
    server.serve(spark, io.StringIO("not json\n" + "\n".join(map(json.dumps, requests))), out)
    got = {a.get("id"): a for a in map(json.loads, out.getvalue().splitlines())}
    assert got[None]["error"]["code"] == -32700
    assert got[1]["result"]["protocolVersion"] == "2024-11-05"
    assert {t["name"] for t in got[2]["result"]["tools"]} == {"search", "locate", "expand", "find_related"}
    assert "sample.go:3" in got[3]["result"]["content"][0]["text"]
    assert got[4]["result"]["content"][0]["text"].startswith("src/auth/session_store.py:")
    assert got[5]["result"]["isError"]
    assert (got[6]["error"]["code"], got[7]["error"]["code"]) == (-32601, -32602)
    assert not got[8]["result"]["isError"] and got[9]["result"] == {}
    assert [tool_top_k(k) for k in (None, 0, 4, 99)] == [3, 3, 4, 10]
    assert server.texts_of({"x": ["a", 1]}, "x") == ["a"] and server.int_of({"x": "z"}, "x") is None and server.flag_of({}, "x", True)


def test_command_line(spark, folder, capsys, monkeypatch):
    from lodestone.plans import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["locate", folder, "func", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["n"] == 1
    assert cli.main(["search", folder, "SessionStore", "--top-k", "1"]) == 0
    assert "session_store.py" in capsys.readouterr().out
    assert cli.main(["expand", folder, "sample.go", "3"]) == 0
    assert cli.main(["find-related", folder, "sample.go", "3", "--json"]) == 0
    assert cli.main(["clear", folder]) == 0


def test_skipped_files_are_not_opened(spark, folder):
    plan = scan.read_folder(spark, folder)
    rows = {r["file_path"] for r in plan.select("file_path", "text").collect()}
    assert "node_modules/x/index.js" not in rows and "sample.go" in rows
    node = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    node.execute().count()
    assert node.metrics().apply("numFiles").value() == sum(p.endswith((".go", ".py", ".yaml")) for p in FILES)


def test_stream_filters_and_deletes(spark):
    rows = [("a.py", "python", 5, None, "x", False), ("a.py", "python", 5, 3, "y", False), ("b.py", None, 1, 2, "x", False), ("b.py", None, 1, 2, None, True)]
    got = {r["file_path"]: (r["text"], r["deleted"]) for r in refresh.latest_versions(spark.createDataFrame(rows, refresh.FILE_SCHEMA)).collect()}
    assert got == {"a.py": ("y", False), "b.py": (None, True)}


def test_single_flight():
    import threading

    cache, built = bundle.SessionCache(2), []

    class Fake:
        def close(self):
            pass

    def build():
        built.append(1)
        time.sleep(0.2)
        return Fake()

    threads = [threading.Thread(target=lambda: cache.get("one", build)) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(built) == 1


def test_settings(monkeypatch):
    monkeypatch.setenv("LODESTONE_EMBEDDING_BATCH", "0")
    assert settings.embedding_batch() == settings.DEFAULT_BATCH
    monkeypatch.setenv("LODESTONE_EMBEDDING_BATCH", "7")
    monkeypatch.setenv("LODESTONE_EMBEDDING_DIMENSIONS", "x")
    assert settings.embedding_batch() == 7 and settings.embedding_dimensions() is None
    assert [settings.usable_key(k) for k in ("k1", "", None, " ", "$KEY", "${KEY}")] == [True] + [False] * 5
    assert settings.is_newer("v1.10.0", "1.9.9") and not settings.is_newer("1.0", "0.1.0") and not settings.is_newer("1.2.3-rc1", "1.2.3")
    assert isinstance(chosen_embedder(), HashEmbedder)
    monkeypatch.setenv("LODESTONE_EMBEDDING_URL", "http://host/v1/")
    got = chosen_embedder(model="m", dimensions=3)
    assert (type(got), got.base_url, got.name, got.dimensions, got.batch) == (HttpEmbedder, "http://host/v1", "m", 3, 7)


@pytest.mark.parametrize("shape", [lambda e: e, lambda e: {"embeddings": e}, lambda e: {"data": [{"embedding": x} for x in e]}])
def test_endpoint_answers(shape):
    bodies = []

    def invoke(body):
        bodies.append(body)
        if sum(map(len, body["inputs"])) > 6:
            raise TooLarge
        return shape([[float(len(t)), 1.0] for t in body["inputs"]])

    e = EndpointEmbedder(invoke, "e", 2, prompt_name="query")
    assert e.embed(["ab", "abc"]) == [[2.0, 1.0], [3.0, 1.0]] and e.name == "endpoint:e"
    assert bodies[0]["prompt_name"] == "query" and bodies[0]["dimensions"] == 2
    long = e.embed(["abcdef", "x", "abcdefgh"])
    assert len(long) == 3 and abs(sum(v * v for v in long[2]) - 1) < 1e-9 and e.stats["too_large"] >= 2
    with pytest.raises(ValueError):
        EndpointEmbedder(lambda body: {"x": 1}, "e", 2).embed(["a"])
    with pytest.raises(ValueError):
        parse_embedding({"dtype": "float64", "values": [1]})


def test_paths_storage_and_payloads(spark, folder):
    calls = FunctionEmbedder(lambda texts: [[1.0, float(len(t) % 3), 0.5] for t in texts], 3)
    index = Index.from_path(spark, folder, embedder=calls, storage="float32")
    assert index.storage == "float32" and index.search("login", 3).count() >= 1
    for path in ("sample.go", "./sample.go", "src/../sample.go", os.path.join(folder, "sample.go")):
        assert index.indexed_path(path) == "sample.go"
        assert index.expand(path, 3).where("is_anchor").count() == 1
    assert index.indexed_path("/elsewhere/sample.go") == "/elsewhere/sample.go"
    payload = render.expand_payload("sample.go", 3, index.expand("sample.go", 3), index.root)
    assert payload["line"] == 3 and payload["chunk_count"] == len(payload["chunks"]) and payload["anchor"]["absolute_path"] == os.path.join(folder, "sample.go")
    assert "sample.go:3" in render.expand_text(payload) and "No chunk" in render.expand_text(render.expand_payload("x", 1, index.expand("x", 1)))
    again = Index.load(spark, save_and_path(index, folder), calls)
    assert again.storage == "float32" and again.find_related("./sample.go", 3).count() == index.find_related("sample.go", 3).count()
    assert render.chunk_row({"file_path": 3, "start_line": "4", "end_line": None, "language": 5}) == {"file_path": "3", "start_line": 4, "end_line": 0, "language": None, "content": ""}
    assert render.chunk_row(None)["file_path"] == ""


def save_and_path(index, folder):
    path = folder + "-saved"
    index.save(path)
    return path


def test_command_line_with_a_client(spark, folder, capsys, monkeypatch, tmp_path):
    from lodestone.plans import cli

    monkeypatch.setenv("LODESTONE_CACHE", str(tmp_path / "cache"))
    seen = []

    def client(texts):
        seen.extend(texts)
        return [[1.0, 0.0, 0.0] for _ in texts]

    assert cli.main(["expand", folder, os.path.join(folder, "sample.go"), "3", "--json"], FunctionEmbedder(client, 3)) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["anchor"]["file_path"] == "sample.go"
    assert cli.main(["search", folder, "Login", "--alpha", "0.9", "--language", "go", "--json"], FunctionEmbedder(client, 3)) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["results"][0]["chunk"]["file_path"] == "sample.go"
    tool = server.Server(spark, embedder=FunctionEmbedder(client, 3))
    answer = tool.call("tools/call", {"name": "expand", "arguments": {"repo": folder, "file_path": "./sample.go", "line": 3}})
    assert not answer["isError"] and "sample.go:3" in answer["content"][0]["text"]
