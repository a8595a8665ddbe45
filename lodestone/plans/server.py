"""A tool server over line-delimited JSON-RPC."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from lodestone import __version__
from lodestone.operators.ranking import best_per_file
from lodestone.plans import render
from lodestone.plans.index import Index, tool_top_k
from lodestone.sources.bundle import SessionCache
from lodestone.sources.embedders import Embedder, chosen_embedder

LONGEST_LINE = 10 << 20
#: Protocol versions that are understood, the newest first.
PROTOCOLS = ("2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05", "2024-10-07")


def text_of(args: dict, name: str) -> str:
    value = args.get(name)
    return value if isinstance(value, str) else "" if value is None else str(value)


def int_of(args: dict, name: str) -> int | None:
    value = args.get(name)
    try:
        return None if value is None or isinstance(value, bool) else int(value)
    except (TypeError, ValueError):
        return None


def flag_of(args: dict, name: str, default: bool) -> bool:
    value = args.get(name)
    return value if isinstance(value, bool) else value.lower() == "true" if isinstance(value, str) else default


def texts_of(args: dict, name: str) -> list[str]:
    value = args.get(name)
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def _schema(required: list[str], **properties: str) -> dict:
    kinds = {"texts": {"type": "array", "items": {"type": "string"}}}
    return {"type": "object", "properties": {k: kinds.get(v, {"type": v}) for k, v in properties.items()}, "required": required}


class Server:
    """Dispatches initialize, ping, tools/list and tools/call; further tools can be registered."""

    def __init__(self, spark: SparkSession, workspace: str | None = None, embedder: Embedder | None = None):
        self.spark, self.workspace, self.cache, self.embedder = spark, workspace, SessionCache(), embedder or chosen_embedder()
        self.tools: dict[str, tuple[str, dict, Callable[[dict], str]]] = {}
        place = {"repo": "string", "file_path": "string", "line": "integer"}
        self.register("search", "Ranked search for a question or symbol.", _schema(["query", "repo"], query="string", repo="string", top_k="integer", dedupe_by_file="boolean"), self._search)
        self.register("locate", "Every line that holds a literal.", _schema(["literal", "repo"], literal="string", repo="string", mode="string", limit="integer", ignore_case="boolean", match_variants="boolean", include="texts", exclude="texts", context_lines="integer"), self._locate)
        self.register("expand", "Chunks around a line.", _schema(list(place), **place, before="integer", after="integer"), self._expand)
        self.register("find_related", "Chunks similar to the one at a line.", _schema(list(place), **place, top_k="integer"), self._related)

    def register(self, name: str, description: str, schema: dict, handler: Callable[[dict], str]) -> None:
        self.tools[name] = (description, schema, handler)

    def _index(self, args: dict) -> Index:
        repo = text_of(args, "repo")
        return self.cache.get(repo, lambda: Index.from_source(self.spark, repo, embedder=self.embedder, workspace=self.workspace).cached())

    def _search(self, args: dict) -> str:
        query, index = text_of(args, "query"), self._index(args)
        found = index.search(query, tool_top_k(int_of(args, "top_k")))
        if flag_of(args, "dedupe_by_file", True):
            found = best_per_file(found).orderBy("score", ascending=False)
        return render.search_text(render.search_payload(query, index.snippets(found, query)))

    def _locate(self, args: dict) -> str:
        literals = texts_of(args, "literal")
        hits = self._index(args).locate(literals, ignore_case=flag_of(args, "ignore_case", False), variants=flag_of(args, "match_variants", False), include=texts_of(args, "include"), exclude=texts_of(args, "exclude"), context=int_of(args, "context_lines") or 0)
        return render.locate_text(render.locate_payload(" | ".join(literals), hits, text_of(args, "mode") or "lines", int_of(args, "limit")))

    def _expand(self, args: dict) -> str:
        before, after = int_of(args, "before"), int_of(args, "after")
        index, path, line = self._index(args), text_of(args, "file_path"), int_of(args, "line") or 0
        rows = index.expand(path, line, 1 if before is None else before, 1 if after is None else after)
        return render.expand_text(render.expand_payload(path, line, rows, index.root))

    def _related(self, args: dict) -> str:
        rows = self._index(args).find_related(text_of(args, "file_path"), int_of(args, "line") or 0, tool_top_k(int_of(args, "top_k")))
        return render.search_text(render.search_payload("", rows))

    def call(self, method: str, params: dict) -> dict:
        if method == "initialize":
            asked = params.get("protocolVersion")
            return {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": __version__}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.tools.items()]}
        if method == "tools/call":
            tool = self.tools.get(params.get("name", ""))
            if tool is None:
                raise KeyError(f"no tool {params.get('name')!r}")
            try:
                return {"content": [{"type": "text", "text": tool[2](params.get("arguments") or {})}], "isError": False}
            except Exception as e:  # a failed tool is a result, not a failed request
                return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}
        raise LookupError(method)

    def handle(self, line: str) -> str | None:
        """The answer to one request line; None for notifications."""
        try:
            request = json.loads(line) if len(line) <= LONGEST_LINE else None
        except ValueError:
            request = None
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        if "id" not in request:
            return None
        head = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            return json.dumps(head | {"result": self.call(request["method"], request.get("params") or {})})
        except KeyError as e:
            return json.dumps(head | {"error": {"code": -32602, "message": str(e)}})
        except LookupError:
            return json.dumps(head | {"error": {"code": -32601, "message": f"method not found: {request['method']}"}})


def serve(spark: SparkSession, source: TextIO, sink: TextIO, embedder: Embedder | None = None) -> int:
    server = Server(spark, embedder=embedder)
    for line in source:
        if line.strip() and (answer := server.handle(line)) is not None:
            print(answer, file=sink, flush=True)
    return 0
