"""Rendering of a handful of result rows for people and tools."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Row

from lodestone.operators.locate import shown, summary


def result_dict(row: Row, root: str | None = None) -> dict:
    """One result; with the root of the source also its absolute path, which the location then names."""
    d = row.asDict(recursive=True)
    chunk = {k: d[k] for k in ("file_path", "start_line", "end_line", "language", "content") if k in d}
    place = d["file_path"]
    if root:
        place = chunk["absolute_path"] = os.path.join(os.path.abspath(root), d["file_path"])
    chunk["location"] = f"{place}:{d['start_line']}-{d['end_line']}"
    if d.get("truncated"):
        chunk |= {k: d[k] for k in ("truncated", "anchor_line", "full_start_line", "full_end_line")}
    return {"chunk": chunk, "score": f"{d['relevance']}%"} if "relevance" in d else {"chunk": chunk}


def chunk_row(record: object) -> dict:
    """A chunk from a record that other tools wrote: missing and odd values become empty texts, zeros and null."""
    d = record if isinstance(record, dict) else {}

    def text(v: object) -> str:
        return v if isinstance(v, str) else "" if v is None else str(v)

    def number(v: object) -> int:
        try:
            return int(float(v)) if not isinstance(v, bool) else 0  # type: ignore[arg-type]
        except (TypeError, ValueError, OverflowError):
            return 0

    language = d.get("language")
    return {"file_path": text(d.get("file_path")), "start_line": number(d.get("start_line")), "end_line": number(d.get("end_line")), "language": language if isinstance(language, str) and language else None, "content": text(d.get("content"))}


def search_payload(query: str, results: DataFrame, root: str | None = None) -> dict:
    return {"query": query, "results": [result_dict(r, root) for r in results.collect()]}


def expand_payload(path: str, line: int, rows: DataFrame, root: str | None = None) -> dict:
    """The chunks around a line, how many, and which one holds it."""
    held = rows.collect()
    chunks = [result_dict(r, root)["chunk"] for r in held]
    anchor = next((c for c, r in zip(chunks, held) if r["is_anchor"]), None)
    return {"file_path": path, "line": line, "chunk_count": len(chunks), "anchor": anchor, "chunks": chunks}


def expand_text(payload: dict) -> str:
    if not payload["chunks"]:
        return f"No chunk at {payload['file_path']}:{payload['line']}."
    head = f"{payload['chunk_count']} chunks around {payload['file_path']}:{payload['line']}"
    return "\n\n".join([head, *(f"{c['location']}{' *' if c is payload['anchor'] else ''}\n{c.get('content') or ''}" for c in payload["chunks"])])


def locate_payload(literal: str, hits: DataFrame, mode: str = "lines", limit: int | None = None) -> dict:
    total = summary(hits, limit if mode != "count" else None).first()
    out = {"literal": literal, "mode": mode, "n": total["n"], "files": total["files"]}
    if mode == "count":
        return out
    if total["truncated"]:
        out["truncated"] = True
    names = {"file_path": "f", "line": "l", "text": "t", "context": "ctx", "context_start_line": "ctx_l"}
    out["hits"] = [{names[k]: v for k, v in r.asDict().items() if v is not None} for r in shown(hits, mode, limit).collect()]
    return out


def search_text(payload: dict) -> str:
    if not payload["results"]:
        return "No results found."
    blocks = []
    for r in payload["results"]:
        c = r["chunk"]
        note = f"\n(lines {c['start_line']}-{c['end_line']} of {c['full_start_line']}-{c['full_end_line']})" if c.get("truncated") else ""
        blocks.append(f"{c['location']} ({r.get('score', '')})\n{c.get('content') or ''}{note}")
    return "\n\n".join(blocks)


def locate_text(payload: dict) -> str:
    lines = [f"{payload['n']} lines in {payload['files']} files"]
    for h in payload.get("hits", []):
        if "ctx" in h:
            lines += [f"{h['f']}:{h['ctx_l'] + i}: {t}" for i, t in enumerate(h["ctx"])]
        else:
            lines.append(f"{h['f']}:{h['l']}" + (f": {h['t']}" if "t" in h else ""))
    return "\n".join(lines + ["(truncated)"] * bool(payload.get("truncated")))


def as_json(payload: dict) -> str:
    return json.dumps(payload, ensure_ascii=False)
