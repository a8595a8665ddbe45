"""Chunking of texts: structural units, lines, greedy merging, embedding windows.

Chunks of one file depend on everything before them in the file, so files are
worked on alone, in Arrow batches; nothing is shuffled. Positions are bytes.
"""

from __future__ import annotations

import ast
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines_with_ends
from lodestone.operators.dense import OVERLAP_CHARS, WINDOW_CHARS, windows

TARGET_BYTES = 1500
LEAST_NODE, DEEPEST = 50, 500
#: Lines within which a declaration's brace must open.
BRACE_LINES = 60

Span = tuple[int, int]
_BRACE, _TRAILING = re.compile(rb"[{}]"), re.compile(rb"[; \t]*\n?")
_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")

# What opens a declaration in each language.
_PY_DECLARATION = re.compile(rb"(?:async\s+def|def|class)\b")
_PY_FUNCTION = re.compile(rb"(?:async\s+def|def)\b")
_DECLARATIONS = {
    "go": (re.compile(rb"\s*(?:func\b|type\b.*\b(?:struct|interface)\b)"), None, None),
    "javascript": (re.compile(rb"\s*(?:export\s+)?(?:async\s+function\b|function\b|class\b|interface\b|type\b|(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)(?:\s*:\s*[^=]+)?\s*=>)"), None, None),
    "cpp": (
        re.compile(rb"\s*(?:(?:template\s*<[^>]*>\s*)?(?:class|struct|namespace|enum(?:\s+class)?)\b)"),
        re.compile(rb"\s*(?:[\w:~<>,*&]+\s+)+\w+\s*\([^;{}]*\)\s*(?:const)?\s*(?:override)?(?:\s*=\s*0)?"),
        re.compile(rb"\s*(?:if|for|while|switch|catch|return|sizeof|static_assert|else|do)\b"),
    ),
    "c": (re.compile(rb"\s*(?:struct|enum|union|typedef)\b"), re.compile(rb"\s*(?:[\w:*\s]+\s+)+\w+\s*\([^;{}]*\)"), re.compile(rb"\s*(?:if|for|while|switch|return|sizeof|else|do)\b")),
}
_DECLARATIONS["typescript"] = _DECLARATIONS["javascript"]


def line_spans(data: bytes) -> list[Span]:
    """Lines with their terminators."""
    return [m.span() for m in _LINE.finditer(data)]


def merged(units: list[Span], target: int) -> list[Span]:
    """Neighbours joined while they fit; one unit that alone is too long stays whole."""
    out: list[Span] = []
    begin = end = size = 0
    for a, b in units:
        if size and size + (b - a) > target:
            out.append((begin, end))
            size = 0
        if not size:
            begin = a
        end = b
        size += b - a
    if size:
        out.append((begin, end))
    return out


def line_chunks(data: bytes, target: int = TARGET_BYTES) -> list[Span]:
    return merged(line_spans(data), target)


def _indent(line: bytes) -> int:
    return len(line) - len(line.lstrip(b" \t"))


def _block_ends(depth: list[int | None]) -> list[int]:
    """Last line of the block that each line opens: the one before the next line of code that is not deeper.

    ``depth`` is null for lines without code. One pass from the end over a stack of
    the lines that may still close something.
    """
    ends, open_ = [0] * len(depth), []
    for i in range(len(depth) - 1, -1, -1):
        d = depth[i]
        if d is None:
            continue
        while open_ and depth[open_[-1]] > d:
            open_.pop()
        ends[i] = (open_[-1] if open_ else len(depth)) - 1
        open_.append(i)
    return ends


def python_units(data: bytes) -> list[Span]:
    """Functions at the top with their decorators; a class up to the end of its first method, then each further method; what comes before the first declaration."""
    spans = line_spans(data)
    lines = [data[a:b].rstrip(b"\r\n") for a, b in spans]
    code = [t.strip() for t in lines]
    depth = [_indent(t) if c and not c.startswith(b"#") else None for t, c in zip(lines, code)]
    declared = [i for i, c in enumerate(code) if _PY_DECLARATION.match(c)]
    if not declared:
        return []
    functions = [i for i in declared if _PY_FUNCTION.match(code[i])]
    ends = _block_ends(depth)
    units: set[Span] = {(0, spans[declared[0]][0])} if declared[0] else set()
    outer, at = None, 0  # the outermost class around a line; functions before the line
    for i in declared:
        if outer is not None and i > ends[outer]:
            outer = None
        is_function = at < len(functions) and functions[at] == i
        if code[i].startswith(b"class "):
            outer = i if outer is None else outer
            following = functions[at] if at < len(functions) else len(spans)
            units.add((spans[i][0], spans[ends[following] if following <= ends[i] else ends[i]][1]))
        elif depth[i] == 0:
            top = i
            while top and code[top - 1].startswith(b"@"):
                top -= 1
            units.add((spans[top][0], spans[ends[i]][1]))
        elif is_function and outer is not None and functions[at - 1 if at else 0] > outer and at:
            units.add((spans[i][0], spans[ends[i]][1]))
        at += is_function
    return sorted(units)


def _brace_pairs(data: bytes) -> tuple[list[int], dict[int, int]]:
    """Places of the opening braces, and the end of the closing brace of each that is closed."""
    opening, closed, waiting = [], {}, []
    for m in _BRACE.finditer(data):
        if m[0] == b"{":
            opening.append(m.start())
            waiting.append(m.start())
        elif waiting:
            closed[waiting.pop()] = m.end()
    return opening, closed


def brace_units(data: bytes, language: str) -> list[Span]:
    """From each declaration to the brace that closes it, with what trails on its line; what comes before the first.

    Braces are paired once per text; a declaration takes the first one that opens within ``BRACE_LINES`` lines.
    """
    spans = line_spans(data)
    kind, function, control = _DECLARATIONS[language]
    opening, closed = _brace_pairs(data)
    units: set[Span] = set()
    first: int | None = None
    for i, (a, b) in enumerate(spans):
        line = data[a:b].rstrip(b"\r\n")
        if not kind.match(line):
            at_margin = function is not None and not _indent(line)
            if not at_margin or not function.match(line) or control.match(line):
                continue
        first = a if first is None else first
        k = bisect_left(opening, a)
        limit = spans[i + BRACE_LINES][1] if i + BRACE_LINES < len(spans) else len(data)
        end = closed.get(opening[k]) if k < len(opening) and opening[k] < limit else None
        if end is not None:
            units.add((a, _TRAILING.match(data, end).end()))
    if first:
        units.add((0, first))
    return sorted(units)


def structural_chunks(data: bytes, language: str | None, target: int = TARGET_BYTES) -> list[Span] | None:
    """Merged structural units; None for other languages and texts without units."""
    if language == "python":
        units = python_units(data)
    elif language in _DECLARATIONS:
        units = brace_units(data, language)
    else:
        return None
    return merged(units, target) if units else None


def python_tree_chunks(data: bytes, target: int = TARGET_BYTES) -> list[Span] | None:
    """Statements by Python's own parser, taken apart while too long, then merged; None if it does not parse."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [a for a, _ in line_spans(data)] + [len(data)]

    def span(node: ast.stmt) -> Span:
        top = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return starts[min(top, len(starts)) - 1], starts[min(node.end_lineno or node.lineno, len(starts) - 1)]

    def parts(nodes: list[ast.stmt], depth: int) -> list[Span]:
        out: list[Span] = []
        for node in nodes:
            a, b = span(node)
            inner = [x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)]
            if b - a > target and inner and depth < DEEPEST:
                cuts = parts(inner, depth + 1)
                out += [(a, cuts[0][1]), *cuts[1:-1], (cuts[-1][0], b)] if len(cuts) > 1 else [(a, b)]
            elif out and (b - a < LEAST_NODE or a < out[-1][1]):
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    units = parts(tree.body, 0)
    if not units:
        return None
    # comments and blank lines belong to what follows, the rest of the file to the last unit
    closed = [(0 if i == 0 else units[i - 1][1], b) for i, (_, b) in enumerate(units)]
    closed[-1] = (closed[-1][0], len(data))
    return merged(closed, target)


def nested_tree_chunks(data: bytes, target: int = TARGET_BYTES) -> list[Span] | None:
    """For languages without a parser here: a tree by brackets and indentation, taken apart while a part is too long, then merged.

    A line's depth is the number of brackets open before it, and its indentation
    within them; a node is a line with the deeper lines after it. None without lines.
    """
    spans = line_spans(data)
    if not spans:
        return None
    depth, open_ = [], 0
    for a, b in spans:
        line = data[a:b]
        closing = line.lstrip()[:1] in (b")", b"]", b"}")
        blank = not line.strip()
        depth.append(None if blank or closing else (open_, _indent(line)))  # these lines belong to the node before them
        open_ = max(0, open_ + sum(line.count(c) for c in (b"(", b"[", b"{")) - sum(line.count(c) for c in (b")", b"]", b"}")))
    units: list[Span] = []
    todo = [(0, len(spans), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if spans[hi - 1][1] - spans[lo][0] <= target or hi - lo == 1 or level >= DEEPEST:
            units.append((spans[lo][0], spans[hi - 1][1]))
            continue
        top = min((d for d in depth[lo + bool(level) : hi] if d is not None), default=None)
        cuts = [] if top is None else [i for i in range(lo + 1, hi) if depth[i] == top]
        todo += [(x, y, level + 1 if cuts or not level else DEEPEST) for x, y in zip([*cuts[::-1], lo], [hi, *cuts[::-1]])]
    closed: list[Span] = []
    for a, b in units:
        if closed and closed[-1][1] - closed[-1][0] < LEAST_NODE:
            closed[-1] = (closed[-1][0], b)
        else:
            closed.append((a, b))
    return merged(closed, target)


#: Tree chunkers by language; a caller may add one. Python has a parser here, the others the nested form.
TREE_CHUNKERS: dict[str, Callable[[bytes, int], list[Span] | None]] = {"python": python_tree_chunks} | dict.fromkeys(
    ("bash", "c", "cpp", "csharp", "css", "dockerfile", "elixir", "go", "html", "java", "javascript", "kotlin", "lua", "php", "ruby", "rust", "scala", "toml", "typescript", "tsx", "yaml"), nested_tree_chunks
)


def trees_wanted() -> bool:
    """Trees are used where asked for unless ``LODESTONE_TREE_CHUNKING`` is 0."""
    return os.environ.get("LODESTONE_TREE_CHUNKING") != "0"


def chunk_spans(data: bytes, language: str | None, target: int = TARGET_BYTES, trees: bool = False) -> list[Span]:
    """By tree if wanted and possible, else by structure, else by lines."""
    found = TREE_CHUNKERS[language](data, target) if trees and trees_wanted() and language in TREE_CHUNKERS else None
    if found is None:
        found = structural_chunks(data, language, target)
    return line_chunks(data, target) if found is None else found


def chunk_files(files: DataFrame, target: int = TARGET_BYTES, how: str = "cascade") -> DataFrame:
    """``files(file_path, language, text)`` to ``(file_path, pos, start_line, end_line, language, content)``.

    ``how``: ``cascade`` (structure, else lines), ``tree`` (parser first) or
    ``lines``. Line numbers count ``\\n`` only; a newline at a chunk's end does not
    advance ``end_line``. Blank chunks are left out; null and empty texts give none.
    """
    schema = "file_path string, pos int, start_line int, end_line int, language string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(at, 256)
                for path, language, text in zip(*(c.to_pylist() for c in part.columns)):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    spans = line_chunks(data, target) if how == "lines" else chunk_spans(data, language, target, how == "tree")
                    seen, line, pos = 0, 1, 0
                    for a, b in spans:
                        line += data.count(b"\n", seen, a) if a >= seen else -data.count(b"\n", a, seen)
                        seen = a
                        piece = data[a:b]
                        if piece.strip():
                            rows.append((path, pos, line, line + piece.count(b"\n", 0, len(piece) - 1), language, piece.decode("utf-8", "replace")))
                            pos += 1
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file_path", "pos", "start_line", "end_line", "language", "content"])

    return files.select("file_path", "language", "text").mapInArrow(run, schema)


def line_chunks_folded(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """Line chunks by a fold over the lines inside the engine, without Python: ``(file_path, pos, content)``.

    The fold costs time with the square of a file's number of chunks, so it is
    meant for files within the usual size limit.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state, line):
        fits = (F.octet_length(state["now"]) == 0) | (F.octet_length(state["now"]) + F.octet_length(line) <= target)
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["now"])).alias("done"), F.when(fits, F.concat(state["now"], line)).otherwise(line).alias("now"))

    def finish(state):
        return F.when(state["now"] == "", state["done"]).otherwise(F.array_append(state["done"], state["now"]))

    chunks = F.aggregate(lines_with_ends(F.col("text")), start, step, finish)
    return files.where("text is not null").select("file_path", F.posexplode(chunks).alias("pos", "content"))


def embedding_windows(chunks: DataFrame, size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(chunk_id, win_pos, text)``: windows of every chunk's content; null content gives none."""
    return chunks.where("content is not null").select("chunk_id", F.posexplode(windows(F.col("content"), size, overlap)).alias("win_pos", "text"))
