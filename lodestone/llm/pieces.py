"""Cutting oversized texts into balanced, overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches

LIMIT_BYTES = 1500
OVERLAP_BYTES = 120

_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
#: A line that opens a unit in one of the usual languages, with nothing before it.
_OPENS = re.compile(
    rb"(?:@\w|#{1,6} |(?:pub(?:\([^)]*\))? |export |default |async |public |private |protected |static |final |abstract |unsafe |extern )*"
    rb"(?:def|class|func|function|fn|impl|struct|enum|trait|interface|type|module|namespace|package|message|service|CREATE|create|SELECT|INSERT|mod|var|const|let)\b)"
)
_CLOSES = re.compile(rb"[})\]]+[;,]?\s*$|end\s*$")


def _char_start(data: bytes, at: int, floor: int) -> int:
    """The largest position up to ``at`` that splits neither a character nor ``\\r\\n``."""
    while at > floor and at < len(data) and (data[at] & 0xC0 == 0x80 or (data[at] == 10 and data[at - 1] == 13)):
        at -= 1
    return at


def _line_strengths(data: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """How good a cut after each line is: 3 between units, 2 at a blank line or a closed block, 1 else."""
    out = []
    for i, (a, b) in enumerate(spans):
        if i + 1 == len(spans):
            out.append(3)
            continue
        line, nxt = data[a:b], data[spans[i + 1][0] : spans[i + 1][1]]
        flush = nxt[:1] not in (b" ", b"\t", b"\r", b"\n")
        if flush and _OPENS.match(nxt) and not line.startswith((b"@", b"//", b"#", b"--")):
            out.append(3)
        elif not line.strip() or (flush and _CLOSES.match(line)):
            out.append(2)
        else:
            out.append(1)
    return out


def _atoms(data: bytes, limit: int) -> tuple[list[int], list[int], bool]:
    """Ends and strengths of the smallest parts: lines, and parts of lines over the limit."""
    spans = [m.span() for m in _LINE.finditer(data)]
    ends, strengths, inside = [], [], False
    for (a, b), strength in zip(spans, _line_strengths(data, spans)):
        if b - a > limit:
            inside = True
            room = max(1, limit - OVERLAP_BYTES) if limit > 2 * OVERLAP_BYTES else limit
            n = -(-(b - a) // room)
            at = a
            while b - at > room:
                target = at + max(4, -(-(b - at) // max(1, n)))
                target = min(target, at + room)
                low = at + max(1, (target - at) // 2)
                cut = max(data.rfind(c, low, target) for c in (b" ", b"\t", b";", b",", b"}")) + 1
                cut = cut if cut > low else _char_start(data, target, at)
                if cut <= at:  # one character longer than the room
                    cut = at + 1
                    while cut < b and data[cut] & 0xC0 == 0x80:
                        cut += 1
                ends.append(cut)
                strengths.append(0)
                at, n = cut, n - 1
        ends.append(b)
        strengths.append(strength)
    return ends, strengths, inside


def _place(ends: list[int], strengths: list[int], total: int, n: int, limit: int, soft: int) -> list[int] | None:
    """Cut positions for ``n`` pieces near equal-length targets, or None if a limit fails."""
    cuts, start, i = [], 0, 0
    for k in range(1, n):
        target = start + (total - start) / (n - k + 1)
        window = max(40.0, 0.25 * total / n)
        cap = start + (limit if k == 1 else soft)
        best, j = None, i
        while j < len(ends) - 1:
            end = ends[j]
            if end > cap and not (end - start <= limit and (j == i)):
                break
            far = abs(end - target)
            rank = (far <= window, strengths[j] if far <= window else 0, -far)
            if best is None or rank > best[0]:
                best = (rank, j)
            if end > target + window:
                break
            j += 1
        if best is None:
            return None
        i = best[1] + 1
        start = ends[best[1]]
        cuts.append(start)
        if i >= len(ends):
            return None
    rest = total - start
    if rest > (limit if n == 1 else soft) and not (rest <= limit and i == len(ends) - 1):
        return None
    return cuts


def _packed(ends: list[int], limit: int, soft: int) -> list[int]:
    """Cut positions by filling piece after piece; always within the limits."""
    cuts, start, last = [], 0, 0
    for end in ends:
        if end - start > (limit if not cuts else soft) and last > start:
            cuts.append(last)
            start = last
        last = end
    return cuts


def cut(text: str, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[list[tuple[int, int, int]], bytes, bool]:
    """Pieces ``(begin with overlap, begin of new text, end)`` as byte positions.

    The piece count starts at the least possible number and equal-length targets
    are snapped to the strongest nearby boundary; where a limit fails, pieces are
    added (an eighth more at a time) up to one for each line. Only where no number
    of balanced pieces keeps the limits, as with lines of nearly the limit's length
    behind others, pieces are filled one after the other. Only lines that alone exceed the limit are cut inside. Also returns
    the bytes and whether there is such a line.
    """
    data = text.encode("utf-8", "surrogatepass")
    total = len(data)
    if total <= limit:
        return ([(0, 0, total)] if total else []), data, False
    ends, strengths, inside = _atoms(data, limit)
    soft = max(1, limit - overlap)
    n = 1 + -(-(total - limit) // soft)
    cuts = None
    while cuts is None and n <= len(ends):
        cuts = _place(ends, strengths, total, n, limit, soft)
        n = len(ends) if n < len(ends) < n + n // 8 + 1 else n + n // 8 + 1
    if cuts is None:
        cuts = _packed(ends, limit, soft)
    out, begin = [], 0
    for end in [*cuts, total]:
        back = begin
        if begin:
            room = min(overlap, limit - (end - begin), begin - out[-1][1])
            back = begin - max(0, room)
            while back < begin and (data[back] & 0xC0 == 0x80 or (data[back] == 10 and data[back - 1] == 13)):
                back += 1
            at = data.find(b"\n", max(0, back - 1), begin - 1)  # whole lines where they fit
            if at >= 0 and at + 1 < begin:
                back = max(back, at + 1)
        out.append((back, begin, end))
        begin = end
    return out, data, inside


def split_oversized(chunks: DataFrame, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES, with_text: bool = True) -> DataFrame:
    """Ordered pieces of every chunk whose content has more than ``limit`` bytes.

    Out come ``chunk_id, piece_no, n_pieces, start_line, end_line, overlap_bytes,
    cut_kind`` and ``content``. A chunk that occurs twice is cut once; null
    content and content within the limit give no piece; a null start_line gives
    null lines. Other columns are ignored. Each chunk is cut on its own, so
    nothing is shuffled but the removal of duplicates among oversized chunks.
    """
    big = chunks.where(F.octet_length("content") > limit).select("chunk_id", "start_line", "content")
    if with_text:
        big = big.dropDuplicates(["chunk_id"])
    schema = "chunk_id bigint, piece_no int, n_pieces int, start_line int, end_line int, overlap_bytes int, cut_kind string" + ", content string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows: list[tuple] = []
            for chunk_id, first, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces, data, inside = cut(text, limit, overlap)
                line = first
                at = 0
                for no, (back, begin, end) in enumerate(pieces):
                    if first is not None:
                        line += data.count(b"\n", at, back) if back >= at else -data.count(b"\n", back, at)
                    at = back
                    stop = None if first is None else line + data.count(b"\n", back, end - 1)
                    row = (chunk_id, no, len(pieces), line, stop, begin - back, "inside" if inside else "line")
                    rows.append(row + ((data[back:end].decode("utf-8", "surrogatepass"),) if with_text else ()))
            columns = list(zip(*rows)) if rows else []
            if columns:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                names = ["chunk_id", "piece_no", "n_pieces", "start_line", "end_line", "overlap_bytes", "cut_kind", "content"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    return big.mapInArrow(run, schema)


def cut_kinds(chunks: DataFrame, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``(chunk_id, cut_kind)`` of every chunk the operator cuts, each once."""
    return split_oversized(chunks, limit, overlap, with_text=False).select("chunk_id", "cut_kind").distinct()
