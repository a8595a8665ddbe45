"""Near-duplicate texts by an inverted join over signature coordinates.

Every distinct set of five-word shingles gets a signature of COORDINATES
minima. Two sets of Jaccard similarity J agree in each coordinate with
probability J, so pairs at the threshold of 0.6 agree in 24 of 40 on average
(standard deviation 3.1); pairs that agree in fewer than MIN_MATCHES = 14 are
dropped unseen, which loses 0.04 % of the pairs that lie exactly at 0.6 and
practically none above 0.65. What is left is checked exactly.

Documents are posted under their coordinate-value pairs, rarest first. Two
documents with MIN_MATCHES common pairs must meet among their first
COORDINATES - MIN_MATCHES + 1 ones, so only this prefix is posted and the most
frequent pairs are mostly skipped. Where a posting list is still long, its
documents are posted again under the pair and each further pair of theirs that
can be the second (third, ...) common one; but a long list of documents that are
alike for the most part would only be copied by this, so it is compared by tiles
of two blocks, each pair in the list of its first common pairs only. No list is
ever expanded in one task while it is long, and none is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches, written
from lodestone.llm.fingerprints import ascii_words, grams, minhash, mix, row_sets, utf8_parts

SHINGLE_WORDS = 5
COORDINATES = 40
MIN_MATCHES = 14
#: A posting list of at most so many documents is expanded into pairs.
LIST_LIMIT = 96
#: The most frequent coordinate-value pairs that the workers know of (8 bytes each). Only the order of
#: postings depends on them; a pair that is missing here is handled as a long list.
FREQUENT_LIMIT = 200_000
#: Ids up to this number are broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000

#: A long list is compared by tiles of two blocks of so many documents where two of them share so many pairs on average.
TILE_ROWS, ALIKE = 512, MIN_MATCHES / 2
#: Documents of a long list that this average is estimated from (it decides the way, not the result).
ESTIMATE_ROWS = 256

_PREFIX = COORDINATES - MIN_MATCHES + 1


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, the rows that have any, and where each begins."""
    found, rows = ascii_words(*utf8_parts(texts))
    values, of, _ = grams(found, rows, words)
    values, of = row_sets(values, of)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return values, of[begin], begin


def signatures(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``(chunk_id, set_hash, n_shingles, signature)`` of every text with at least five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 20):
            values, rows, begin = shingle_sets(batch.column(1))
            if not len(rows):
                continue
            sizes = np.diff(np.append(begin, len(values)))
            with np.errstate(over="ignore"):
                whole = mix(np.add.reduceat(mix(values), begin) + sizes.astype(np.uint64))
            signature = minhash(values, begin, COORDINATES).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(whole.view(np.int64)),
                    pa.array(sizes.astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES * 4), len(rows), [None, pa.py_buffer(np.ascontiguousarray(signature))]).cast(pa.binary()),
                ],
                names=["chunk_id", "set_hash", "n_shingles", "signature"],
            )

    rows = chunks.select(F.col(key).cast("bigint").alias("chunk_id"), F.col(text).alias("text")).where("chunk_id is not null and text is not null")
    return rows.mapInArrow(run, "chunk_id bigint, set_hash bigint, n_shingles int, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as a matrix, without a copy where they lie side by side."""
    n, width = len(column), COORDINATES * 4
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    if n and begin[-1] - begin[0] == n * width:
        return np.frombuffer(column.buffers()[2], np.uint8)[begin[0] : begin[-1]].view(np.uint32).reshape(n, COORDINATES)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(n, COORDINATES)


def _tokens(matrix: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as 64-bit values."""
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | matrix.astype(np.uint64)


def frequent_pairs(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent coordinate-value pairs, counted over all documents, with their counts.

    Each partition counts on its own and passes on what it sees at least twice. A
    pair spread thinly over very many partitions may pass for rare; this makes its
    lists longer (they are posted again or tiled) and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, c = np.unique(_tokens(_matrix(batch.column(0))), return_counts=True)
            values, at = np.unique(np.concatenate([values, v]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]), len(values)).astype(np.int64)
            if len(values) > 4_000_000:
                values, counts = values[counts > 1], counts[counts > 1]
        keep = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names=["pair", "n"])

    counted = reps.select("signature").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > LIST_LIMIT // 2)
    counted = written(counted, "frequent")
    # the least power of two above which there are few enough pairs
    sizes = dict(counted.groupBy(F.floor(F.log2("n")).alias("size")).count().collect())
    least, held = 0, 0
    for size in sorted(sizes, reverse=True):
        held += sizes[size]
        if held > FREQUENT_LIMIT:
            least = size + 1
            break
    top = counted.where(F.col("n") >= 1 << least).toPandas()
    pairs = top["pair"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(pairs)
    return pairs[order], top["n"].to_numpy(np.int64)[order]


def _ordered(matrix: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's pairs, rarest first in one order for all documents, and their counts (0: not frequent)."""
    tokens = _tokens(matrix)
    n = np.zeros(tokens.shape, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        n = np.where(frequent[at] == tokens, counts[at], 0)
    order = np.lexsort((tokens, n), axis=1)
    return np.take_along_axis(tokens, order, 1), np.take_along_axis(n, order, 1)


def _arrow(lists: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in lists.values()], names=list(lists))


def _postings(reps: DataFrame, known: object) -> DataFrame:
    """First postings ``(list, rep, level, last)``: under one pair, or two where the first is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tokens, n = _ordered(_matrix(batch.column(1)), frequent, counts)
            out: dict[str, list[np.ndarray]] = {"list": [], "rep": [], "level": [], "last": []}

            def post(lists: np.ndarray, of: np.ndarray, level: int, last: int) -> None:
                out["list"].append(mix(lists).view(np.int64))
                out["rep"].append(ids[of])
                out["level"].append(np.full(len(of), level, np.int32))
                out["last"].append(np.full(len(of), last, np.int32))

            for p in range(_PREFIX):
                rare = np.flatnonzero(n[:, p] == 0)
                post(tokens[rare, p], rare, 1, p)
                often = np.flatnonzero(n[:, p])
                if len(often):
                    for q in range(p + 1, _PREFIX + 1):
                        post(mix(tokens[often, p]) ^ (tokens[often, q] * np.uint64(3)), often, 2, q)
            yield _arrow(out)

    return reps.select("rep", "signature").mapInArrow(run, "list bigint, rep bigint, level int, last int")


def _alike(long: DataFrame) -> DataFrame:
    """``(list)``: long lists of which two documents share ALIKE pairs or more on average, and those that cannot be posted further."""
    sizes = long.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"))
    some = long.join(sizes.select("list", F.ceil(F.col("n") / ESTIMATE_ROWS).alias("every")), "list").where(F.pmod(F.xxhash64("rep"), F.col("every")) == 0)
    pairs = some.select("list", F.explode(F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda c: F.struct(c.alias("c"), F.substring("signature", c * 4 + 1, F.lit(4)).alias("v")))).alias("p"))
    counted = pairs.groupBy("list", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("list").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("met"), (F.sum("k") / COORDINATES).alias("m"))
    average = F.col("met") / F.greatest(F.col("m") * (F.col("m") - 1), F.lit(1.0))
    return sizes.join(counted, "list", "left").where((F.coalesce(average, F.lit(0.0)) >= ALIKE) | (F.col("level") >= MIN_MATCHES)).select("list")


def _tiled(long: DataFrame, known: object) -> DataFrame:
    """``(a, b)`` of long lists with MIN_MATCHES common pairs or more, of which the first are those of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        tile: tuple | None = None
        parts: list[list[tuple]] = [[], []]

        def close() -> Iterator[pa.RecordBatch]:
            if not parts[0] or not parts[1]:
                return
            x, y = ([np.concatenate(c) for c in zip(*side)] for side in parts)
            for at in range(0, len(x[0]), 64):
                same = x[1][at : at + 64, None, :] == y[1][None, :, :]
                good = (same.sum(axis=2) >= MIN_MATCHES) & ((same & x[2][at : at + 64, None, :]).sum(axis=2) == x[3][at : at + 64, None])
                good &= x[0][at : at + 64, None] != y[0][None, :] if tile[1] != tile[2] else x[0][at : at + 64, None] < y[0][None, :]
                i, j = np.nonzero(good)
                p, q = x[0][at + i], y[0][j]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            ids, level, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            own = batch.column(3).to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column(7)).copy()
            tokens, _ = _ordered(matrix, frequent, counts)
            # coordinates of the pairs up to the last one of the list
            first = np.zeros(matrix.shape, bool)
            np.put_along_axis(first, (tokens >> np.uint64(32)).astype(np.int64), np.arange(COORDINATES) <= last[:, None], axis=1)
            cuts = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(where)]):
                if tile != tuple(where[a]):
                    yield from close()
                    tile, parts = tuple(where[a]), [[], []]
                for side, block in enumerate(tile[1:]):
                    m = np.flatnonzero(own[a:b] == block) + a
                    if len(m):
                        parts[side].append((ids[m], matrix[m], first[m], level[m]))
        yield from close()

    sizes = long.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("blocks"))
    placed = long.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    spread = placed.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "rep", "level", "last", "signature")
    spread = spread.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "level", "last", "signature")
    return spread.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high").mapInArrow(run, "a bigint, b bigint")


def _further(long: DataFrame, known: object) -> DataFrame:
    """The documents of long lists posted again under one more of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids, level, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            tokens, _ = _ordered(_matrix(batch.column(4)), frequent, counts)
            out: dict[str, list[np.ndarray]] = {"list": [], "rep": [], "level": [], "last": []}
            for q in range(1, COORDINATES):
                on = np.flatnonzero((last < q) & (q < _PREFIX + level))
                if len(on):
                    out["list"].append(mix(mix(lists[on].view(np.uint64)) ^ (tokens[on, q] * np.uint64(3))).view(np.int64))
                    out["rep"].append(ids[on])
                    out["level"].append((level[on] + 1).astype(np.int32))
                    out["last"].append(np.full(len(on), q, np.int32))
            if out["list"]:
                yield _arrow(out)

    return long.select("list", "rep", "level", "last", "signature").mapInArrow(run, "list bigint, rep bigint, level int, last int")


def _expanded(postings: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of short lists and, with ``b`` null, the postings of long ones.

    Lists arrive sorted; a task holds at most LIST_LIMIT documents of one list,
    the rest of a longer one streams through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "list", "level", "last"]

        def rows(lists: np.ndarray, ids: np.ndarray, level: np.ndarray, last: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
            """Complete lists only."""
            if not len(lists):
                return
            begin = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            size = np.diff(np.append(begin, len(lists)))
            whole = (size > 1) & (size <= LIST_LIMIT)
            for step in range(1, int(size[whole].max(initial=1))):
                b, s = begin[whole & (size > step)], size[whole & (size > step)]
                n = s - step
                first = np.repeat(b, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = ids[first], ids[first + step]
                m = x != y
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[m]), pa.array(np.maximum(x, y)[m]), pa.nulls(int(m.sum()), pa.int64()), pa.nulls(int(m.sum()), pa.int32()), pa.nulls(int(m.sum()), pa.int32())], names=names)
            over = np.repeat(size > LIST_LIMIT, size)
            if over.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[over]), pa.nulls(int(over.sum()), pa.int64()), pa.array(lists[over]), pa.array(level[over]), pa.array(last[over])], names=names)

        held: list[np.ndarray] | None = None
        long_list: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            if long_list is not None:  # more of a list already known to be long
                n = int(np.searchsorted(now[0] != long_list, True)) if now[0][0] == long_list else 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(now[1][:n]), pa.nulls(n, pa.int64()), pa.array(now[0][:n]), pa.array(now[2][:n]), pa.array(now[3][:n])], names=names)
                now = [x[n:] for x in now]
                if not len(now[0]):
                    held = None
                    continue
                long_list = None
            tail = int(np.searchsorted(now[0], now[0][-1]))
            yield from rows(*(x[:tail] for x in now), False)
            held = [x[tail:] for x in now]
            if len(held[0]) > LIST_LIMIT:
                n = len(held[0])
                yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.nulls(n, pa.int64()), pa.array(held[0]), pa.array(held[2]), pa.array(held[3])], names=names)
                long_list, held = int(held[0][0]), None
        if held is not None:
            yield from rows(*held, True)

    spread = postings.repartition("list").sortWithinPartitions("list")
    return spread.mapInArrow(run, "a bigint, b bigint, list bigint, level int, last int")


def tiled_pairs(rows: DataFrame, group: list[str], member: str, block: int | None = None) -> DataFrame:
    """``(*group, x, y)``: all pairs ``x < y`` of different members of a group, for groups of any size.

    A null group or member makes no pair. A group falls into blocks of about ``block`` members by a hash; a tile is a pair
    of blocks, so one task never meets more than two of them, and the tiles of a large
    group are spread like those of any other.
    """
    once = rows.select(*group, F.col(member).alias("m")).distinct()
    sizes = once.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / (block or LIST_LIMIT)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = once.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("m", F.lit(3)), F.col("blocks")).cast("int"))
    left = placed.select(*group, F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"), F.col("m").alias("p"))
    right = placed.select(*group, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"), F.col("m").alias("q"))
    pairs = left.join(right, [*group, "low", "high"]).where("low < high or p < q")
    return pairs.select(*group, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the distinct ``ids``, which are written once and broadcast if they are few."""
    ids = written(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def similar_pairs(chunks: DataFrame, threshold: float = 0.8, key: str = "chunk_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Pairs of alike texts and the classes of equal shingle sets.

    Returns ``links(a, b, similarity)`` between representatives, ``a < b``, with
    Jaccard similarity of the five-word shingle sets of at least ``threshold``,
    and ``members(chunk_id, rep, set_hash)`` of every text with five words or
    more. A key that occurs twice counts once. Texts that are null, empty or
    short belong to no class. The signature's parameters fit thresholds of 0.6
    and more; smaller ones are refused.
    """
    if threshold < 0.6:
        raise ValueError("the signature is made for thresholds of at least 0.6")
    prints = written(signatures(chunks, key, text), "signatures")
    members = prints.groupBy("chunk_id").agg(F.first("set_hash").alias("set_hash"), F.first("n_shingles").alias("n_shingles"))
    reps = written(prints.groupBy("set_hash", "n_shingles").agg(F.min("chunk_id").alias("rep"), F.first("signature").alias("signature")), "representatives")
    known = chunks.sparkSession.sparkContext.broadcast(frequent_pairs(reps))
    postings = _postings(reps, known)
    found: DataFrame | None = None
    for _ in range(MIN_MATCHES):
        part = written(_expanded(postings), "postings")
        pairs = part.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        long = part.where("b is null").select("list", F.col("a").alias("rep"), "level", "last")
        if not long.take(1):
            break
        long = written(long.join(reps.select("rep", "signature"), "rep"), "long")
        alike = written(_alike(long), "alike")
        found = found.unionByName(_tiled(long.join(alike, "list", "left_semi"), known))
        long = long.join(alike, "list", "left_anti")
        if not long.take(1):
            break
        postings = _further(long, known)
    collisions = written(found.distinct(), "collisions")

    # how often a pair collides over all coordinates is counted from the signatures: lists of several pairs count some collisions only
    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= MIN_MATCHES
                yield batch.select([0, 1]).filter(pa.array(keep))

    ends = collisions.select(F.col("a").alias("rep")).union(collisions.select("b")).distinct()
    needed = _only(reps.select("rep", "signature"), "rep", ends)
    likely = collisions.join(needed.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(needed.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")
    likely = written(likely.mapInArrow(matching, "a bigint, b bigint"), "likely")

    def exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 20):
            values, rows, begin = shingle_sets(batch.column(1))
            offsets = pa.array(np.append(begin, len(values)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))], names=["rep", "shingles"])

    ends = likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct()
    texts = chunks.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text")).where("text is not null")
    sets = _only(texts, "rep", ends).mapInArrow(exact_sets, "rep bigint, shingles array<bigint>")
    sets = written(sets.groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")
    both = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    classes = members.join(reps.select("set_hash", "n_shingles", "rep"), ["set_hash", "n_shingles"]).select("chunk_id", "rep")
    return written(links, "links"), classes


def expand_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of different texts that are linked or have equal shingle sets, ``a < b``.

    Classes of one text, by far the most, take no part in the expansion.
    """
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    several = members.join(copies, "rep", "left_semi").select("chunk_id", "rep")
    several = written(several, "copies")
    equal = tiled_pairs(several, ["rep"], "chunk_id").select(F.col("x").alias("chunk_id_a"), F.col("y").alias("chunk_id_b"))
    left = links.join(several.select(F.col("rep").alias("a"), F.col("chunk_id").alias("xa")), "a", "left")
    both = left.join(several.select(F.col("rep").alias("b"), F.col("chunk_id").alias("xb")), "b", "left")
    p, q = F.coalesce("xa", "a"), F.coalesce("xb", "b")
    across = both.select(F.least(p, q).alias("chunk_id_a"), F.greatest(p, q).alias("chunk_id_b"))
    return across.unionByName(equal)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the least node reachable over ``links(a, b)``.

    Alternating large-star and small-star rounds, each a distributed join written
    to the shared folder, until no edge changes; their number grows with the
    logarithm of the number of nodes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = written(small, "edges")
        if not edges.exceptAll(small).take(1) and not small.exceptAll(edges).take(1):
            break
        edges = small
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def duplicate_groups(chunks: DataFrame, threshold: float = 0.8, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """One row per text: ``(chunk_id, class_id, n_links)``.

    ``class_id`` is the least id of the texts reachable over links, ``n_links``
    the number of other shingle sets that this text's set is linked with. Texts
    of fewer than five words do not appear.
    """
    links, members = similar_pairs(chunks, threshold, key, text)
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(links).withColumnRenamed("node", "rep")
    return members.join(groups, "rep", "left").join(degree, "rep", "left").select("chunk_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
