"""Passages of held-out items inside documents: a join of winnowed fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches, written
from lodestone.llm.fingerprints import grams, unicode_word_hashes, winnow

SPAN_WORDS = 12
GRAM_WORDS = 6
#: Bits of the filter over the items' fingerprints: sixteen for each, within these powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 13, 27
#: Fingerprints with more documents than this are joined in SALTS parts.
HOT_ROWS, SALTS = 200_000, 64

_FINGERPRINTS = "id bigint, hash bigint, around binary"


def _pack(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    hashes = [unicode_word_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    words = np.fromiter((h for one in hashes for h in one), np.uint64, int(sizes.sum()))
    return words, np.repeat(np.arange(len(texts)), sizes)


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each fingerprint, from its upper and its lower half."""
    h = hashes.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (h >> np.uint64(37)) & mask, h & mask


def _fingerprints(texts: DataFrame, span: int, gram: int, outside: int, filter_: tuple | None = None) -> DataFrame:
    """``(id, hash, around)`` of ``texts(id, text)``: each fingerprint with the words up to ``span - gram`` before and after it.

    Equal fingerprints of one text with the same surroundings are one row, so a run
    of one word has a few rows however long it is. ``outside`` stands for words
    beyond the text's ends; ``filter_`` (bits, broadcast words) drops what no item has.
    """
    side, window = span - gram, span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            words, rows = _pack(batch.column(1).to_pylist())
            h, _, at = grams(words, rows, gram)
            kept = winnow(h, rows[at], window)
            h, at = h[kept], at[kept]
            if filter_ is not None:
                bits, held = filter_[0], filter_[1].value
                hit = np.ones(len(h), bool)
                for p in _positions(h, bits):
                    hit &= (held[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
                h, at = h[hit], at[hit]
            if not len(h):
                continue
            place = at[:, None] + np.arange(-side, gram + side)
            inside = (place >= 0) & (place < len(words))
            place = np.clip(place, 0, len(words) - 1)
            around = np.where(inside & (rows[place] == rows[at][:, None]), words[place], np.uint64(outside))
            # one row for equal surroundings within a text
            key = np.zeros(len(at), np.uint64)
            for column in around.T:
                key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            first = np.unique(np.stack([rows[at].astype(np.uint64), key]), axis=1, return_index=True)[1]
            packed = np.ascontiguousarray(around[first])
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1] * 8), len(first), [None, pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at[first]])), pa.array(h[first].view(np.int64)), binary], names=["id", "hash", "around"])

    return texts.where("text is not null").mapInArrow(run, _FINGERPRINTS)


def _filter_words(items: DataFrame) -> tuple[int, np.ndarray]:
    """The filter over the items' fingerprints as 64-bit words: of a bounded size, whatever their number."""
    n = items.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, 16 * n)))))
    mask = (1 << bits) - 1
    at = items.select(F.explode(F.array(F.shiftrightunsigned("hash", 37).bitwiseAND(F.lit(mask)), F.col("hash").bitwiseAND(F.lit(mask)))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits, out


def matches(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = SPAN_WORDS, gram: int = GRAM_WORDS) -> tuple[DataFrame, DataFrame]:
    """Verified ``(doc_id, item_id, hash)`` and the items' fingerprints ``(id, hash, around)``."""
    spark = documents.sparkSession
    side = span - gram
    held = written(_fingerprints(items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")), span, gram, 2), "items")
    bits, words = _filter_words(held)
    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    hits = written(_fingerprints(docs, span, gram, 1, (bits, spark.sparkContext.broadcast(words))), "hits").withColumnRenamed("id", "doc_id").withColumnRenamed("around", "doc_around")
    # fingerprints that a great many documents share are spread over salts, on the other side they stand once per salt
    hot = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("hash", F.lit(True).alias("hot"))
    left = hits.join(hot, "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    right = held.join(hot, "hash", "left").select("hash", F.col("id").alias("item_id"), F.col("around").alias("item_around"), F.explode(copies).alias("salt"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (2 * side + gram) * 8
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, width // 8) for i in (3, 4))
            same = a == b
            before = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            after = np.logical_and.accumulate(same[:, side + gram :], axis=1).sum(axis=1)
            good = same[:, side : side + gram].all(axis=1) & (before + gram + after >= span)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:3]], names=["doc_id", "item_id", "hash"])

    pairs = left.join(right, ["hash", "salt"]).select("doc_id", "item_id", "hash", "doc_around", "item_around")
    return pairs.mapInArrow(verified, "doc_id bigint, item_id bigint, hash bigint"), held


def leaked_items(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id)``: documents holding ``span`` consecutive words of an item as consecutive words.

    Words are the longest runs of letters and digits, case-folded. Both sides
    keep the least hash of ``gram``-word sequences in every window of
    ``span - gram + 1``; a shared span shares such a window and hence a
    fingerprint. Fingerprints are joined, and every shared one is extended by the
    words that it carries from before and after it.

    Documents are read once, whatever the number of items; those of their
    fingerprints that a filter over the items' (of a bounded size) cannot hold are
    dropped at once, so little is shuffled. The planner broadcasts the items' side
    only if it is small when it has been made. Null and short texts have no case;
    repeated ids give one row.
    """
    return matches(documents, items, **options)[0].select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, n_found, n_fingerprints, share, whole)``: how much of a leaked item stands in a document.

    ``share`` is that of the item's different fingerprints that shared spans of the document
    hold; ``whole`` that all do.
    """
    found, held = matches(documents, items, **options)
    own = held.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("hash").alias("n_fingerprints"))
    each = found.groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("n_found"))
    return each.join(own, "item_id").select("doc_id", "item_id", "n_found", "n_fingerprints", (F.col("n_found") / F.col("n_fingerprints")).alias("share"), (F.col("n_found") == F.col("n_fingerprints")).alias("whole"))
