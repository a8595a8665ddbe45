"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import label_key, text_batches, tokenizer_folder, written
from lodestone.llm.fingerprints import mix

#: Uses of a document of a source whose cap is not stated.
DEFAULT_REPEATS = 1
#: Residuals that one task of the reduction tree combines on average.
FAN_IN = 64
MAX_TARGETS = 10_000
#: Documents (four numbers and a label each) of a source that one task settles on average.
GROUP_ROWS = 100_000


def tokenizer_sizes(documents: DataFrame, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, source_key, n_tokens)`` under a public byte-pair vocabulary file.

    Null text has 0 tokens. A document id that occurs twice is measured twice.
    """
    path = ranks_path or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"

    from lodestone.llm.token_budget import WORD_PATTERN, read_ranks

    handle = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=handle.value, special_tokens={})
        for batch in text_batches(batches, 4 << 20):
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "source_key", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), label_key(F.col(source)).alias("source_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, source_key string, n_tokens bigint")


def plan_uses(available: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Expected uses of each document per source.

    Without ``total_tokens`` the total is the largest for which every source that
    has any text meets its share among them exactly. With it, sources that their
    cap keeps below their share give all they may, and the rest of the total goes
    to the others in proportion to their targets.
    """
    caps = {s: available.get(s, 0) * cap for s, (share, cap) in targets.items() if share > 0 and available.get(s, 0) > 0 and cap > 0}
    share = {s: targets[s][0] for s in caps}
    if not caps:
        return {}
    if total_tokens is None:
        whole = sum(share.values())
        total_tokens = min(caps[s] * whole / share[s] for s in caps)
    tokens: dict[str, float] = {}
    open_ = dict(share)
    left = float(total_tokens)
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / whole > caps[s] * (1 + 1e-12)]
        if not full:
            tokens |= {s: min(caps[s], left * w / whole) for s, w in open_.items()}
            break
        for s in full:
            tokens[s] = caps[s]
            left -= caps[s]
            del open_[s]
        left = max(left, 0.0)
    return {s: tokens[s] / available[s] for s in tokens}


def _draws(seed: int, *ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) by documents or pairs of documents."""
    value = np.full(len(ids[0]), seed, np.uint64)
    for part in ids:
        value = mix(part.astype(np.uint64) ^ mix(value))
    return (value >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _paired(p: np.ndarray, among: np.ndarray, sources: np.ndarray, ids: np.ndarray, weights: np.ndarray, seed: int) -> None:
    """Pivotal steps over the open documents of ``among``, all pairs at once, until each source has one at most."""
    for turn in range(64):
        p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
        o = among[(p[among] > 0) & (p[among] < 1)]
        o = o[np.lexsort((ids[o], weights[o], sources[o]))]
        s = sources[o]
        place = np.arange(len(o)) - np.searchsorted(s, s, "left")
        left = np.flatnonzero((place[:-1] % 2 == 0) & (s[1:] == s[:-1]))
        if not len(left):
            return
        a, b = o[left], o[left + 1]
        up = np.minimum(weights[a] * (1 - p[a]), weights[b] * p[b])
        down = np.minimum(weights[a] * p[a], weights[b] * (1 - p[b]))
        move = np.where(_draws(seed + turn, ids[a], ids[b]) * (up + down) < down, up, -down)
        p[a] += move / weights[a]
        p[b] -= move / weights[b]


def settle(sources: np.ndarray, ids: np.ndarray, weights: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    """Round fractional uses until each source (a small number) has one open document at most, a short one where it has short ones.

    Of two documents one gives up probability to the other so that their expected
    tokens stay the same, until one of them is settled at 0 or 1; the direction is
    drawn so that each keeps its expected use. Classes of length (powers of two) are
    settled from the longest on: what a class leaves open is drawn, and the shorter
    documents are planned anew for the tokens this adds or takes, if they can make up
    for both outcomes. Documents without tokens get 0.
    """
    p = np.where(weights > 0, parts, 0.0)
    n = int(sources.max(initial=-1)) + 1
    length = np.log2(np.maximum(weights, 1)).astype(np.int64)
    for c in np.unique(length)[::-1]:
        mine = np.flatnonzero(length == c)
        _paired(p, mine, sources, ids, weights, seed + 100 * int(c))
        o = mine[(p[mine] > 0) & (p[mine] < 1)]
        shorter = np.flatnonzero((length < c) & (p > 0) & (p < 1))
        s = sources[o]
        # each gives way by p(1 - p) of its tokens, up or down alike, so that all keep their expected use
        sway = weights[shorter] * p[shorter] * (1 - p[shorter])
        total = np.bincount(sources[shorter], weights=sway, minlength=n)
        fits = weights[o] * np.maximum(p[o], 1 - p[o]) <= total[s]
        o = o[fits]
        taken = _draws(seed + 7, ids[o]) < p[o]
        gained = np.zeros(n)
        gained[sources[o]] = weights[o] * (taken - p[o])
        p[o] = taken
        change = np.divide(gained, total, out=np.zeros(n), where=total > 0)
        p[shorter] -= change[sources[shorter]] * p[shorter] * (1 - p[shorter])
    _paired(p, np.arange(len(p)), sources, ids, weights, seed + 9_999)
    return p


_STATE = "doc_id bigint, source string, source_key string, n_tokens bigint, base int, part double"


def _rounded(rows: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """``_STATE`` of ``rows`` with their ``expected`` uses, ``part`` being 0 or 1; rows are worked on by source and ``salt``."""
    columns = ["doc_id", "source", "source_key", "n_tokens", "base", "part"]

    def settled(frame: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(frame["source_key"])[0]
        return frame.assign(part=settle(codes, frame["doc_id"].to_numpy(np.int64), frame["n_tokens"].to_numpy(np.float64), frame["part"].to_numpy(np.float64), seed))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.floor(frame["expected"] + 1e-9)
        return settled(frame.assign(base=whole.astype(np.int32), part=np.clip(frame["expected"] - whole, 0, 1))[columns])

    def combined_by(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def combine(frame: pd.DataFrame) -> pd.DataFrame:
            frame = settled(frame[columns])
            if not last:
                return frame
            draw = mix(frame["doc_id"].to_numpy(np.int64).astype(np.uint64) ^ np.uint64(seed + 1)) >> np.uint64(11)
            part = frame["part"].to_numpy()
            up = (draw.astype(np.float64) / float(1 << 53) < part).astype(float)
            return frame.assign(part=np.where((part > 0) & (part < 1), up, part))

        return combine

    narrow = rows.select("doc_id", "source", "source_key", "n_tokens", "expected", "salt")
    state = written(narrow.groupBy("source_key", "salt").applyInPandas(first, _STATE), "mixed")
    done, open_rows = state.where("part = 0 or part = 1"), state.where("part > 0 and part < 1")
    while n := open_rows.count():
        blocks = max(1, n // (FAN_IN * max(1, n_sources)))
        last = blocks == 1

        block = F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(blocks))
        combined = written(open_rows.groupBy("source_key", block.alias("block")).applyInPandas(combined_by(last), _STATE), "mixed")
        done = done.unionByName(combined.where("part = 0 or part = 1"))
        if last:
            break
        open_rows = combined.where("part > 0 and part < 1")
    return done


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Documents with use counts whose tokens per source follow ``targets``, and the shares reached.

    ``sizes(doc_id, source, source_key, n_tokens)``; ``targets(source,
    target_share, max_repeats)``, joined without regard to spelling; of targets
    that fall on one key the shares are added and the smaller cap holds. A cap
    that is null counts as ``DEFAULT_REPEATS``. Documents of sources without a
    target (null sources among them) are left out; sources without documents keep
    a row with share 0 in the second result. Documents without tokens are used
    the whole part of their expected number.

    Every document is used the whole part of the expected number and, by pivotal
    rounding, once more or not. Groups of a source's documents settle all but at most one
    each, long ones first, so that a short one stays open where there
    is one; those residuals are combined by a tree of grouped rounds until one per
    source is left, which is drawn. The tokens of a source deviate from plan by less
    than that document.
    """
    spark = sizes.sparkSession
    wanted = targets.where("source is not null and target_share is not null").groupBy(label_key(F.col("source")).alias("source_key")).agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(DEFAULT_REPEATS))).alias("max_repeats"))
    rows = wanted.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    goal = {r["source_key"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}
    sizes = written(sizes, "sizes")
    inside = sizes.where(F.col("source_key").isin(list(goal)) if goal else F.lit(False))
    there = inside.groupBy("source_key").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    available = {r["source_key"]: int(r["n"] or 0) for r in there}
    groups = {r["source_key"]: -(-r["rows"] // GROUP_ROWS) for r in there}
    uses = plan_uses(available, goal, total_tokens)

    def by_source(values: dict[str, float]) -> Column:
        """A number per source; there are MAX_TARGETS at most."""
        return F.coalesce(F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, float(v))])[F.col("source_key")], F.lit(0.0)) if values else F.lit(0.0)

    # large sources fall into groups of about GROUP_ROWS documents, small ones stay together
    salt = F.pmod(F.xxhash64("doc_id"), F.greatest(by_source(groups).cast("bigint"), F.lit(1)))
    done = _rounded(inside.withColumn("expected", by_source(uses)).withColumn("salt", salt), len(uses), seed)
    chosen = done.select("doc_id", "source", "source_key", "n_tokens", (F.col("base") + F.col("part")).cast("int").alias("uses")).where("uses > 0")
    used = chosen.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
    whole = used.agg(F.sum("used_tokens").alias("whole"))
    have = spark.createDataFrame([(s, t, c, available.get(s, 0), float(uses.get(s, 0.0))) for s, (t, c) in sorted(goal.items())], "source_key string, target_share double, max_repeats int, available_tokens bigint, expected_uses double")
    shares = have.join(used, "source_key", "left").join(F.broadcast(whole)).select(
        "source_key", "target_share", "max_repeats", "available_tokens", "expected_uses", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("whole"), F.lit(0.0)).alias("share")
    )
    return chosen, shares
