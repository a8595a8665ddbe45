"""Token counts per record and their totals per slice.

Two vocabularies can be compiled into automata that count the exact encoding of
a word in time linear in its length, without building the list of identifiers:

* a byte-pair vocabulary: a suffix automaton over the token strings proposes the
  tokens that end at each byte, and the one whose pairing with the last token of
  the prefix before it is *compatible* (the two would not have been merged
  otherwise) is the last token of the exact encoding of that prefix;
* a greedy longest-match vocabulary (WordPiece): a trie whose failure links
  carry the number of tokens that are settled when the link is taken.

Counts of words seen before are kept in a bounded per-worker table.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.wordpiece import WordPiece
from lodestone.llm.common import label_key, text_batches

#: Words whose counts one worker remembers; the table is emptied when full.
REMEMBERED_WORDS = 400_000


class _Remembered(dict):
    """word -> count, computed on first sight."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n


class GreedyAutomaton:
    """Counts longest-match-first pieces of a word; a word that cannot be cut counts 1."""

    def __init__(self, tokens: Iterable[str], prefix: str = "##", max_chars: int = 100):
        self.max_chars = max_chars
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: inside a word
        is_token = [False, False]
        layer = [[0, 1]]
        for token in tokens:
            if not token:
                continue
            inside = token.startswith(prefix) and len(token) > len(prefix)
            node, depth = int(inside), 0
            for ch in token[len(prefix) if inside else 0 :]:
                depth += 1
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    is_token.append(False)
                    while len(layer) <= depth:
                        layer.append([])
                    layer[depth].append(self.next[node][ch])
                node = self.next[node][ch]
            is_token[node] = True
        size = len(self.next)
        self.link: list[int] = [-1] * size
        self.settled: list[int] = [0] * size
        for nodes in layer:
            for node in nodes:
                for ch, child in self.next[node].items():
                    if is_token[child]:
                        self.link[child], self.settled[child] = 1, 1
                        continue
                    at, done = self.link[node], self.settled[node]
                    while at >= 0 and ch not in self.next[at]:
                        done += self.settled[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.settled[child] = self.next[at][ch], done

    def count(self, word: str) -> int:
        if len(word) > self.max_chars:
            return 1
        node, done = 0, 0
        for ch in word:
            while (to := self.next[node].get(ch)) is None:
                if self.link[node] < 0:
                    return 1
                done += self.settled[node]
                node = self.link[node]
            node = to
        while node != 1:
            if self.link[node] < 0:
                return 1
            done += self.settled[node]
            node = self.link[node]
        return done


class WordPieceCounter:
    """Tokens of a text under a lower-casing, accent-stripping WordPiece vocabulary."""

    def __init__(self, tokens: Iterable[str], prefix: str = "##", max_chars: int = 100):
        tokens = list(tokens)
        self._split = WordPiece(tokens, prefix=prefix, max_chars=max_chars).words
        self.words = _Remembered(GreedyAutomaton(tokens, prefix, max_chars).count)

    def count(self, text: str | None) -> int:
        return sum(map(self.words.__getitem__, self._split(text))) if text else 0


class BytePairAutomaton:
    """Exact byte-pair token counts of one pre-token by matching and compatibility checks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            parts = self._merge_below(token, rank)
            if len(parts) == 2:
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank] = pair
                self.joined[pair] = rank
        # automaton over bytes: a state is the longest piece of a token that ends here, and says which tokens end here, longest first
        self.step: list[dict[int, int]] = [{}]
        token_at = {}
        for token, rank in ranks.items():
            if rank not in self.halves:
                continue
            node = 0
            for byte in token:
                nxt = self.step[node].get(byte)
                if nxt is None:
                    nxt = self.step[node][byte] = len(self.step)
                    self.step.append({})
                node = nxt
            token_at[node] = rank
        #: State of the next shorter suffix, longest token that ends in a state (-1: none), next shorter token that ends where a token ends.
        self.back, self.longest, self.shorter = [0] * len(self.step), [-1] * len(self.step), {}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        queue = [0]
        for node in queue:
            for byte, child in self.step[node].items():
                queue.append(child)
                if node:
                    up = self.back[node]
                    while up and byte not in self.step[up]:
                        up = self.back[up]
                    self.back[child] = self.step[up].get(byte, 0)
                below = self.longest[self.back[child]]
                self.longest[child] = token_at.get(child, below)
                if child in token_at:
                    self.shorter[token_at[child]] = below
        self._known: dict[tuple[int, int], bool] = {}

    def _merge_below(self, token: bytes, limit: int) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the exact encoding can hold ``left`` directly before ``right``.

        Undo the latest merges on both sides of the seam, newest first. If two
        neighbours at the seam form a token older than what was undone so far,
        they would have been merged across the seam.
        """
        known = self._known.get((left, right))
        if known is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            known = self._known[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        bound = sys.maxsize
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left = self.halves[left][0] != left
            undo_right = self.halves[right][0] != right
            if not undo_left and not undo_right:
                return True
            if undo_left and (not undo_right or left > right):
                bound, left = left, self.halves[left][1]
            elif undo_right:
                # the left neighbour wins a tie of equal ranks, hence one more
                bound, right = right + 1, self.halves[right][0]

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        if word in self.ranks:
            return 1
        last, n, state = [-1] * (len(word) + 1), [0] * (len(word) + 1), 0
        step, back = self.step, self.back
        for end, byte in enumerate(word, 1):
            while state and byte not in step[state]:
                state = back[state]
            state = step[state].get(byte, 0)
            token = self.longest[state]
            while token >= 0:
                at = end - self.size[token]
                if at == 0 or (last[at] >= 0 and self.compatible(last[at], token)):
                    last[end], n[end] = token, n[at] + 1
                    break
                token = self.shorter[token]
        return n[-1]


class BytePairCounter:
    """Tokens of a text under a byte-level byte-pair vocabulary and its word pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        automaton = BytePairAutomaton(ranks)
        self.words = _Remembered(lambda word: automaton.count(word.encode("utf-8", "surrogatepass")))
        self._split = regex.compile(pattern)

    def count(self, text: str | None) -> int:
        return sum(map(self.words.__getitem__, self._split.findall(text))) if text else 0


#: Fixed value: the word pattern that belongs to the public 50k byte-level vocabularies.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _counts(df: DataFrame, text: str, make: Callable[[], WordPieceCounter | BytePairCounter]) -> DataFrame:
    """``df`` without ``text`` and with ``n_tokens``."""
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).withColumn("n_tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in text_batches(batches):
            n = [counter.count(s.as_py()) for s in batch.column(text)]
            columns = [batch.column(c) for c in kept] + [pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens"])

    return df.mapInArrow(run, schema)


_MADE: dict[object, object] = {}


def _once(key: object, make: Callable[[], object]) -> object:
    """One compiled counter per worker process."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def wordpiece_tokens(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Replace ``text`` by ``n_tokens`` under ``vocabulary(token_id, token)``.

    The vocabulary is a parameter of the operator (a file of some 10^4..10^5
    entries) and goes to the workers as such; more than a million entries are
    refused. Null or empty text counts 0; a text of any length is counted whole.
    """
    tokens = [r[0] for r in vocabulary.select("token").where("token is not null").limit(1_000_001).collect()]
    if len(tokens) > 1_000_000:
        raise ValueError("a vocabulary has at most a million tokens")
    handle = df.sparkSession.sparkContext.broadcast(tokens)
    return _counts(df, text, lambda: _once(("wp", hash(tuple(tokens_of := handle.value)), len(tokens_of)), lambda: WordPieceCounter(handle.value)))


def byte_pair_tokens(df: DataFrame, text: str, ranks_path: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """Replace ``text`` by ``n_tokens`` under a byte-pair vocabulary file read on the driver."""
    handle = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return _counts(df, text, lambda: _once(("bpe", ranks_path, pattern), lambda: BytePairCounter(handle.value, pattern)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Repeated rows, which are identical, count once (compared by hashes, without a sort)."""
    return df.distinct()


def token_cube(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Records and tokens for every combination of ``slices``.

    ``level`` is the grouping id: a set bit says that this column is summed over,
    so a null under an unset bit is a null of the data. Labels keep their
    spelling. Every record enters the cube's shuffle pre-aggregated.
    """
    return counts.cube(*slices).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))


def label_variants(counts: DataFrame, column: str) -> DataFrame:
    """Totals per spelling of a label beside the spelling-independent label."""
    return counts.groupBy(label_key(F.col(column)).alias(f"{column}_key"), F.col(column)).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
