import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.wordpiece import WordPiece
from lodestone.llm import token_budget as T
from lodestone.llm.common import tokenizer_folder

VOCABULARY = ["[UNK]", "a", "ab", "abc", "b", "c", "##a", "##b", "##bc", "##c", "##abcd", "ü", "é", "caf", "##e", "_", "!", "字"]

COUNTER, ENCODER = T.WordPieceCounter(VOCABULARY), WordPiece(VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdABCé!_ \n字\x07"), max_size=40))
def test_automaton_counts_like_longest_match(text):
    assert COUNTER.count(text) == ENCODER.count(text)


def test_long_words_are_one_unknown():
    c = T.WordPieceCounter(VOCABULARY)
    assert c.count("a" * 101) == 1 and c.count("a" * 100) == 100 and c.count(None) == 0 and c.count("zzz") == 1


RANKS = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260, b"ca": 261, b"bca": 262}


def merged(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS), default=None)
        if best is None:
            return len(parts)
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("abc"), max_size=30))
def test_byte_pairs_count_like_merging(word):
    assert T.BytePairAutomaton(RANKS).count(word.encode()) == merged(word.encode())


@pytest.mark.skipif(not os.path.isdir(tokenizer_folder()), reason="the public vocabularies are not here")
def test_byte_pairs_count_like_the_public_library():
    import tiktoken

    ranks = T.read_ranks(f"{tokenizer_folder()}/byte_bpe_50k.tiktoken")
    counter = T.BytePairCounter(ranks, T.WORD_PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=T.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["", "hello world's   tokens\n\n12345", "naïve café 漢字 🙂🙂", "fooBarBaz_qux(x)=>{return 0x1F;}", "a" * 3000, "<|endoftext|>", "\t\t  \r\n x"]:
        assert counter.count(text) == len(encoding.encode_ordinary(text))


def test_counts_and_cube(spark):
    rows = [(1, "x", "en", "a ab"), (2, "X", None, None), (3, None, "en", ""), (4, "x", "en", "zzz abc!")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    vocabulary = spark.createDataFrame([(i, t) for i, t in enumerate(VOCABULARY)] + [(99, None)], "token_id int, token string")
    counts = T.wordpiece_tokens(df, "text", vocabulary)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {1: 2, 2: 0, 3: 0, 4: 3}
    cube = {(r["level"], r["source"], r["lang"]): (r["n_records"], r["n_tokens"]) for r in T.token_cube(counts, ["source", "lang"]).collect()}
    assert cube[3, None, None] == (4, 5)
    assert cube[1, "x", None] == (2, 5) and cube[1, "X", None] == (1, 0) and cube[1, None, None] == (1, 0)
    assert cube[0, None, "en"] == (1, 0) and cube[2, None, None] == (1, 0)
    variants = {(r["source_key"], r["source"]): r["n_records"] for r in T.label_variants(counts, "source").collect()}
    assert variants == {("x", "x"): 2, ("x", "X"): 1, (None, None): 1}
    assert T.wordpiece_tokens(df.limit(0), "text", vocabulary).count() == 0


def test_repeated_chunks_count_once(spark):
    df = spark.createDataFrame([(1, "go", "a"), (1, "go", "a"), (2, None, "b")], "chunk_id bigint, language string, content string").withColumn("extra", F.lit(1))
    vocabulary = spark.createDataFrame([(0, "a")], "token_id int, token string")
    assert T.distinct_rows(T.wordpiece_tokens(df, "content", vocabulary)).count() == 2
