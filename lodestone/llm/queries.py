"""The queries of this subpackage, each over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import leakage, mixing, near_dup, neighbours, pieces, pii, provenance, token_budget
from lodestone.llm.common import label_key, table, tokenizer_folder, written

Query = Callable[[SparkSession, str], DataFrame]


def _document_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "domain", "text")
    return token_budget.wordpiece_tokens(rows, "text", table(spark, d, "wordpiece_vocab"))


def _chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "repo", "language", "content")
    return token_budget.distinct_rows(token_budget.wordpiece_tokens(rows, "content", table(spark, d, "wordpiece_vocab")))


def p1_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document and every distinct chunk, with the labels they are totalled by."""
    none = F.lit(None).cast("string")
    documents = _document_tokens(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("record_id"), "source", "lang", "domain", "n_tokens")
    chunks = _chunk_tokens(spark, d).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("record_id"), F.col("repo").alias("source"), F.col("language").alias("lang"), none.alias("domain"), "n_tokens")
    return documents.unionByName(chunks)


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens for every combination of source, language and domain."""
    return token_budget.token_cube(_document_tokens(spark, d), ["source", "lang", "domain"])


def p1_chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks and tokens for every combination of repository and language."""
    return token_budget.token_cube(_chunk_tokens(spark, d), ["repo", "language"])


def p1_label_variants(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per spelling of source and language beside their common key."""
    counts = written(_document_tokens(spark, d), "counts")
    parts = [token_budget.label_variants(counts, c).select(F.lit(c).alias("label"), F.col(f"{c}_key").alias("label_key"), F.col(c).alias("spelling"), "n_records", "n_tokens") for c in ("source", "lang", "domain")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_byte_pair_budget(spark: SparkSession, d: str) -> DataFrame:
    """The cube of ``p1_token_budget`` under a public byte-pair vocabulary."""
    rows = table(spark, d, "documents").select("source", "lang", "domain", "text")
    counts = token_budget.byte_pair_tokens(rows, "text", f"{tokenizer_folder()}/byte_bpe_50k.tiktoken")
    return token_budget.token_cube(counts, ["source", "lang", "domain"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_kinds(table(spark, d, "chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.nearest(table(spark, d, "vectors"), within=0.25))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "vectors"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p3_nearest against the exact join, for every row whose id is divisible by 50."""
    return neighbours.recall(table(spark, d, "vectors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.machine_made(table(spark, d, "chunks")).where("machine_made").select("repo", "file_path")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return provenance.machine_made(table(spark, d, "chunks")).select("repo", "file_path", "notice", "probability", "by_vote", "machine_made")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = near_dup.similar_pairs(table(spark, d, "chunks"), threshold=0.6)
    return near_dup.expand_links(links, members)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.duplicate_groups(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of each leaked item stands in the document."""
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(mixing.tokenizer_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(mixing.tokenizer_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(_redacted(spark, d))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _redacted(spark, d).select("doc_id", "text", F.size("findings").alias("n_findings"))


def queries() -> dict[str, Query]:
    found = [p1_record_tokens, p1_token_budget, p1_chunk_budget, p1_label_variants, p1_byte_pair_budget, p2_found, p2_pieces, p3_found, p3_nearest, p3_recall, p4_found, p4_files, p5_found, p5_groups, p6_found, p6_report, p7_mix, p7_shares, p8_found, p8_redacted]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    # lower-casing with the ligatures and the sharp s that case folding opens
    folded = "lower(text)"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ß", "ss")):
        folded = f"replace({folded}, '{a}', '{b}')"
    words = f"regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+')"
    grams = "unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' ')))"
    return {
        "p6_found": f"""
            WITH i AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, {words} AS w FROM eval_items)),
                 d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words} AS w FROM documents))
            SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)
        """,
        # lines of an oversized chunk: \r\n, \r and \n end a line and count with it
        "p2_found": r"""
            WITH big AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE strlen(content) > 1500),
                 lines AS (SELECT chunk_id, unnest(regexp_extract_all(content, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+')) AS line FROM big)
            SELECT chunk_id, CASE WHEN max(strlen(line)) > 1500 THEN 'inside' ELSE 'line' END AS cut_kind FROM lines GROUP BY chunk_id
        """,
        # classes by a closure over links of at least 0.8 between different shingle sets
        "p5_groups": r"""
            WITH RECURSIVE once AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL),
            words AS (SELECT chunk_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM once),
            shingles AS (
                SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: translate(array_to_string(w[i:i + 4], ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS s
                FROM words WHERE len(w) >= 5),
            member AS (SELECT chunk_id, s, min(chunk_id) OVER (PARTITION BY array_to_string(s, '|')) AS rep FROM shingles),
            sizes AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM member WHERE chunk_id = rep),
            common AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM sizes a JOIN sizes b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
            link AS (SELECT a, b FROM common WHERE k::DOUBLE / (na + nb - k) >= 0.8),
            reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
            least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
            degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
            SELECT chunk_id, least(rep, coalesce(least.b, rep)) AS class_id, coalesce(degree.n, 0)::BIGINT AS n_links
            FROM member LEFT JOIN least ON least.a = rep LEFT JOIN degree ON degree.a = rep
        """,
        "p3_found": """
            WITH usable AS (
                SELECT chunk_id, any_value(codes)::DOUBLE[] AS v FROM vectors
                WHERE len(codes) = 256 AND list_max(list_transform(codes, lambda c: abs(c::INT))) > 0 GROUP BY chunk_id),
            pairs AS (
                SELECT a.chunk_id AS a, b.chunk_id AS b, round(1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 12) AS distance
                FROM usable a JOIN usable b ON a.chunk_id <> b.chunk_id),
            ranked AS (SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM pairs)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM ranked WHERE r <= 5 AND distance <= 0.25
        """,
        "p5_found": r"""
            WITH once AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL),
            words AS (SELECT chunk_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM once),
            shingles AS (
                SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: translate(array_to_string(w[i:i + 4], ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS s
                FROM words WHERE len(w) >= 5),
            sizes AS (SELECT chunk_id, len(s) AS n, unnest(s) AS g FROM shingles),
            common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM sizes a JOIN sizes b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
            SELECT a AS chunk_id_a, b AS chunk_id_b FROM common WHERE k::DOUBLE / (na + nb - k) >= 0.6
        """,
    }
