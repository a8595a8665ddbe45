"""The core queries, each over its whole tables, and the SQL they are checked against.

Queries named ``ext_*`` are additions over the star schema and the event table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.functions.wordpiece import wordpiece_count
from lodestone.operators import chunking, dense, fusion, incremental, locate, navigate, ranking, snippet, sparse
from lodestone.plans.corpus import corpus, corpus_rows, documents_as_chunks, float_vectors, int8_vectors, table
from lodestone.plans.index import Index
from lodestone.sources import bundle, scan
from lodestone.sources.embedders import HashEmbedder
from lodestone.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

QUESTION = "how does the scheduler flush the pending queue"
SYMBOL = "flushPlannerBackend"
KEYWORDS = "parser token buffer registry"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks (DuckDB) ---------------------------------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS = "corpus AS (SELECT DISTINCT chunk_id, concat_ws('/', repo, file_path) AS file_path, start_line, end_line, language, content FROM chunks)"


def sql_parts(t: str) -> str:
    """identifier_parts of an expression: the lookahead of the case runs becomes a cut beforehand."""
    by_case = f"list_transform(regexp_extract_all(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    by_score = f"list_filter(string_split(lower({t}), '_'), lambda p: p <> '')"
    parts = f"(CASE WHEN contains({t}, '_') THEN {by_score} ELSE {by_case} END)"
    return f"(CASE WHEN len({parts}) >= 2 THEN list_concat([lower({t})], {parts}) ELSE [lower({t})] END)"


def sql_tokens(t: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({t}, ''), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda tok: {sql_parts('tok')}))"


def sql_stem(p: str) -> str:
    return f"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '\\.[^.]*$', '')"


def sql_enriched(content: str = "content", path: str = "file_path") -> str:
    dirs = f"list_filter(string_split({path}, '/')[:-2], lambda d: d NOT IN ('', '.', '..'))"
    last = f"array_to_string({dirs}[greatest(len({dirs}) - 2, 1):], ' ')"
    return f"concat_ws(' ', coalesce({content}, ''), {sql_stem(path)}, {sql_stem(path)}, {last})"


def sql_bm25(query_: str, body: str, chunks: str = "corpus", where: str = "TRUE") -> str:
    """CTEs up to ``scored(chunk_id, file_path, score)``."""
    terms = ", ".join(q(t) for t in dict.fromkeys(query_.lower().split()))  # plain words
    return f"""toks AS (SELECT chunk_id, language, file_path, {sql_tokens(body)} AS t FROM {chunks}),
        stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM toks),
        post AS (SELECT chunk_id, language, file_path, len(t) AS dl, unnest([{terms}]) AS term, t FROM toks),
        tf AS (SELECT chunk_id, language, file_path, dl, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM post),
        df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE tf > 0 GROUP BY term),
        scored AS (SELECT chunk_id, file_path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS score
                   FROM tf JOIN df USING (term), stats WHERE tf > 0 AND {where} GROUP BY chunk_id, file_path)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- text functions -------------------------------------------------------------------------------------------
IDENTIFIERS = ["foo", "foo_bar", "FooBar", "XMLParser", "getHTTPResponse", "HandlerStack", "my_func", "_x", "HTTP2Server", "__init__", "a1B2", "snake_CaseMix", "ABc", "x"]


@query(f"SELECT x AS identifier, array_to_string({sql_parts('x')}, ' ') AS parts FROM (SELECT unnest([{', '.join(map(q, IDENTIFIERS))}]) AS x)")
def split_identifier(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in IDENTIFIERS], "identifier string")
    return rows.select("identifier", F.array_join(text.identifier_parts(F.col("identifier")), " ").alias("parts"))


@query(f"WITH {CORPUS} SELECT chunk_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT chunk_id, {sql_tokens('content')} AS t FROM corpus)")
def tokenize_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sparse.chunk_tokens(corpus_rows(spark, d), enrich=False).select("chunk_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")).distinct()


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"WITH {CORPUS} SELECT chunk_id, md5({sql_enriched()}) AS enriched_md5 FROM corpus")
def enriched_text(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rows(spark, d).select("chunk_id", F.md5(sparse.enriched(F.col("content"), F.col("file_path"))).alias("enriched_md5")).distinct()


# --- keyword retrieval ----------------------------------------------------------------------------------------
_POSTINGS = f"WITH {CORPUS}, p AS (SELECT chunk_id, unnest({sql_tokens(sql_enriched())}) AS term FROM corpus)"


@query(f"{_POSTINGS} SELECT term, chunk_id, count(*)::INT AS tf FROM p GROUP BY term, chunk_id")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return sparse.postings(sparse.chunk_tokens(corpus_rows(spark, d)))


@query(f"{_POSTINGS} SELECT term, count(DISTINCT chunk_id) AS df FROM p GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.document_frequency(sparse.postings(sparse.chunk_tokens(corpus_rows(spark, d))))


@query(f"WITH {CORPUS}, t AS (SELECT len({sql_tokens(sql_enriched())}) AS dl FROM corpus) SELECT count(*) AS n_chunks, round(avg(dl), 6) AS avg_len, max(dl)::INT AS max_len FROM t")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sparse.length_stats(sparse.lengths(sparse.chunk_tokens(corpus_rows(spark, d)))), "avg_len")


_TOP = "SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, chunk_id LIMIT {k}"
_DOCS = "docs AS (SELECT doc_id AS chunk_id, lang AS language, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id || '.txt' AS file_path, text AS content FROM documents)"


@query(f"WITH {_DOCS}, {sql_bm25(QUESTION, 'content', 'docs')} {_TOP.format(k=10)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sparse.top_k(sparse.scan_scores(documents_as_chunks(spark, d), QUESTION, enrich=False), 10), "score")


@query(f"WITH {CORPUS}, {sql_bm25(KEYWORDS, sql_enriched())} {_TOP.format(k=20)}")
def bm25_chunks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sparse.top_k(sparse.scan_scores(corpus_rows(spark, d), KEYWORDS), 20), "score")


@query(f"WITH {CORPUS}, {sql_bm25(KEYWORDS, sql_enriched())} {_TOP.format(k=20)}")
def bm25_from_index(spark: SparkSession, d: str) -> DataFrame:
    """The same through postings and lengths."""
    tokens = sparse.chunk_tokens(corpus_rows(spark, d))
    return rounded(sparse.top_k(sparse.index_scores(sparse.postings(tokens), sparse.lengths(tokens), KEYWORDS), 20), "score")


@query(f"WITH {CORPUS}, {sql_bm25(KEYWORDS, sql_enriched(), where=chr(10).join(['language = ' + q('go')]))} {_TOP.format(k=20)}")
def bm25_filtered_language(spark: SparkSession, d: str) -> DataFrame:
    """Statistics stay global; the filter binds the result."""
    return rounded(sparse.top_k(sparse.scan_scores(corpus_rows(spark, d), KEYWORDS, selected=navigate.selection(["go"])), 20), "score")


# --- literal search ---------------------------------------------------------------------------------------------
def sql_hits(test: str, extra: str = "TRUE") -> str:
    return f"""WITH {CORPUS}, l AS (SELECT chunk_id, file_path, start_line, string_split(content, chr(10)) AS lines FROM corpus WHERE {extra}),
        e AS (SELECT chunk_id, file_path, start_line, lines, unnest(lines) AS text, unnest(range(len(lines))) AS i FROM l),
        hits AS (SELECT chunk_id, file_path, (start_line + i)::INT AS line, text, lines, i::INT AS i, start_line FROM e WHERE {test}
                 QUALIFY row_number() OVER (PARTITION BY file_path, start_line + i ORDER BY chunk_id) = 1)"""


NEEDLE = "manifest"


@query(sql_hits(f"contains(text, {q(NEEDLE)})") + " SELECT file_path, line, text FROM hits")
def locate_lines(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(corpus_rows(spark, d), NEEDLE).select("file_path", "line", "text")


@query(sql_hits(f"contains(text, {q(NEEDLE)})") + " SELECT count(*) AS n, count(DISTINCT file_path) AS files, false AS truncated FROM hits")
def locate_count(spark: SparkSession, d: str) -> DataFrame:
    return locate.summary(locate.locate(corpus_rows(spark, d), NEEDLE))


@query(sql_hits(f"contains(text, {q(NEEDLE)})") + " SELECT file_path, line FROM hits ORDER BY chunk_id, line LIMIT 25")
def locate_locations_limit(spark: SparkSession, d: str) -> DataFrame:
    return locate.shown(locate.locate(corpus_rows(spark, d), NEEDLE), "locations", 25)


@query(sql_hits("contains(lower(text), 'tokenbudget') OR contains(lower(text), 'ledger')") + " SELECT file_path, line, text FROM hits")
def locate_ignore_case(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(corpus_rows(spark, d), ["TokenBudget", "LEDGER"], ignore_case=True).select("file_path", "line", "text")


@query(sql_hits("regexp_matches(text, 'rule|Rule|RULE')") + " SELECT file_path, line, text FROM hits")
def locate_variants(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(corpus_rows(spark, d), "rule", variants=True).select("file_path", "line", "text")


@query(sql_hits(f"contains(text, {q(NEEDLE)})", r"regexp_matches(file_path, '(?:^|/)[^/]*\.go$') AND NOT regexp_matches(file_path, '^(?:[^/]*/)?tests/[^/]*/[^/]*$')") + " SELECT file_path, line FROM hits")
def locate_glob(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(corpus_rows(spark, d), NEEDLE, include=["*.go"], exclude=["tests/*/*"]).select("file_path", "line")


@query(sql_hits(f"contains(text, {q(NEEDLE)})") + " SELECT file_path, line, array_to_string(lines[greatest(i - 2, 0) + 1 : i + 3], '|') AS context, (start_line + greatest(i - 2, 0))::INT AS context_start_line FROM hits")
def locate_context(spark: SparkSession, d: str) -> DataFrame:
    return locate.locate(corpus_rows(spark, d), NEEDLE, context=2).select("file_path", "line", F.array_join("context", "|").alias("context"), "context_start_line")


@query("SELECT unnest(['tensorQueue', 'TensorQueue', 'tensor_queue', 'tensor-queue', 'TENSOR_QUEUE']) AS variant")
def identifier_variants(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in locate.needles_of("tensorQueue", True)], "variant string")


# --- vectors -----------------------------------------------------------------------------------------------------
_FIRST = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_KNN = "1 - list_inner_product(embedding::DOUBLE[], q)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The query is one vector of the table."""
    return list(float_vectors(spark, d).where("chunk_id = 0").first()["embedding"])


@query(f"WITH {_FIRST} SELECT vec_id AS chunk_id, round({_KNN}, 6) AS distance FROM embeddings, qv ORDER BY round({_KNN}, 9), vec_id LIMIT 10")
def knn_float(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dense.nearest(float_vectors(spark, d), _query_vector(spark, d), 10), "distance")


@query(f"WITH {_FIRST} SELECT vec_id AS chunk_id, round({_KNN}, 6) AS distance FROM embeddings, qv WHERE label = 3 ORDER BY round({_KNN}, 9), vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dense.nearest(float_vectors(spark, d), _query_vector(spark, d), 10, selected=F.col("label") == 3), "distance")


_INT8 = "v AS (SELECT chunk_id, any_value(codes)::DOUBLE[] AS c, any_value(scale)::DOUBLE AS s FROM vectors WHERE len(codes) = 256 GROUP BY chunk_id)"


@query(
    f"""WITH {_INT8}, a AS (SELECT min(chunk_id) AS chunk_id FROM v), qv AS (SELECT c AS qc, s AS qs FROM v JOIN a USING (chunk_id)),
    d AS (SELECT chunk_id, 1 - list_inner_product(c, qc) * s * qs AS distance FROM v, qv)
    SELECT chunk_id, round(distance, 6) AS distance FROM d ORDER BY round(distance, 9), chunk_id LIMIT 10"""
)
def knn_int8(spark: SparkSession, d: str) -> DataFrame:
    """Nearest by integer dot product times both scales; the query is the row of the smallest id."""
    rows = int8_vectors(spark, d)
    first = rows.orderBy("chunk_id").first()
    literal = F.array(*[F.lit(int(c)) for c in first["codes"]])
    whole = F.aggregate(F.zip_with("codes", literal, lambda x, y: x.cast("int") * y), F.lit(0), lambda s, x: s + x)
    distance = 1 - whole * F.col("scale").cast("double") * F.lit(float(first["scale"]))
    return rounded(dense.nearest(rows, list(first["codes"]), 10, distance, vector="codes"), "distance")


@query(
    """WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS mx FROM embeddings),
    c AS (SELECT vec_id, mx, list_transform(embedding, lambda x: CASE WHEN mx > 0 THEN greatest(-127, least(127, round((x * (127::FLOAT / mx)::FLOAT)::FLOAT::DOUBLE)::INT)) ELSE 0 END) AS codes FROM m)
    SELECT vec_id AS chunk_id, array_to_string(codes, ',') AS codes, round(CASE WHEN mx > 0 THEN (mx / 127::FLOAT)::FLOAT ELSE 1 END::DOUBLE, 9) AS scale FROM c"""
)
def quantize_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = float_vectors(spark, d).select("chunk_id", dense.quantize(F.col("embedding")).alias("x"))
    return rows.select("chunk_id", F.array_join("x.codes", ",").alias("codes"), F.round(F.col("x.scale").cast("double"), 9).alias("scale"))


@query(
    f"""WITH {_INT8}, f AS (SELECT chunk_id, list_transform(c, lambda x: x * s) AS f FROM v), n AS (SELECT chunk_id, f, sqrt(list_inner_product(f, f)) AS n FROM f)
    SELECT chunk_id, round(CASE WHEN n > 0 THEN list_sum(list_transform(f, lambda x: x / n)) ELSE 0 END, 6) AS sum_unit, round(CASE WHEN n > 0 THEN f[1] / n ELSE 0 END, 6) AS first_unit FROM n"""
)
def dequantize_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = int8_vectors(spark, d).select("chunk_id", dense.dequantize(F.col("codes"), F.col("scale")).alias("u"))
    return rows.select("chunk_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("sum_unit"), F.round(F.col("u")[0], 6).alias("first_unit"))


@query(
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
    SELECT label, (i - 1)::INT AS pos, round(x / n, 6) AS value FROM m JOIN n USING (label)"""
)
def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    pooled = dense.mean_pool(float_vectors(spark, d), ["label"], "embedding")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("pos", "value")), "value")


@query(
    f"""WITH {CORPUS}, {_INT8}, l AS (SELECT v.*, language FROM v JOIN corpus USING (chunk_id)),
    a AS (SELECT * FROM l WHERE language IS NOT NULL ORDER BY chunk_id LIMIT 1),
    d AS (SELECT l.chunk_id, list_inner_product(l.c, a.c) * l.s * a.s AS score FROM l JOIN a ON l.language = a.language AND l.chunk_id <> a.chunk_id)
    SELECT chunk_id, round(score, 6) AS score FROM d ORDER BY round(1 - score, 9), chunk_id LIMIT 5"""
)
def find_related(spark: SparkSession, d: str) -> DataFrame:
    """Nearest chunks of the same language to the first chunk that has a vector and a language."""
    rows = int8_vectors(spark, d).join(corpus(spark, d).select("chunk_id", "language"), "chunk_id")
    anchor = rows.where("language is not null").orderBy("chunk_id").first()
    literal = F.array(*[F.lit(int(c)) for c in anchor["codes"]])
    whole = F.aggregate(F.zip_with("codes", literal, lambda x, y: x.cast("int") * y), F.lit(0), lambda s, x: s + x)
    distance = 1 - whole * F.col("scale").cast("double") * F.lit(float(anchor["scale"]))
    near = dense.nearest(rows, list(anchor["codes"]), 6, distance, (F.col("language") == anchor["language"]) & (F.col("chunk_id") != anchor["chunk_id"]), "codes")
    return rounded(sparse.top_k(dense.as_score(near), 5), "score")


@query(
    f"""WITH {_INT8}, d AS (SELECT a.chunk_id AS query_id, v.chunk_id, 1 - list_inner_product(v.c, a.c) * v.s * a.s AS distance FROM v a, v WHERE a.chunk_id % 50 = 0)
    SELECT query_id, chunk_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) <= 10"""
)
def knn_int8_every50(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 as query against all rows."""
    return rounded(dense.nearest_of_many(int8_vectors(spark, d), 50, 10), "distance")


@query(
    f"""WITH {CORPUS}, {_INT8}, l AS (SELECT v.*, language FROM v JOIN corpus USING (chunk_id)),
    d AS (SELECT a.chunk_id AS query_id, l.chunk_id, list_inner_product(l.c, a.c) * l.s * a.s AS score FROM l JOIN l a ON l.language = a.language AND l.chunk_id <> a.chunk_id WHERE a.chunk_id % 50 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - score, 9), chunk_id) <= 5"""
)
def find_related_every50(spark: SparkSession, d: str) -> DataFrame:
    """Related chunks of every chunk with vector and language whose id is divisible by 50."""
    rows = int8_vectors(spark, d).join(corpus_rows(spark, d).select("chunk_id", "language").dropDuplicates(["chunk_id"]), "chunk_id")
    near = dense.nearest_of_many(rows, 50, 5, related=True)
    return rounded(near.select("query_id", "chunk_id", (1 - F.col("distance")).alias("score")), "score")


# --- fusion: row ids tie documents to vectors ------------------------------------------------------------------
_BM = f"{_DOCS}, {sql_bm25(QUESTION, 'content', 'docs')}, bm AS (SELECT chunk_id, score FROM scored ORDER BY round(score, 9) DESC, chunk_id LIMIT 50)"
_RRF = f"{_BM}, rb AS (SELECT chunk_id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id)) AS score FROM bm)"
_SEM = f"{_FIRST}, sm AS (SELECT vec_id AS chunk_id, 1 - ({_KNN}) AS score FROM embeddings, qv ORDER BY round({_KNN}, 9), vec_id LIMIT 50), rs AS (SELECT chunk_id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id)) AS score FROM sm)"


def sql_fused(alpha: float) -> str:
    return f"WITH {_RRF}, {_SEM}, fu AS (SELECT chunk_id, {alpha} * coalesce(rs.score, 0) + {1 - alpha} * coalesce(rb.score, 0) AS score FROM rs FULL JOIN rb USING (chunk_id))"


def _ranks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keyword = fusion.reciprocal_rank(sparse.scan_scores(documents_as_chunks(spark, d), QUESTION, enrich=False), 50)
    semantic = fusion.reciprocal_rank(dense.as_score(dense.nearest(float_vectors(spark, d), _query_vector(spark, d), 50)), 50)
    return semantic, keyword


@query(f"WITH {_RRF} SELECT chunk_id, round(score, 6) AS score FROM rb")
def rrf_bm25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ranks(spark, d)[1], "score")


@query(sql_fused(0.5) + " SELECT chunk_id, round(score, 6) AS score FROM fu")
def hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.fused(*_ranks(spark, d), ranking.resolve_alpha(QUESTION)), "score")


@query(sql_fused(0.7) + " SELECT chunk_id, round(score, 6) AS score FROM fu")
def hybrid_alpha_explicit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.fused(*_ranks(spark, d), ranking.resolve_alpha(QUESTION, 0.7)), "score")


# --- ranking ------------------------------------------------------------------------------------------------------
_CANDIDATES = f"{CORPUS}, {sql_bm25(KEYWORDS, sql_enriched())}, cand AS (SELECT chunk_id, file_path, score FROM scored ORDER BY round(score, 9) DESC, chunk_id LIMIT 100)"
_COHERED = f"""{_CANDIDATES}, su AS (SELECT *, sum(score) OVER (PARTITION BY file_path) AS fs, row_number() OVER (PARTITION BY file_path ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM cand),
    co AS (SELECT chunk_id, file_path, score + CASE WHEN rn = 1 THEN (SELECT max(score) FROM su) * 0.2 * fs / (SELECT max(fs) FROM su) ELSE 0 END AS score FROM su)"""


#: The penalties once more, for the SQL side only.
_PENALISED = (
    (r"(?:^|/)test_[^/]*\.py$|_test\.(py|go|rb|cpp|c|dart|lua)$|(?:^|/)test_[^/]*\.(cpp|c|dart|lua)$|Tests?\.(java|kt|swift|cs)$|Test\.(php|scala)$|_spec\.(rb|lua)$|\.(test|spec)\.[jt]sx?$|Spec\.(kt|swift|scala)$|Suite\.scala$|(?:^|/)test_helpers?[^/]*\.\w+$|(?:^|/)(tests?|__tests__|spec|testing)(/|$)", 0.3),
    (r"(?:^|/)(__init__\.py|package-info\.java)$", 0.5),
    (r"(?:^|/)(_?compat|legacy)(/|$)", 0.3),
    (r"(?:^|/)(_?examples?|docs?_src)(/|$)", 0.3),
    (r"\.d\.ts$", 0.7),
)


def sql_penalty(p: str) -> str:
    return " * ".join(f"(CASE WHEN regexp_matches({p}, {q(pattern)}) THEN {factor}::DOUBLE ELSE 1::DOUBLE END)" for pattern, factor in _PENALISED)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus_rows(spark, d)
    return ranking.with_chunks(sparse.top_k(sparse.scan_scores(chunks, KEYWORDS), 100), chunks)


@query(f"WITH {_COHERED} SELECT chunk_id, round(score, 6) AS score FROM co")
def file_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.cohere(_candidates(spark, d)).select("chunk_id", "score"), "score")


@query(f"WITH {CORPUS}, f AS (SELECT DISTINCT file_path FROM corpus) SELECT file_path, round({sql_penalty('file_path')}, 6) AS penalty FROM f")
def path_penalty(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rows(spark, d).select("file_path").distinct().select("file_path", F.round(paths.path_penalty(F.col("file_path")), 6).alias("penalty"))


SAMPLE_PATHS = ["src/auth.go", "tests/auth_test.go", "pkg/__init__.py", "legacy/compat/x.py", "docs_src/a.ts", "examples/b.rs", "types/index.d.ts", "test_helpers.rb", "a/FooTests.java", "spec/x_spec.rb", "src/app.test.tsx", "Dockerfile", "README.md", "conf/app.yaml", "x/y.H", "noext", "a.b/c.unknown", "lib/UserSpec.kt"]
_SAMPLE = f"SELECT unnest([{', '.join(map(q, SAMPLE_PATHS))}]) AS file_path"


@query(f"SELECT file_path, round({sql_penalty('file_path')}, 6) AS penalty FROM ({_SAMPLE})")
def path_penalty_golden(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in SAMPLE_PATHS], "file_path string").select("file_path", F.round(paths.path_penalty(F.col("file_path")), 6).alias("penalty"))


_SATURATED = """sa AS (SELECT chunk_id, file_path, score * power(0.5, row_number() OVER (PARTITION BY file_path ORDER BY round(score, 9) DESC, chunk_id) - 1) AS score FROM pe)"""


@query(f"WITH {_CANDIDATES}, pe AS (SELECT chunk_id, file_path, score * {sql_penalty('file_path')} AS score FROM cand), {_SATURATED} SELECT chunk_id, round(score, 6) AS score FROM sa ORDER BY round(score, 9) DESC, chunk_id LIMIT 10")
def file_saturation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.saturated(_candidates(spark, d), 10).select("chunk_id", "score"), "score")


@query(f"WITH {_CANDIDATES} SELECT chunk_id, file_path, round(score, 6) AS score FROM cand QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY round(score, 9) DESC, chunk_id) = 1")
def dedupe_by_file(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.best_per_file(_candidates(spark, d)).select("chunk_id", "file_path", "score"), "score")


@query(f"WITH {_CANDIDATES} SELECT chunk_id, floor(100 * score / (SELECT max(score) FROM cand) + 0.5)::INT AS relevance FROM cand")
def relevance_pct(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relevance(_candidates(spark, d)).select("chunk_id", "relevance")


def sql_keyword_share(p: str, query_: str) -> str:
    import re

    words = sorted({w.lower() for w in re.findall(text.IDENTIFIER, query_) if len(w) > 2 and w.lower() not in text.STOPWORDS})
    parent = f"regexp_extract({p}, '(?:^|/)([^/]*)/[^/]*$', 1)"
    parts = f"list_concat({sql_parts(sql_stem(p))}, CASE WHEN {parent} IN ('', '.', '..') THEN [] ELSE {sql_parts(parent)} END)"
    tests = [f"(CASE WHEN len(list_filter({parts}, lambda p: p = {q(w)} OR (length(p) >= 3 AND starts_with({q(w)}, p)) OR starts_with(p, {q(w)}))) > 0 THEN 1 ELSE 0 END)" for w in words]
    return f"(({' + '.join(tests)})::DOUBLE / {len(words)})"


@query(f"WITH {CORPUS}, f AS (SELECT DISTINCT file_path FROM corpus) SELECT file_path, round({sql_keyword_share('file_path', KEYWORDS)}, 6) AS share FROM f")
def stem_keyword_share(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rows(spark, d).select("file_path").distinct().select("file_path", F.round(ranking.keyword_share(F.col("file_path"), KEYWORDS), 6).alias("share"))


@query(f"WITH {_CANDIDATES}, b AS (SELECT *, {sql_keyword_share('file_path', KEYWORDS)} AS sh, (SELECT max(score) FROM cand) AS mx FROM cand) SELECT chunk_id, round(score + CASE WHEN sh >= 0.1 THEN sh * mx ELSE 0 END, 6) AS score FROM b")
def stem_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    return rounded(ranking.boost_stems(rows, KEYWORDS, ranking.largest(rows)).select("chunk_id", "score"), "score")


#: Small files for the scan.
SCANNED = [
    ("src/auth/login.go", "// uses a session\nfunc login() {}\n"), ("src/router.ts", "export class Router {}\n"), ("package.json", "{}\n"), ("README.md", "# notes\n"),
    ("node_modules/x/index.js", "function hidden() {}\n"), (".git/config", "[core]\n"), ("blank.py", " \n"), ("build/out.go", "package out\n"),
]


_DEFINES = "regexp_matches(content, '(?m)(?:^|\\s)(?:class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract\\s+class|data\\s+class|fn|fun|package|namespace|protocol|record|typedef)\\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*SessionManager(?:\\s|[<({:\\[;]|$)') OR regexp_matches(content, '(?im)(?:^|\\s)(?:CREATE\\s+TABLE|CREATE\\s+VIEW|CREATE\\s+PROCEDURE|CREATE\\s+FUNCTION)\\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*SessionManager(?:\\s|[<({:\\[;]|$)')"
_FLAT = f"replace(lower({sql_stem('file_path')}), '_', '')"
_NAMED = f"regexp_replace({_FLAT}, 's$', '') = 'sessionmanager'"


# --- boosts over the tables: what is asked for is taken from the candidates, as names and stems differ between tables ---
_NEW_NAME = r"(?m)(?:^|\s)(?:class|interface|struct|enum|trait|type|func|function|def|fn)\s+((?:[A-Z][a-z]|[a-z])[a-z]*[A-Z][A-Za-z0-9]+)(?:\s|[<({:\[;]|$)"
_STEM_WORD = "^[a-zA-Z_][a-zA-Z0-9_-]{2,}$"
_PLACE = "where is the entry point"


def sql_defined(rows: str) -> str:
    """CTEs up to ``sym(name)``: the name most often defined in ``rows``."""
    return f"""names AS (SELECT unnest(regexp_extract_all(content, {q(_NEW_NAME)}, 1)) AS name FROM {rows}),
        sym AS (SELECT coalesce((SELECT name FROM names GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), {q(SYMBOL)}) AS name)"""


_TOP100 = f"{_CANDIDATES}, mx AS (SELECT coalesce(max(score), 0) AS mx FROM cand)"
_ASKED = f"{_TOP100}, held AS (SELECT corpus.* FROM corpus JOIN cand USING (chunk_id)), {sql_defined('held')}"
_DEFINES_NAME = _DEFINES.replace("SessionManager", "' || name || '")
_NAMED_SO = f"({_FLAT} = lower(name) OR regexp_replace({_FLAT}, 's$', '') = lower(name))"
_BEGINS = f"(len({_FLAT}) >= 4 AND starts_with(lower(name), {_FLAT}) OR {_FLAT} = lower(name))"


def _defined(rows: DataFrame) -> str:
    names = rows.select(F.explode(F.regexp_extract_all("content", F.lit(_NEW_NAME), F.lit(1))).alias("name"))
    first = names.groupBy("name").count().orderBy(F.desc("count"), "name").first()
    return first["name"] if first else SYMBOL


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    """All chunks, the candidates among them (a hundred rows, read once) and the best score."""
    rows = _candidates(spark, d)
    scored = spark.createDataFrame(rows.collect(), rows.schema)
    return corpus_rows(spark, d).select("chunk_id", "file_path", "content"), scored, ranking.largest(scored)


@query(
    f"""WITH {_ASKED}, t AS (SELECT chunk_id, mx, CASE WHEN {_DEFINES_NAME} THEN CASE WHEN {_NAMED_SO} THEN 4.5 ELSE 3.0 END ELSE 0 END AS tier, {_NAMED_SO} AS named FROM corpus, sym, mx)
    SELECT chunk_id, round(coalesce(cand.score, 0) + tier::DOUBLE * mx, 6) AS score FROM t LEFT JOIN cand USING (chunk_id) WHERE cand.score IS NOT NULL OR (named AND tier * mx <> 0)"""
)
def symbol_definition_boost(spark: SparkSession, d: str) -> DataFrame:
    chunks, scored, best = _held(spark, d)
    return rounded(ranking.boost_symbol_definitions(scored, chunks, _defined(scored), best).select("chunk_id", "score"), "score")


@query(
    f"""WITH {_ASKED}, t AS (SELECT chunk_id, mx, CASE WHEN {_DEFINES_NAME} THEN CASE WHEN {_NAMED_SO} THEN 2.25 ELSE 1.5 END ELSE 0 END AS tier, {_BEGINS} AS near FROM corpus, sym, mx)
    SELECT chunk_id, round(coalesce(cand.score, 0) + tier::DOUBLE * mx, 6) AS score FROM t LEFT JOIN cand USING (chunk_id) WHERE cand.score IS NOT NULL OR (near AND tier * mx <> 0)"""
)
def embedded_symbol_boost(spark: SparkSession, d: str) -> DataFrame:
    chunks, scored, best = _held(spark, d)
    return rounded(ranking.boost_embedded_symbols(scored, chunks, f"who calls {_defined(scored)} first", best).select("chunk_id", "score"), "score")


_HINTS = ", ".join(map(q, sorted(ranking.IMPLEMENTATION_STEMS)))
_GENERIC = ", ".join(map(q, sorted(ranking.GENERIC_STEMS)))
_LOWER_STEM = f"lower({sql_stem('file_path')})"


@query(
    f"""WITH {_TOP100}, s AS (SELECT chunk_id, score, {_LOWER_STEM} AS s FROM cand),
    w AS (SELECT (SELECT s FROM s WHERE regexp_matches(s, {q(_STEM_WORD)}) AND s NOT IN ({_GENERIC}) ORDER BY round(score, 9) DESC, chunk_id LIMIT 1) AS w),
    p AS (SELECT count(*) > 0 AS prefer FROM s, w WHERE s IN ({_HINTS}) AND contains(w, s))
    SELECT chunk_id, round(score + CASE WHEN translate(s, '-_', '') = translate(w, '-_', '') AND NOT (s = w AND prefer AND w NOT IN ({_HINTS})) THEN 0.75 * mx ELSE 0 END, 6)::DOUBLE AS score FROM s, w, p, mx"""
)
def exact_stem_boost(spark: SparkSession, d: str) -> DataFrame:
    """The stem of the best candidate whose stem is a word; ``main`` is too generic to count."""
    _, scored, best = _held(spark, d)
    rows = scored.withColumn("s", F.lower(paths.stem(F.col("file_path")))).where(F.col("s").rlike(_STEM_WORD) & ~F.col("s").isin(sorted(ranking.GENERIC_STEMS)))
    first = rows.orderBy(F.round("score", 9).desc(), "chunk_id").first()
    return rounded(ranking.boost_exact_stems(scored, f"{first['s'] if first else ''} main", best).select("chunk_id", "score"), "score")


@query(
    f"""WITH {_TOP100}, g AS (SELECT chunk_id, mx, CASE WHEN regexp_matches(content, {q(ranking.PACKAGE_ENTRY)}) OR regexp_matches(content, {q(ranking.ENTRY_CODE)}) THEN 2.5 ELSE 0 END AS gain FROM corpus, mx)
    SELECT chunk_id, round(coalesce(cand.score, 0) + gain::DOUBLE * mx, 6) AS score FROM g LEFT JOIN cand USING (chunk_id) WHERE cand.score IS NOT NULL OR gain * mx <> 0"""
)
def location_boost(spark: SparkSession, d: str) -> DataFrame:
    chunks, scored, best = _held(spark, d)
    return rounded(ranking.boost_locations(scored, chunks, _PLACE, best).select("chunk_id", "score"), "score")


@query(f"WITH {_CANDIDATES} SELECT chunk_id, round(score * CASE WHEN regexp_matches(replace(file_path, chr(92), '/'), {q(ranking.INSTALLER_PATH)}) THEN 0.35 ELSE 1 END, 6)::DOUBLE AS score FROM cand")
def installer_penalty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.penalize_installer(_candidates(spark, d), _PLACE).select("chunk_id", "score"), "score")


@query()
def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole search over the chunks and their int8 vectors through an index."""
    chunks = corpus_rows(spark, d)
    index = Index.from_chunks(chunks, vectors=int8_vectors(spark, d).where(F.exists("codes", lambda c: c != 0)), embedder=_FixedQuery())
    return rounded(index.search(KEYWORDS, 10).select("chunk_id", "file_path", "score"), "score")


@query()
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same for a symbol, within one language."""
    index = Index.from_chunks(corpus_rows(spark, d), vectors=int8_vectors(spark, d), embedder=_FixedQuery())
    return rounded(index.search(SYMBOL, 10, languages=["go"]).select("chunk_id", "file_path", "language", "score"), "score")


@query()
def hybrid_filtered_defined(spark: SparkSession, d: str) -> DataFrame:
    """The same for the symbol most often defined in the chunks of a language."""
    chunks = corpus_rows(spark, d)
    index = Index.from_chunks(chunks, vectors=int8_vectors(spark, d), embedder=_FixedQuery())
    symbol = _defined(corpus_rows(spark, d).where(navigate.selection(["typescript"])).select("chunk_id", "content").distinct())
    return rounded(index.search(symbol, 10, languages=["typescript"]).select("chunk_id", "file_path", "language", "score"), "score")


class _FixedQuery(HashEmbedder):
    """A query embedder of the width of the stored vectors."""

    name = "hash-256"

    def __init__(self):
        super().__init__(256)


# --- chunking ---------------------------------------------------------------------------------------------------
def _doc_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), F.lit(None).cast("string").alias("language"), "text")


_FOLD = r"""WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') AS ls FROM documents WHERE text IS NOT NULL),
    s(doc_id, ls, i, now, done) AS (
        SELECT doc_id, ls, 0::BIGINT, '', NULL::VARCHAR FROM l
        UNION ALL
        SELECT doc_id, ls, i + 1,
            CASE WHEN i >= len(ls) THEN '' WHEN now = '' OR strlen(now) + strlen(ls[i + 1]) <= 1500 THEN now || ls[i + 1] ELSE ls[i + 1] END,
            CASE WHEN i >= len(ls) THEN nullif(now, '') WHEN now = '' OR strlen(now) + strlen(ls[i + 1]) <= 1500 THEN NULL ELSE now END
        FROM s WHERE i <= len(ls))"""


@query(_FOLD + " SELECT 'doc_' || doc_id AS file_path, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, strlen(done)::INT AS n_bytes, md5(done) AS content_md5 FROM s WHERE done IS NOT NULL")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy line chunks by a fold inside the engine."""
    return chunking.line_chunks_folded(_doc_files(spark, d)).select("file_path", "pos", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("content_md5"))


@query(
    _FOLD
    + """, c AS (SELECT 'doc_' || doc_id AS file_path, i, done, sum(strlen(done) - strlen(replace(done, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) - (strlen(done) - strlen(replace(done, chr(10), ''))) AS before FROM s WHERE done IS NOT NULL)
    SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY i) - 1)::INT AS pos, (1 + before)::INT AS start_line, (1 + before + strlen(done[:-2]) - strlen(replace(done[:-2], chr(10), '')))::INT AS end_line FROM c WHERE regexp_matches(done, '[^\\x09-\\x0d\\x20]')"""
)
def chunk_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Line chunks with their lines, blank ones left out."""
    return chunking.chunk_files(_doc_files(spark, d), how="lines").select("file_path", "pos", "start_line", "end_line")


@query(
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, text, unnest(range(CASE WHEN n <= 1300 THEN 1 ELSE 1 + ceil((n - 1300) / 1180.0)::BIGINT END)) AS win_pos FROM d)
    SELECT doc_id AS chunk_id, win_pos::INT AS win_pos, md5(text[win_pos * 1180 + 1 : win_pos * 1180 + 1300]) AS text_md5 FROM w"""
)
def embedding_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.embedding_windows(documents_as_chunks(spark, d)).select("chunk_id", "win_pos", F.md5("text").alias("text_md5"))


@query()
def structural_units(spark: SparkSession, d: str) -> DataFrame:
    """Structural chunks of every chunk's content, taken as a file of its language."""
    files = corpus_rows(spark, d).select(F.concat_ws("#", "file_path", "chunk_id").alias("file_path"), paths.language_of(F.col("file_path")).alias("language"), F.col("content").alias("text"))
    return chunking.chunk_files(files).select("file_path", "pos", "start_line", "end_line", F.octet_length("content").alias("n_bytes")).distinct()


@query()
def tree_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the parser where it knows the language."""
    files = corpus_rows(spark, d).select(F.concat_ws("#", "file_path", "chunk_id").alias("file_path"), paths.language_of(F.col("file_path")).alias("language"), F.col("content").alias("text"))
    return chunking.chunk_files(files, how="tree").select("file_path", "pos", "start_line", "end_line", F.octet_length("content").alias("n_bytes")).distinct()


@query()
def wordpiece_counts(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = [r[0] for r in table(spark, d, "wordpiece_vocab").select("token").collect()]  # a vocabulary file
    docs = table(spark, d, "documents")
    return docs.select("doc_id", wordpiece_count(spark, F.col("text"), vocabulary).alias("n_tokens"))


# --- navigation ---------------------------------------------------------------------------------------------------
_PLACES = "places AS (SELECT DISTINCT file_path, start_line + 3 AS line FROM corpus)"


@query(
    f"""WITH {CORPUS}, {_PLACES}, m AS (SELECT p.file_path, p.line, c.chunk_id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY (c.end_line = p.line)::INT, c.chunk_id) AS r
    FROM places p JOIN corpus c ON c.file_path = p.file_path AND p.line BETWEEN c.start_line AND c.end_line)
    SELECT p.file_path, p.line, m.chunk_id FROM places p LEFT JOIN m ON m.file_path = p.file_path AND m.line = p.line AND m.r = 1"""
)
def resolve_chunk(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus_rows(spark, d).drop("content").distinct()
    return navigate.resolve_many(chunks, chunks.select("file_path", (F.col("start_line") + 3).alias("line")))


_BIGGEST = "big AS (SELECT file_path FROM corpus GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)"


def _biggest(chunks: DataFrame) -> str:
    return chunks.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").first()["file_path"]


@query(f"WITH {CORPUS}, {_BIGGEST} SELECT chunk_id, start_line, end_line FROM corpus JOIN big USING (file_path)")
def chunks_for_file(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus_rows(spark, d).drop("content").distinct()
    return navigate.chunks_of_file(chunks, _biggest(chunks)).select("chunk_id", "start_line", "end_line")


@query(
    f"""WITH {CORPUS}, {_BIGGEST}, n AS (SELECT corpus.*, row_number() OVER (ORDER BY start_line, chunk_id) AS r FROM corpus JOIN big USING (file_path)),
    l AS (SELECT start_line + 1 AS line FROM n WHERE r = 3), a AS (SELECT r AS a FROM n, l WHERE line BETWEEN start_line AND end_line ORDER BY (end_line = line)::INT, chunk_id LIMIT 1)
    SELECT chunk_id, start_line, r = a AS is_anchor FROM n, a WHERE r BETWEEN a - 1 AND a + 1"""
)
def expand_neighbors(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus_rows(spark, d).drop("content").distinct()
    path = _biggest(chunks)
    third = navigate.chunks_of_file(chunks, path).limit(3).orderBy(F.desc("start_line"), F.desc("chunk_id")).first()
    return navigate.expand(chunks, path, third["start_line"] + 1).select("chunk_id", "start_line", "is_anchor")


_SN = ("flush", "pending", "queue", "scheduler")


@query(
    f"""WITH {CORPUS}, l AS (SELECT *, string_split(coalesce(content, ''), chr(10)) AS lines FROM corpus),
    s AS (SELECT *, list_transform(lines, lambda x: {' + '.join(f"contains(lower(x), {q(t)})::INT" for t in _SN)}) AS sc FROM l),
    a AS (SELECT *, list_position(sc, list_max(sc)) - 1 AS pos FROM s),
    b AS (SELECT *, greatest(pos - 3, 0) AS f, least(pos + 3, len(lines) - 1) AS t FROM a)
    SELECT chunk_id, (start_line + pos)::INT AS anchor_line, (f > 0 OR t < len(lines) - 1) AS truncated, (CASE WHEN f > 0 OR t < len(lines) - 1 THEN start_line + f ELSE start_line END)::INT AS start_line,
        (CASE WHEN f > 0 OR t < len(lines) - 1 THEN start_line + t ELSE end_line END)::INT AS end_line, md5(CASE WHEN f > 0 OR t < len(lines) - 1 THEN array_to_string(lines[f + 1 : t + 1], chr(10)) ELSE content END) AS content_md5 FROM b"""
)
def snippet_trim(spark: SparkSession, d: str) -> DataFrame:
    return snippet.snippets(corpus_rows(spark, d), QUESTION, 3).select("chunk_id", "anchor_line", "truncated", "start_line", "end_line", F.md5("content").alias("content_md5")).distinct()


@query(f"WITH {CORPUS} SELECT chunk_id, file_path || ':' || start_line || ':' || end_line AS key, file_path || ':' || start_line || '-' || end_line AS location FROM corpus")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    p, a, b = F.col("file_path"), F.col("start_line"), F.col("end_line")
    return corpus_rows(spark, d).select("chunk_id", navigate.chunk_key(p, a, b).alias("key"), navigate.location(p, a, b).alias("location")).distinct()


@query(f"WITH {CORPUS} SELECT chunk_id FROM corpus WHERE language IN ('go', 'python') AND starts_with(file_path, 'meridian-monorepo/')")
def filter_selector(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rows(spark, d).where(navigate.selection(["go", "python"], ["meridian-monorepo/"])).select("chunk_id").distinct()


# --- sources --------------------------------------------------------------------------------------------------------
_EXT = r"lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '(\.[^.]*)$', 1))"
_LANG = """MAP {
    '.py': 'python', '.pyi': 'python', '.js': 'javascript', '.mjs': 'javascript', '.cjs': 'javascript', '.jsx': 'javascript', '.ts': 'typescript', '.tsx':
    'typescript', '.mts': 'typescript', '.cts': 'typescript', '.go': 'go', '.rs': 'rust', '.java': 'java', '.kt': 'kotlin', '.kts': 'kotlin', '.c': 'c',
    '.h': 'cpp', '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp', '.hpp': 'cpp', '.hh': 'cpp', '.hxx': 'cpp', '.h++': 'cpp', '.cs': 'csharp', '.rb': 'ruby',
    '.php': 'php', '.swift': 'swift', '.scala': 'scala', '.clj': 'clojure', '.cljs': 'clojure', '.ex': 'elixir', '.exs': 'elixir', '.erl': 'erlang',
    '.hs': 'haskell', '.lua': 'lua', '.sh': 'bash', '.bash': 'bash', '.zsh': 'bash', '.fish': 'fish', '.sql': 'sql', '.r': 'r', '.dart': 'dart', '.zig':
    'zig', '.vue': 'vue', '.svelte': 'svelte', '.md': 'markdown', '.mdx': 'markdown', '.rst': 'rst', '.txt': 'text', '.json': 'json', '.yaml': 'yaml',
    '.yml': 'yaml', '.toml': 'toml', '.ini': 'ini', '.cfg': 'ini', '.xml': 'xml', '.html': 'html', '.css': 'css', '.scss': 'scss', '.less': 'less',
    '.dockerfile': 'dockerfile'}"""
_CONT = """MAP {
    '.py': 'code', '.pyi': 'code', '.js': 'code', '.mjs': 'code', '.cjs': 'code', '.jsx': 'code', '.ts': 'code', '.tsx': 'code', '.mts': 'code', '.cts':
    'code', '.go': 'code', '.rs': 'code', '.java': 'code', '.kt': 'code', '.kts': 'code', '.c': 'code', '.h': 'code', '.cpp': 'code', '.cc': 'code',
    '.cxx': 'code', '.hpp': 'code', '.hh': 'code', '.hxx': 'code', '.cs': 'code', '.rb': 'code', '.php': 'code', '.swift': 'code', '.scala': 'code',
    '.lua': 'code', '.sh': 'code', '.bash': 'code', '.zsh': 'code', '.sql': 'code', '.dart': 'code', '.zig': 'code', '.vue': 'code', '.svelte': 'code',
    '.md': 'docs', '.mdx': 'docs', '.rst': 'docs', '.txt': 'docs', '.json': 'config', '.yaml': 'config', '.yml': 'config', '.toml': 'config', '.ini':
    'config', '.cfg': 'config', '.xml': 'config'}"""


@query(f"WITH {CORPUS}, f AS (SELECT DISTINCT file_path FROM corpus UNION {_SAMPLE}) SELECT file_path, CASE WHEN lower(regexp_extract(file_path, '([^/]*)$', 1)) = 'dockerfile' THEN 'dockerfile' ELSE {_LANG}[{_EXT}] END AS language, {_CONT}[{_EXT}] AS content_type FROM f")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus_rows(spark, d).select("file_path").union(spark.createDataFrame([(p,) for p in SAMPLE_PATHS], "file_path string")).distinct()
    return rows.select("file_path", paths.language_of(F.col("file_path")).alias("language"), paths.content_type_of(F.col("file_path")).alias("content_type"))


@query(
    f"""WITH s AS (SELECT DISTINCT repo, file_path, size_bytes FROM source_files)
    SELECT repo, file_path, size_bytes FROM s WHERE NOT regexp_matches(file_path, '(?:^|/)(?:\\.git|node_modules|vendor|dist|build)/') AND {_CONT}[{_EXT}] IN ('code', 'config') AND coalesce(size_bytes, 0) <= 1000000"""
)
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return scan.accepted(table(spark, d, "source_files").select("repo", "file_path", "size_bytes").distinct())


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({q(p)}, {q(e)}, {q(k)}, {q(g)}, {len(t)}::BIGINT, {q(t)})" for (p, t), (e, k, g) in zip(SCANNED, ((".go", "code", "go"), (".ts", "code", "typescript"), (".json", "config", "json"))))
    + ") t(file_path, ext, content_type, language, size_bytes, text)"
)
def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """A folder of small files read back through the scan; its files are written here into the shared folder."""
    root = f"{shared_dir(spark)}/scan-{os.urandom(6).hex()}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    system = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, content in SCANNED:
        out = system.create(fs_path(f"{root}/{path}"))
        out.write(bytearray(content.encode()))
        out.close()
    return scan.read_folder(spark, str(system.makeQualified(fs_path(root))), ("code", "config")).select("file_path", "ext", "content_type", "language", "size_bytes", "text")


# --- maintenance ------------------------------------------------------------------------------------------------------
_CHANGED = "ch AS (SELECT DISTINCT file_path FROM corpus WHERE contains(file_path, '/lib/'))"


@query(
    f"""WITH {CORPUS}, {_CHANGED}, kept AS (SELECT chunk_id, file_path, start_line FROM corpus WHERE file_path NOT IN (SELECT file_path FROM ch)),
    fresh AS (SELECT file_path, start_line, row_number() OVER (ORDER BY file_path, start_line) AS r FROM (SELECT DISTINCT file_path, 1 AS start_line FROM ch))
    SELECT * FROM kept UNION ALL SELECT (SELECT max(chunk_id) FROM corpus) + r, file_path, start_line FROM fresh"""
)
def incremental_apply(spark: SparkSession, d: str) -> DataFrame:
    """Files below lib are replaced by one new chunk each."""
    chunks = corpus(spark, d)
    changed = chunks.where(F.contains("file_path", F.lit("/lib/"))).select("file_path").distinct()
    fresh = changed.select(F.lit(0).cast("bigint").alias("chunk_id"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("language"), F.lit("new").alias("content"))
    return incremental.apply_changes(chunks, changed, fresh).select("chunk_id", "file_path", "start_line")


_LISTING = "(SELECT concat_ws('/', repo, file_path) AS file_path, max(mtime_ms) AS mtime_ms, max(size_bytes) AS size_bytes FROM source_files GROUP BY 1)"


@query(
    f"""WITH a AS (SELECT * FROM {_LISTING} WHERE NOT contains(file_path, '/api/')), b AS (SELECT file_path, mtime_ms + CASE WHEN contains(file_path, '/cmd/') THEN 1 ELSE 0 END AS mtime_ms, size_bytes FROM {_LISTING} WHERE NOT contains(file_path, '/tests/'))
    SELECT file_path, CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (file_path)
    WHERE a.file_path IS NULL OR b.file_path IS NULL OR a.mtime_ms IS DISTINCT FROM b.mtime_ms OR a.size_bytes IS DISTINCT FROM b.size_bytes"""
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Two listings that differ by folders added, removed and touched."""
    rows = table(spark, d, "source_files").groupBy(F.concat_ws("/", "repo", "file_path").alias("file_path")).agg(F.max("mtime_ms").alias("mtime_ms"), F.max("size_bytes").alias("size_bytes"))
    before = rows.where(~F.contains("file_path", F.lit("/api/")))
    now = rows.where(~F.contains("file_path", F.lit("/tests/"))).withColumn("mtime_ms", F.col("mtime_ms") + F.contains("file_path", F.lit("/cmd/")).cast("int"))
    return incremental.changed_files(before, now)


@query(
    """SELECT * FROM (VALUES ('same', true), ('other model', false), ('other width', false), ('other storage', false), ('other content', false), ('old epoch', false), ('content in another order', true)) t("case", valid)"""
)
def cache_validity(spark: SparkSession, d: str) -> DataFrame:
    good = {"index_epoch": bundle.cache_epoch(), "embedding_model": "m", "embedding_dimensions": 4, "vector_storage": "int8", "content_type": ["code", "config"]}
    cases = {"same": {}, "other model": {"embedding_model": "x"}, "other width": {"embedding_dimensions": 5}, "other storage": {"vector_storage": "float32"}, "other content": {"content_type": ["code"]}, "old epoch": {"index_epoch": "0"}, "content in another order": {"content_type": ["config", "code"]}}
    rows = [(name, not bundle.invalid_because(json.loads(json.dumps(good | change)), "m", 4, "int8", ("code", "config"))) for name, change in cases.items()]
    return spark.createDataFrame(rows, "case string, valid boolean")


@query(f"WITH {CORPUS}, {sql_bm25(KEYWORDS, sql_enriched())} {_TOP.format(k=10)}")
def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search over an index that was saved and loaded again."""
    path = f"{shared_dir(spark)}/bundle-{os.urandom(6).hex()}"
    Index.from_chunks(corpus(spark, d), vectors=int8_vectors(spark, d), embedder=_FixedQuery()).save(path)
    return rounded(Index.load(spark, path, _FixedQuery()).keyword(KEYWORDS, 10), "score")


# --- additions over the star schema and events (no counterpart in the retrieval operators) --------------------------
@query(
    """SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session"""
)
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    opened = table(spark, d, "events").select("user_id", "ts", F.when(gap.isNull() | (gap > F.expr("interval 30 minutes")), 1).otherwise(0).alias("new"))
    rows = opened.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), o AS (SELECT * FROM events WHERE event_type <> (SELECT min(event_type) FROM events))
    SELECT o.event_id, max(p.ts) AS last_ts FROM o LEFT JOIN p ON p.user_id = o.user_id AND p.ts <= o.ts GROUP BY o.event_id"""
)
def ext_asof(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier event of the first type per user, by one ordered pass instead of a range join."""
    e = table(spark, d, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("t0")))  # one row
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.crossJoin(first).withColumn("last_ts", F.max(F.when(F.col("event_type") == F.col("t0"), F.col("ts"))).over(w))
    return seen.where("event_type <> t0").select("event_id", "last_ts")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
