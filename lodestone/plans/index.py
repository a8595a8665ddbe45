"""The index: chunks with keyword and vector tables, and the queries over them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, fusion, incremental, locate, navigate, ranking, snippet, sparse
from lodestone.operators.chunking import chunk_files
from lodestone.sources import bundle, scan, settings
from lodestone.sources.embedders import Embedder, chosen_embedder, embed_chunks

CHUNK_COLUMNS = ("chunk_id", "file_path", "start_line", "end_line", "language", "content")
TOOL_DEFAULT, TOOL_MOST = 3, 10


def tool_top_k(k: int | None) -> int:
    """Three by default and below one, ten at most."""
    return TOOL_DEFAULT if k is None or k < 1 else min(k, TOOL_MOST)


class Index:
    """Tables of one source. All queries are lazy plans over them."""

    def __init__(self, chunks: DataFrame, postings: DataFrame, lengths: DataFrame, vectors: DataFrame, files: DataFrame, embedder: Embedder, content: Sequence[str] = scan.DEFAULT_CONTENT, root: str | None = None, from_disk: bool = False):
        """``vectors`` are ``(chunk_id, codes, scale)`` or, stored as floats, ``(chunk_id, embedding)``."""
        self.chunks, self.postings, self.lengths, self.vectors, self.files = chunks, postings, lengths, vectors, files
        self.embedder, self.content, self.root, self.from_disk = embedder, tuple(content), root, from_disk
        self.stored = from_disk  # whether the postings exist or would have to be made
        self.spark = chunks.sparkSession

    # --- building -----------------------------------------------------------------------------------------
    @classmethod
    def from_chunks(cls, chunks: DataFrame, embedder: Embedder | None = None, vectors: DataFrame | None = None, files: DataFrame | None = None, storage: str | None = None, **more) -> Index:
        """From chunks; rows under one id must be identical and count once; vectors ``(chunk_id, codes, scale)`` are computed if not given."""
        embedder = embedder or chosen_embedder()
        chunks = chunks.select(*CHUNK_COLUMNS)
        tokens = sparse.chunk_tokens(chunks)
        if vectors is None:
            embedded = embed_chunks(chunks, embedder).dropDuplicates(["chunk_id"])
            vectors = embedded if (storage or settings.vector_storage()) == "float32" else embedded.select("chunk_id", dense.quantize(F.col("embedding")).alias("q")).select("chunk_id", "q.codes", "q.scale")
        if files is None:
            files = chunks.groupBy("file_path").agg(F.lit(None).cast("bigint").alias("mtime_ms"), F.lit(None).cast("bigint").alias("size_bytes"))
        return cls(chunks, sparse.postings(tokens), sparse.lengths(tokens), vectors, files.select("file_path", "mtime_ms", "size_bytes"), embedder, **more)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, content: Sequence[str] = (), embedder: Embedder | None = None, storage: str | None = None) -> Index:
        """From a folder of this machine or of a shared store."""
        kinds = scan.resolve_content(content)
        files = scan.read_folder(spark, path, kinds)
        chunks = incremental.next_ids(chunk_files(files), ["file_path", "pos"], -1)
        return cls.from_chunks(chunks, embedder, files=files, storage=storage, content=kinds, root=path)

    @classmethod
    def from_source(cls, spark: SparkSession, source: str, content: Sequence[str] = (), embedder: Embedder | None = None, ref: str | None = None, workspace: str | None = None) -> Index:
        """From a saved bundle that still fits, else from the folder or a clone of the repository."""
        if not source.strip() or not scan.may_read(source) or not scan.in_workspace(source, workspace):
            raise PermissionError(f"source not allowed: {source}")
        embedder, storage = embedder or chosen_embedder(), settings.vector_storage()
        kinds = scan.resolve_content(content)
        listing = None if scan.is_remote(source) else scan.read_folder(spark, source, kinds)
        found = bundle.validated(spark, source, embedder.name, embedder.dimensions, storage, kinds, listing)
        if found:
            return cls.load(spark, found, embedder)
        return cls.from_path(spark, scan.clone(source, ref) if scan.is_remote(source) else source, content, embedder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> Index:
        tables, metadata = bundle.load(spark, path)
        return cls(**tables, embedder=embedder or chosen_embedder(), content=metadata["content_type"], root=metadata.get("root_path"), from_disk=True)

    @property
    def storage(self) -> str:
        return "int8" if "codes" in self.vectors.columns else "float32"

    def save(self, path: str) -> None:
        tables = {t: getattr(self, t) for t in bundle.TABLES}
        bundle.save(path, tables, {"embedding_model": self.embedder.name, "embedding_dimensions": self.embedder.dimensions, "vector_storage": self.storage, "content_type": list(self.content), "root_path": self.root})

    def save_to_cache(self, source: str, force: bool = False) -> None:
        if force or not self.from_disk:
            self.save(bundle.bundle_path(source))

    def cached(self) -> Index:
        """Keep the tables with the session; partitions of a lost executor are computed again."""
        for t in bundle.TABLES:
            getattr(self, t).persist()
        self.stored = True
        return self

    def close(self) -> None:
        for t in bundle.TABLES:
            getattr(self, t).unpersist()

    def apply_changes(self, changed: DataFrame, files: DataFrame) -> Index:
        """A new index after changes to ``changed(file_path)``, with ``files`` as they are now.

        Only new chunks are tokenised and embedded; rows of kept chunks are taken over.
        """
        now = files.join(changed.select("file_path").distinct(), "file_path", "left_semi")
        fresh = chunk_files(scan.accepted(now, self.content)).select("file_path", "start_line", "end_line", "language", "content", "pos")
        chunks = incremental.apply_changes(self.chunks, changed, fresh.drop("pos").withColumn("chunk_id", F.lit(0)))
        new = chunks.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti")
        part = Index.from_chunks(new, self.embedder, storage=self.storage)
        kept = {t: incremental.keep_for(getattr(self, t), chunks).unionByName(getattr(part, t)) for t in ("postings", "lengths", "vectors")}
        rest = self.files.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(now.select("file_path", "mtime_ms", "size_bytes"))
        return Index(chunks, **kept, files=rest, embedder=self.embedder, content=self.content, root=self.root)

    # --- queries ------------------------------------------------------------------------------------------
    def _selected(self, languages: Sequence[str], paths: Sequence[str]) -> DataFrame | None:
        test = navigate.selection(languages, paths)
        return None if test is None else self.chunks.where(test).select("chunk_id")

    def keyword(self, query: str, k: int, languages: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
        """By the postings where they are stored, else by one pass over the chunks; both give the same scores."""
        if self.stored:
            scores = sparse.index_scores(self.postings, self.lengths, query, self._selected(languages, paths))
        else:
            scores = sparse.scan_scores(self.chunks, query, selected=navigate.selection(languages, paths))
        return sparse.top_k(scores, k)

    def semantic(self, query: str, k: int, languages: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
        rows, chosen = self.vectors, self._selected(languages, paths)
        if chosen is not None:
            rows = rows.join(chosen, "chunk_id", "left_semi")
        near = dense.nearest_int8 if self.storage == "int8" else dense.nearest
        return dense.as_score(near(rows, self.embedder.embed_query(query), k))

    def search(self, query: str, top_k: int = 10, alpha: float | None = None, languages: Sequence[str] = (), paths: Sequence[str] = (), rerank: bool | None = None) -> DataFrame:
        """The best chunks with their scores; a blank query gives none.

        Keyword and vector candidates are cut to their best before they are
        ranked and fused; boosts may add chunks, within the filters.
        """
        top_k = top_k if top_k > 0 else 10
        empty = self.chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
        if not query.strip():
            return empty
        weight, n = ranking.resolve_alpha(query, alpha), ranking.candidate_count(query, top_k)
        both = fusion.fused(fusion.reciprocal_rank(self.semantic(query, n, languages, paths), n), fusion.reciprocal_rank(self.keyword(query, n, languages, paths), n), weight)
        test = navigate.selection(languages, paths)
        chunks = self.chunks if test is None else self.chunks.where(test)
        if not (("code" in self.content) if rerank is None else rerank):
            best = sparse.top_k(both, top_k)
        else:
            # candidates are some tens of rows; they are read once so that boosts do not repeat both retrievals
            candidates = self.spark.createDataFrame(both.collect(), "chunk_id bigint, score double")
            rows = ranking.with_chunks(candidates, chunks)
            best = ranking.saturated(ranking.boosted(rows, chunks.select("chunk_id", "file_path", "content"), query), top_k, weight < 1.0).select("chunk_id", "score")
        return chunks.join(F.broadcast(best), "chunk_id").dropDuplicates(["chunk_id"]).orderBy(F.round("score", 9).desc(), "chunk_id")  # top_k rows

    def locate(self, literals: str | Sequence[str], **options) -> DataFrame:
        return locate.locate(self.chunks, literals, **options)

    def expand(self, path: str, line: int, before: int = 1, after: int = 1) -> DataFrame:
        """The chunk at a line of a file and its neighbours; the path may be absolute or relative to the root or to here."""
        return navigate.expand(self.chunks, self.indexed_path(path), line, before, after)

    def indexed_path(self, path: str) -> str:
        """A path as the index names it: below the root, with slashes and without dots; others stay as they are."""
        if not self.root or "://" in self.root:
            return path
        root = os.path.abspath(self.root)
        place = os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
        return os.path.relpath(place, root).replace(os.sep, "/") if place.startswith(root.rstrip(os.sep) + os.sep) else path

    def find_related(self, path: str, line: int, top_k: int = 5) -> DataFrame:
        """Chunks most similar to the one at a line, of the same language, itself left out."""
        top_k = top_k if top_k > 0 else 5
        anchor = navigate.resolve(self.chunks, self.indexed_path(path), line).first()
        if anchor is None:
            return self.chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
        languages = [anchor["language"]] if anchor["language"] is not None else []
        near = self.semantic(anchor["content"] or "", top_k + 1, languages).where(F.col("chunk_id") != anchor["chunk_id"])
        best = sparse.top_k(near, top_k)
        return self.chunks.join(F.broadcast(best), "chunk_id").orderBy(F.round("score", 9).desc(), "chunk_id")  # top_k rows

    def snippets(self, results: DataFrame, query: str, lines: int = snippet.LINES) -> DataFrame:
        """Results cut around the query, with relevance, best first."""
        return ranking.relevance(snippet.snippets(results, query, lines)).orderBy(F.round("score", 9).desc(), "chunk_id")
