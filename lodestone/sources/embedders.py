"""Embedding backends: the interface, a deterministic one for tests, and an HTTP client."""

from __future__ import annotations

import abc
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunking import embedding_windows
from lodestone.operators.dense import mean_pool
from lodestone.sources import settings

DIMENSIONS, BATCH = 256, 360
RETRIES, RETRY_STATUS, FIRST_WAIT, LONGEST_WAIT = 4, (429, 500, 502, 503, 504), 0.25, 4.0


class Embedder(abc.ABC):
    """Turns texts into vectors of one width; must be picklable."""

    name: str = "embedder"
    dimensions: int = DIMENSIONS
    batch: int = BATCH

    @abc.abstractmethod
    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """One vector per text."""

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]


class HashEmbedder(Embedder):
    """A bag of hashed tokens at length one: deterministic, without a network."""

    name = "hash"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        from lodestone.functions.text import tokens_of

        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for token in tokens_of(text or ""):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(v))
            out.append([float(x) for x in (v / n if n else v)])
        return out


class FunctionEmbedder(Embedder):
    """A backend made of a function, for tests."""

    def __init__(self, function: Callable[[Sequence[str]], list[list[float]]], dimensions: int, name: str = "function"):
        self.function, self.dimensions, self.name = function, dimensions, name

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.function(texts)


def clean_input(text: str, mode: str = "preserve") -> str:
    """Lone surrogates become U+FFFD; backslashes are kept, made four (``quad``) or slashes (``strip``)."""
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text.replace("\\", "\\\\\\\\") if mode == "quad" else text.replace("\\", "/") if mode == "strip" else text


def parse_embedding(value: object) -> list[float]:
    """A list of floats, or int8 values with scale and zero point; another ``dtype`` or shape is an error."""
    if isinstance(value, dict):
        if value.get("dtype", "int8") not in ("int8", "i8"):
            raise ValueError(f"embeddings of type {value['dtype']!r} are not known")
        zero, scale = value.get("zero_point", 0), value.get("scale", 1.0)
        return [(v - zero) * scale for v in value["values"]]
    if not isinstance(value, list):
        raise ValueError("an embedding is a list of numbers or an int8 record")
    return [float(v) for v in value]


def embeddings_of(answer: object) -> list[object]:
    """The embeddings of an endpoint's answer: a bare list, ``{"embeddings": [...]}`` or ``{"data": [{"embedding": ...}]}``."""
    if isinstance(answer, list):
        return answer
    if isinstance(answer, dict):
        if isinstance(answer.get("embeddings"), list):
            return answer["embeddings"]
        if isinstance(answer.get("data"), list) and all(isinstance(d, dict) and "embedding" in d for d in answer["data"]):
            return [d["embedding"] for d in answer["data"]]
    raise ValueError("the endpoint returned an answer of an unknown shape")


class TooLarge(Exception):
    """A request that the service refuses for its size."""


class ServiceEmbedder(Embedder):
    """Texts sent to a service in batches; what is too large is halved, down to parts of one text, which are pooled."""

    escape: str = "preserve"

    def __init__(self) -> None:
        self.stats = dict.fromkeys(("requests", "retries", "too_large", "errors", "inputs", "chars"), 0)

    @abc.abstractmethod
    def request(self, texts: Sequence[str]) -> list[object]:
        """One raw embedding per text, in order; raises TooLarge."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        return self._halving([clean_input(t, self.escape) for t in texts])

    def _halving(self, texts: list[str]) -> list[list[float]]:
        self.stats["requests"] += 1
        self.stats["inputs"] += len(texts)
        self.stats["chars"] += sum(map(len, texts))
        try:
            vectors = [parse_embedding(e) for e in self.request(texts)]
        except TooLarge:
            self.stats["too_large"] += 1
            if len(texts) > 1:
                half = len(texts) // 2
                return self._halving(texts[:half]) + self._halving(texts[half:])
            half = len(texts[0]) // 2
            if not half:
                raise
            pooled = np.mean(self._halving([texts[0][:half]]) + self._halving([texts[0][half:]]), axis=0)
            n = float(np.linalg.norm(pooled))
            return [[float(x) for x in (pooled / n if n else pooled)]]
        if len(vectors) != len(texts) or any(len(v) != self.dimensions for v in vectors):
            self.stats["errors"] += 1
            raise ValueError("the service returned another number or width of vectors")
        return vectors


class HttpEmbedder(ServiceEmbedder):
    """POST ``{base}/embeddings`` with a bearer token; retries what may pass."""

    def __init__(self, base_url: str, model: str, dimensions: int = DIMENSIONS, key_variable: str = "LODESTONE_API_KEY", timeout: float = 120.0, escape: str = "preserve", batch: int = BATCH):
        super().__init__()
        self.base_url, self.model, self.name, self.dimensions, self.batch = base_url.rstrip("/"), model, model, dimensions, batch
        self.key_variable, self.timeout, self.escape = key_variable, timeout, escape

    def request(self, texts: Sequence[str]) -> list[object]:
        body = json.dumps({"model": self.model, "input": list(texts), "dimensions": self.dimensions}).encode()
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.key_variable, "")
        if settings.usable_key(key):
            headers["Authorization"] = f"Bearer {key.strip()}"
        for attempt in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/embeddings", body, headers), timeout=self.timeout) as r:
                    return [d["embedding"] for d in sorted(json.load(r)["data"], key=lambda d: d.get("index", 0))]
            except urllib.error.HTTPError as e:
                if e.code == 413:
                    raise TooLarge from e
                if e.code not in RETRY_STATUS or attempt == RETRIES:
                    self.stats["errors"] += 1
                    raise
                self.stats["retries"] += 1
                time.sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
        raise AssertionError


class EndpointEmbedder(ServiceEmbedder):
    """A hosted model behind ``invoke(body) -> answer``, which a caller supplies (any client; picklable)."""

    def __init__(self, invoke: Callable[[dict], object], name: str, dimensions: int = DIMENSIONS, normalize: bool = True, truncate: bool = True, direction: str = "Right", prompt_name: str = "", batch: int = BATCH):
        super().__init__()
        self.invoke, self.name, self.dimensions, self.batch = invoke, f"endpoint:{name}", dimensions, batch
        self.options = {"normalize": normalize, "truncate": truncate, "truncation_direction": direction} | ({"prompt_name": prompt_name} if prompt_name else {})

    def request(self, texts: Sequence[str]) -> list[object]:
        return embeddings_of(self.invoke({"inputs": list(texts), "dimensions": self.dimensions, **self.options}))


def chosen_embedder(url: str | None = None, model: str | None = None, dimensions: int | None = None) -> Embedder:
    """The embedder that arguments or environment name: a service where a URL is known, else hashed tokens."""
    url, model = url or settings.embedding_url(), model or settings.embedding_model()
    width = dimensions or settings.embedding_dimensions()
    if url:
        return HttpEmbedder(url, model, width or DIMENSIONS, batch=settings.embedding_batch())
    return HashEmbedder(width or 64)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``(chunk_id, embedding)``: windows are embedded in batches where they are, then pooled per chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), embedder.batch):
                part = frame.iloc[at : at + embedder.batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "win_pos": part["win_pos"].to_numpy(), "embedding": embedder.embed(list(part["text"]))})

    vectors = embedding_windows(chunks, settings.window_chars()).mapInPandas(run, "chunk_id bigint, win_pos int, embedding array<double>")
    return mean_pool(vectors, ["chunk_id"], "embedding").select("chunk_id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
