"""Embeddings: caches, exact search with a cap per document, and packing into a token budget."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.columns import embed_input


#: Queries that are held at once.
QUERY_BLOCK = 4096


class Embedder(Protocol):
    """A model: its identity, and unit vectors of queries and documents."""

    model: str

    def queries(self, texts: list[str]) -> np.ndarray: ...

    def documents(self, texts: list[str]) -> np.ndarray: ...


class LetterEmbedder:
    """Counts of hashed character trigrams as unit vectors: needs no model, for tests and as a fallback."""

    def __init__(self, dims: int = 64):
        self.dims, self.model = dims, f"letters-{dims}"

    def documents(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            s = f" {(t or '').lower()} "
            for k in range(len(s) - 2):
                out[i, zlib.crc32(s[k : k + 3].encode()) % self.dims] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    queries = documents


def cache_key(model: str, title: Column, heading: Column, text: Column) -> Column:
    """Identity of an embedding: the model, and all that it is given."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), embed_input(F.coalesce(title, F.lit("")), heading, text)), 256)


def missing(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model."""
    have = vectors.filter(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti")


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 16) -> DataFrame:
    """chunk_id, model, vec of chunks with columns id, title, heading, text.  Texts are embedded by length,
    so that batches are even; the model is loaded once a worker."""
    rows = chunks.select("id", embed_input(F.coalesce("title", F.lit("")), F.col("heading"), F.col("text")).alias("t")).sortWithinPartitions(F.length("t"))

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield pd.DataFrame({"chunk_id": part["id"], "model": embedder.model, "vec": list(embedder.documents(part["t"].tolist()))})

    return rows.mapInPandas(run, "chunk_id bigint, model string, vec array<float>")


def embed_sync(chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """The vectors of the model for exactly these chunks: kept ones and new ones; other models are
    dropped."""
    ids = chunks.select(F.col("id").alias("chunk_id"))
    kept = vectors.filter(F.col("model") == embedder.model).join(ids, "chunk_id", "left_semi")
    return kept.unionByName(embed(missing(chunks, vectors, embedder.model), embedder))


def keyed(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """The chunks (title, heading, text and more) with `key`, the identity of their embedding."""
    return chunks.withColumn("key", cache_key(embedder.model, F.col("title"), F.col("heading"), F.col("text")))


def fill_cache(chunks: DataFrame, cache: DataFrame | None, embedder: Embedder, most: int | None = None) -> DataFrame:
    """The new rows (key, vec) of a cache for keyed chunks: each different text that it lacks is embedded once.  With
    `most` only so many of them, the first by key."""
    wanted = chunks.select("key", "title", "heading", "text").dropDuplicates(["key"])
    wanted = wanted.join(cache.select("key"), "key", "left_anti") if cache is not None else wanted
    wanted = wanted.orderBy("key").limit(most) if most is not None else wanted
    texts = wanted.select("key", embed_input(F.coalesce("title", F.lit("")), F.col("heading"), F.col("text")).alias("t")).sortWithinPartitions(F.length("t"))

    batch = 16

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield pd.DataFrame({"key": part["key"], "vec": list(embedder.documents(part["t"].tolist()))})

    return texts.mapInPandas(run, "key string, vec array<float>")


def _contenders(s: np.ndarray, docs: np.ndarray, k: int, per_doc: int) -> np.ndarray:
    """Which scores (vectors x queries) of a block can be among the k best of their query with at most per_doc of a
    document.  What is left out has per_doc better rows of its document or k better rows in all even here; the better
    rows of another block can only push it further down."""
    s = s.copy()
    _, of, n = np.unique(docs, return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(n)
    for d in np.flatnonzero(n > per_doc):
        rows = order[ends[d] - n[d] : ends[d]]
        own = s[rows]
        own[own < np.partition(own, len(rows) - per_doc, axis=0)[len(rows) - per_doc]] = -np.inf
        s[rows] = own
    if len(s) <= k:
        return np.isfinite(s)
    return np.isfinite(s) & (s >= np.partition(s, len(s) - k, axis=0)[len(s) - k])


def scores(vectors: DataFrame, queries: DataFrame, block: int = 2000, best: tuple[int, int] | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, score (cosine) of every vector against a stated set of queries; with `best` =
    (k, per_doc) only of those that can be among the k best of a query, so that what leaves a block doesn't grow with
    vectors times queries.

    The queries (query_id, qvec) are at most QUERY_BLOCK rows, which is checked; they are held as one matrix
    and every partition multiplies its vectors by it in blocks.  Vectors of another length are left out;
    a zero vector scores 0.
    """
    q = queries.limit(QUERY_BLOCK + 1).collect()
    if len(q) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries at once; search() takes them in blocks")
    ids = [r["query_id"] for r in q]
    mat = _unit(np.array([r["qvec"] for r in q], np.float64)) if q else np.zeros((0, 0))
    kind = dict(queries.dtypes)["query_id"]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, mat))

    def run(batches):
        names, m = np.array(shared.value[0]), shared.value[1]
        for pdf in batches:
            ok = [k for k, v in enumerate(pdf["vec"]) if v is not None and len(m) and len(v) == m.shape[1]]
            for a in range(0, len(ok), block):
                part = pdf.iloc[ok[a : a + block]]
                s = _unit(np.array(part["vec"].tolist(), np.float64)) @ m.T
                keep = _contenders(s, part["doc_id"].astype(str).to_numpy(), *best) if best else np.ones(s.shape, bool)
                v, q = np.nonzero(keep)
                yield pd.DataFrame({"query_id": names[q], "chunk_id": part["chunk_id"].to_numpy()[v], "doc_id": part["doc_id"].to_numpy()[v], "score": s[v, q]})

    return vectors.select("chunk_id", "doc_id", "vec").mapInPandas(run, f"query_id {kind}, chunk_id bigint, doc_id string, score double")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def top_k(scored: DataFrame, k: int = 8, per_doc: int = 2) -> DataFrame:
    """For each query the k best rows with at most per_doc of a document; ties by chunk_id.

    Both ranks are limited in the map tasks, so that only k rows a query and task are shuffled at last.
    """
    by = [F.desc("score"), "chunk_id"]
    a = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*by))).filter(F.col("n") <= per_doc).drop("n")
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, limit: int = 8, per_doc: int = 2) -> DataFrame:
    """The best rows for every query.  More queries than QUERY_BLOCK are taken in blocks of less than that,
    by hash, one pass over the vectors each; only a block at a time is held."""
    k, n = max(1, min(50, limit)), queries.count()
    if n <= QUERY_BLOCK:
        return top_k(scores(vectors, queries, best=(k, per_doc)), k, per_doc)
    blocks = 2 * -(-n // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [top_k(scores(vectors, queries.filter(part == i), best=(k, per_doc)), k, per_doc) for i in range(blocks)])


def pack(hits: DataFrame, budget: int = 3000) -> DataFrame:
    """query_id and the chunks packed greedily by rank into a token budget: a chunk that would overflow is
    skipped unless it is the first.  Hits (query_id, rank, chunk_id, tokens) are a top-k, so each list is
    short."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("chosen"))
    x = F.array_sort(F.collect_list(F.struct("rank", F.col("tokens").cast("bigint").alias("tokens"), "chunk_id")))

    def step(acc, h):
        fits = (acc["used"] + h["tokens"] <= budget) | (F.size(acc["chosen"]) == 0)
        return F.when(fits, F.struct((acc["used"] + h["tokens"]).alias("used"), F.concat(acc["chosen"], F.array(h["chunk_id"])).alias("chosen"))).otherwise(acc)

    got = hits.groupBy("query_id").agg(F.aggregate(x, start, step).alias("p"))
    return got.select("query_id", F.col("p.chosen").alias("chunks"), F.col("p.used").alias("tokens"))
