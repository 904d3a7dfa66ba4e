"""Chunks, embeddings and vector search: chunk generator, embedders, exact top-k, random-hyperplane buckets."""

from __future__ import annotations

import hashlib
import math
import os
import re
import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.vector import FLOOR, cosine_to
from tidepool.sources import canonical

#: Chunk size, overlap and least size in characters; least similarity of a search.
SIZE, OVERLAP, LEAST = 500, 100, 15
LEAST_SIMILARITY = 0.35
#: Rows of a block in which vectors or queries meet, and of the tiles of it whose cosines are taken at once (a quarter of it for queries).
BLOCK_ROWS, TILE = 1 << 16, 1 << 11
CHUNK = "chunk_id string, chunk_index int, start_char int, end_char int, text string"


def chunk_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, text) of the chunks of a text without the blanks around it. A window ends after its last blank line,
    line end or sentence that lies behind its first least characters; the next starts overlap before, one further at least."""
    body = (text or "").strip()
    out: list[tuple[int, int, str]] = []
    if len(body) < least:
        return out
    marks = [m.start() for m in re.finditer(r"\n|\. ", body)]
    marks_at = np.array(marks, dtype=np.int64)
    start = 0
    while True:
        end = min(start + size, len(body))
        if end < len(body):
            # a mark of two characters has to lie inside the window as a whole; a single line end may be its last character
            i = int(np.searchsorted(marks_at, end)) - 1
            while i >= 0 and marks[i] >= start + least:
                if body[marks[i]] == "\n" or marks[i] + 2 <= end:
                    end = marks[i] + 1 if marks[i] > start else end
                    break
                i -= 1
        piece = body[start:end].strip()
        if len(piece) >= least:
            out.append((start, end, piece))
        if end >= len(body):
            return out
        start = max(end - overlap, start + 1)


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """artifact_id, source_type, chunk_id, chunk_index, start_char, end_char, text of docs (id, mime_type, text). Null and
    too short texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, kind, f"{i}_c{k}", k, a, b, t)
                for i, kind, text in zip(pdf["id"], pdf["source_type"], pdf["text"], strict=True)
                for k, (a, b, t) in enumerate(chunk_spans(text, size, overlap, least))
            ]
            yield pd.DataFrame(rows, columns=["artifact_id", "source_type", "chunk_id", "chunk_index", "start_char", "end_char", "text"])

    kind = F.when(F.lower("mime_type").startswith("image/"), "ocr_text").otherwise("document_text").alias("source_type")
    rows = docs.filter(F.length("text") >= least).select("id", kind, "text")
    return rows.mapInPandas(run, f"artifact_id bigint, source_type string, {CHUNK}")


class Embedder:
    """What turns texts into vectors: a model's name, its dimension (0: none), and a function from texts to a matrix."""

    model_id, dimension = "null", 0

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dimension), np.float32)


class HashEmbedder(Embedder):
    """Words and their beginnings hashed to signs in a fixed number of dimensions, at length one; empty texts are all zero.
    The same text has the same vector everywhere."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.model_id = dimension, f"hash-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                for part, weight in ((word, 1.0), (word[:5], 0.5)):
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    out[row, h % self.dimension] += weight if h >> 63 else -weight
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class OnnxEmbedder(Embedder):
    """A sentence model in a folder with model.onnx and tokenizer.json: mean pooling over the mask, then length one.
    Loaded once a worker; a folder without the files raises FileNotFoundError at the start."""

    def __init__(self, folder: str, model_id: str, dimension: int = 384, max_tokens: int = 512):
        for name in MODEL_FILES:
            if not os.path.exists(os.path.join(folder, name)):
                raise FileNotFoundError(os.path.join(folder, name))
        self.folder, self.model_id, self.dimension, self.max_tokens = folder, model_id, dimension, max_tokens
        self._session = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", providers=["CPUExecutionProvider"]), tokenizer
        session, tokenizer = self._session
        coded = tokenizer.encode_batch(list(texts))
        ids, mask = np.array([c.ids for c in coded], np.int64), np.array([c.attention_mask for c in coded], np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        tokens = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        pooled = (tokens * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
        return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _one(embedder: Embedder, text: str) -> np.ndarray:
    try:
        return embedder.embed([text])[0]
    except Exception:
        return np.zeros(0, np.float32)


def embedding(embedder: Embedder) -> Callable[[Column], Column]:
    """A function from a text column to its vectors; texts that fail or have no vector give an empty array."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        try:
            x = list(embedder.embed(given))
        except Exception:  # one text at a time: those that fail have no vector, and do not end the job
            x = [_one(embedder, t) for t in given]
        return pd.Series([r if np.any(r) else [] for r in x])

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunks with model_id, dimension and embedding; those without a vector are left out."""
    if not embedder.dimension:
        return chunks.limit(0).withColumns({"model_id": F.lit(embedder.model_id), "dimension": F.lit(0), "embedding": F.array().cast("array<float>")})
    rows = chunks.withColumn("embedding", embedding(embedder)(F.col("text"))).filter(F.size("embedding") == embedder.dimension)
    return rows.withColumns({"model_id": F.lit(embedder.model_id), "dimension": F.lit(embedder.dimension)})


def sound(vectors: DataFrame) -> Column:
    """Whether an embedding can be compared: dimension finite elements, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size("embedding") == F.col("dimension")) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def exact_topk(vectors: DataFrame, query: list[float], model_id: str, k: int | None = 20, least: float = 0.5) -> DataFrame:
    """vectors of the model and the query's dimension with similarity of least or more, the k best by similarity, then id;
    without k all of them, in no order."""
    rows = vectors.filter((F.col("model_id") == model_id) & (F.col("dimension") == len(query))).filter(sound(vectors))
    found = rows.withColumn("similarity", cosine_to(F.col("embedding"), query)).filter(F.col("similarity") >= least)
    return found if k is None else found.orderBy(F.col("similarity").desc(), "chunk_id").limit(k)


def best_per_artifact(matches: DataFrame) -> DataFrame:
    """artifact_id, similarity, text of the best chunk of each artifact."""
    best = F.max_by(F.struct("similarity", "text"), F.struct("similarity", "chunk_id"))
    return matches.groupBy("artifact_id").agg(best.alias("b")).select("artifact_id", "b.similarity", "b.text")


def _planes(dimension: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((tables * bits, dimension)).astype(np.float32)


def _bucket_numbers(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    signs = (np.atleast_2d(x) @ _planes(np.shape(x)[-1], tables, bits, seed).T > 0).reshape(-1, tables, bits)
    return (signs << np.arange(bits)).sum(axis=2)


def buckets_of(x: np.ndarray, tables: int = 12, bits: int = 8, seed: int = 0) -> list:
    """The buckets of a vector, one a table, or of each row of a matrix."""
    found = _bucket_numbers(x, tables, bits, seed) + np.arange(tables) * (1 << bits)
    return found.tolist() if np.ndim(x) > 1 else found[0].tolist()


def hyperplane_buckets(vectors: DataFrame, tables: int = 12, bits: int = 8, seed: int = 0) -> DataFrame:
    """vectors once for each of tables tables, with the bucket (table and signs against bits random planes)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(embeddings: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(embeddings), dtype=object)
        sizes = embeddings.map(len).to_numpy()
        for n in np.unique(sizes):  # the planes are drawn once for the vectors of a dimension, and meet them as a matrix
            at = np.flatnonzero(sizes == n)
            for i, b in zip(at, buckets_of(np.stack(embeddings.iloc[at].to_list()).astype(np.float32), tables, bits, seed), strict=True):
                out.iat[i] = b
        return out

    return vectors.filter(sound(vectors)).withColumn("bucket", F.explode(run(F.col("embedding"))))


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, 1e-9 at least, summed up in the order of functions.vector.norm."""
    parts = [np.sqrt(np.cumsum(x[a : a + TILE].astype(np.float64) ** 2, axis=1)[:, -1]) for a in range(0, len(x), TILE)]
    return np.maximum(np.concatenate([np.zeros(0), *parts]), FLOOR)


def _directions(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for a in range(0, len(x), TILE):
        out[a : a + TILE] = x[a : a + TILE] / norms[a : a + TILE, None]
    return out


def _sharing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a share a bucket with which rows of b."""
    out = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        out |= a[:, t, None] == b[None, :, t]
    return out


def nearest_in_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, buckets: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine): of each row of q the k most similar ids (those of the rows of x; the smaller ids where
    cosines are equal), with buckets (numbers of q's and x's rows, a column a table) among those that share one with it.

    All cosines of a tile are taken at once in single precision; what can be among the k best, by more than its error, is
    computed again in double precision, in the order of functions.vector.cosine. Rows of x with one id count as its best."""
    name = pd.factorize(ids, sort=True)[0]
    nth = pd.Series(name).groupby(name).cumcount().to_numpy()
    tiles = [rows[a : a + TILE] for n in np.unique(nth) for rows in [np.flatnonzero(nth == n)] for a in range(0, len(rows), TILE)]  # a tile has an id once
    q_norms, x_norms = _norms(q), _norms(x)
    q_unit, x_unit = _directions(q, q_norms), _directions(x, x_norms)
    error = (q.shape[1] + 8) * 2.0**-23
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(q), TILE // 4):
        mine = slice(at, at + TILE // 4)
        least = np.full(len(q[mine]), -np.inf)  # the k-th best so far
        best = out[0]
        for rows in tiles:
            near, floor = q_unit[mine] @ x_unit[rows].T, least - error
            unfilled = np.flatnonzero(np.isneginf(least))
            if len(unfilled):
                part = near[unfilled]
                if buckets:
                    part[~_sharing(buckets[0][mine][unfilled], buckets[1][rows])] = -np.inf
                    near[unfilled] = part
                if len(rows) >= k:
                    floor[unfilled] = np.partition(part, len(rows) - k, axis=1)[:, len(rows) - k] - 2 * error
            i, j = np.divmod(np.flatnonzero(near >= np.maximum(floor, -2).astype(np.float32)[:, None]), len(rows))
            for a in range(0, len(i), 4 * TILE):
                u, v = i[a : a + 4 * TILE], rows[j[a : a + 4 * TILE]]
                if buckets:
                    shared = (buckets[0][at + u] == buckets[1][v]).any(axis=1)
                    u, v = u[shared], v[shared]
                dots = np.cumsum(q[at + u].astype(np.float64) * x[v], axis=1)[:, -1]
                best = _first(*(np.concatenate(c) for c in zip(best, (u, v, dots / (q_norms[at + u] * x_norms[v])), strict=True)), name, k, nth[rows[0]] > 0)
            kth = np.flatnonzero(best[0][k - 1 :] == best[0][: max(0, len(best[0]) - k + 1)]) + k - 1
            least[best[0][kth]] = best[2][kth]
        out.append((best[0] + at, *best[1:]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _first(i: np.ndarray, j: np.ndarray, cos: np.ndarray, name: np.ndarray, k: int, again: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest cosines of each i, then by name[j], in order; where names may have come again, the greatest of a name."""
    if again:
        by = np.lexsort((-cos, name[j], i))
        by = by[np.r_[True, (i[by][1:] != i[by][:-1]) | (name[j[by]][1:] != name[j[by]][:-1])]] if len(by) else by
        i, j, cos = i[by], j[by], cos[by]
    by = np.lexsort((name[j], -cos, i))
    i, j, cos = i[by], j[by], cos[by]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], cos[kept]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, buckets: tuple[int, int, int] | None = None) -> DataFrame:
    """query_id, chunk_id, similarity, position: the k most similar vectors (chunk_id, model_id, dimension, embedding) of queries
    (query_id, model_id, dimension, embedding) of the same model and dimension, then by chunk_id; with buckets (tables, bits,
    seed) among those that share one with it. A chunk_id that repeats counts once, by its best.

    Blocks of vectors meet blocks of queries as matrices, and only each block's k best of a query travel on; a vector
    travels once for each block of queries, a query once for each block of vectors."""
    known = "model_id", "dimension"
    left, right = (df.filter(sound(df) & F.col("model_id").isNotNull()).select(name, "model_id", F.col("dimension").cast("int").alias("dimension"), "embedding") for df, name in ((queries, "query_id"), (vectors, "chunk_id")))
    n, m, cores = vectors.count(), queries.count(), vectors.sparkSession.sparkContext.defaultParallelism
    x_blocks, q_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(2 * cores, n // TILE)), max(1, math.ceil(m / BLOCK_ROWS))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = left.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("_x", every(x_blocks))
    right = right.withColumn("_x", F.pmod(F.xxhash64("chunk_id"), F.lit(x_blocks)).cast("int")).withColumn("_q", every(q_blocks))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            q, x = (y["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(y.num_rows, -1) for y in (a, b))
            numbers = tuple(_bucket_numbers(y.astype(np.float32, copy=False), *buckets).astype(np.min_scalar_type((1 << buckets[1]) - 1)) for y in (q, x)) if buckets else None
            i, j, cos = nearest_in_block(q, x, np.array(b["chunk_id"].to_pylist(), dtype=object), k, numbers)
        return pa.table({"query_id": a["query_id"].take(pa.array(i)), "chunk_id": b["chunk_id"].take(pa.array(j)), "similarity": pa.array(cos)})

    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("similarity", T.DoubleType())])
    best = left.groupBy(*known, "_q", "_x").cogroup(right.groupBy(*known, "_q", "_x")).applyInArrow(meet, schema)
    best = best.groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return best.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def bucketed_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 12, bits: int = 8, seed: int = 0) -> DataFrame:
    """query_id, chunk_id, similarity, position: the k most similar vectors of queries (query_id, model_id, dimension,
    embedding), among those that share a bucket with it, reranked by their cosine. Vectors of another model don't count."""
    return nearest(vectors, queries, k, (tables, bits, seed))


def similar(vectors: DataFrame, query: list[float], model_id: str, k: int = 20, least: float = 0.5, mode: str = "exact") -> DataFrame:
    """The k most similar chunks with a similarity of least or more: by exact search, or (mode "buckets") among those that
    share a bucket with the query, where the threshold comes after the k best are taken."""
    if mode == "exact":
        return exact_topk(vectors, query, model_id, k, least)
    spark = vectors.sparkSession
    probe = spark.createDataFrame([("q", model_id, len(query), [float(x) for x in query])], "query_id string, model_id string, dimension int, embedding array<float>")
    found = bucketed_topk(vectors, probe, k).filter(F.col("similarity") >= least).select("chunk_id", "similarity")
    return vectors.join(found, "chunk_id").orderBy(F.col("similarity").desc(), "chunk_id")


MODEL_FILES = ("model.onnx", "tokenizer.json")


def model_folder(explicit: str | None = None, default: str | None = None) -> str | None:
    """Where the sentence model is: the folder given, else TIDEPOOL_MODEL_DIR, else the default."""
    return explicit or os.environ.get("TIDEPOOL_MODEL_DIR") or default


def model_status(folder: str | None = None) -> dict:
    """Whether a sentence model can be used, and what is missing; never raises."""
    at = model_folder(folder)
    lacking = [n for n in MODEL_FILES if not at or not os.path.exists(os.path.join(at, n))]
    return {"folder": at, "available": not lacking, "missing": lacking}


def validate_model(folder: str | None = None) -> dict:
    """model_status, and whether a text has a finite vector by the model; what fails is said in error, never raised."""
    said = model_status(folder) | {"valid": False, "error": None}
    if not said["available"]:
        return said | {"error": f"missing: {', '.join(said['missing'])}"}
    try:
        x = OnnxEmbedder(said["folder"], "check").embed(["a short text"])[0]
        return said | {"valid": bool(np.isfinite(x).all() and np.any(x)), "dimension": int(len(x))}
    except Exception as e:
        return said | {"error": f"{type(e).__name__}: {e}"}


def install_model(source: str, folder: str) -> dict:
    """Copy a model's files from a folder to where it is used; files that are there with the same size stay as they are."""
    os.makedirs(folder, exist_ok=True)
    copied = []
    for n in MODEL_FILES:
        a, b = os.path.join(source, n), os.path.join(folder, n)
        if not os.path.exists(a):
            raise FileNotFoundError(a)
        if not os.path.exists(b) or os.path.getsize(a) != os.path.getsize(b):
            shutil.copyfile(a, f"{b}.part")
            os.replace(f"{b}.part", b)
            copied.append(n)
    return model_status(folder) | {"copied": copied}


# Queries -----------------------------------------------------------------------------------------------------------

MODEL = "lumen-mini-v1"
#: A fixed query vector of 64 dimensions.
PROBE = [round(((i * 37) % 23 - 11) / 11, 3) for i in range(64)]


def _documents(spark, sf_dir: str) -> DataFrame:
    return canonical.artifacts(spark, sf_dir).select("id", "mime_type", F.col("extracted_text").alias("text"))


def cosine_topk(spark, sf_dir: str) -> DataFrame:
    return exact_topk(canonical.chunks(spark, sf_dir), PROBE, MODEL, 20, -1.0).select("chunk_id", F.round("similarity", 6).alias("similarity"))


def cosine_threshold(spark, sf_dir: str) -> DataFrame:
    rows = exact_topk(canonical.chunks(spark, sf_dir), PROBE, MODEL, None, 0.15)
    return rows.select("chunk_id", "artifact_id", F.round("similarity", 6).alias("similarity"))


def max_similarity_per_artifact(spark, sf_dir: str) -> DataFrame:
    rows = canonical.chunks(spark, sf_dir).filter(F.col("model_id") == MODEL).filter(F.col("dimension") == len(PROBE))
    rows = rows.filter(sound(rows)).withColumn("similarity", F.round(cosine_to(F.col("embedding"), PROBE), 6))
    return best_per_artifact(rows).select("artifact_id", "similarity")


def chunk_artifacts(spark, sf_dir: str) -> DataFrame:
    return chunk_documents(_documents(spark, sf_dir)).select("chunk_id", "artifact_id", "chunk_index", "start_char", "end_char", "source_type", F.md5("text").alias("digest"))


def embedded_chunks(spark, sf_dir: str) -> DataFrame:
    rows = embed_chunks(chunk_documents(_documents(spark, sf_dir)), HashEmbedder(32))
    return rows.select("chunk_id", "model_id", "dimension", F.size("embedding").alias("size"))


def _probe_set(spark, sf_dir: str) -> DataFrame:
    rows = canonical.chunks(spark, sf_dir).filter(F.pmod("artifact_id", F.lit(100)) == 0)
    return rows.select(F.col("chunk_id").alias("query_id"), "model_id", "dimension", "embedding")


def lsh_topk(spark, sf_dir: str) -> DataFrame:
    """Queries: chunks of the artifacts whose id is divisible by 100, against all chunks."""
    return bucketed_topk(canonical.chunks(spark, sf_dir), _probe_set(spark, sf_dir), tables=16, bits=4)


_STRIPPED = r"regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
_MARKED = r"regexp_extract(substr(body, pos + 1, least(500, n - pos)), '(?s)^(.*)(?:\n|\. )', 1)"
_CHUNKS_SQL = f"""
WITH RECURSIVE {canonical.ARTIFACTS_SQL}, d AS (SELECT id, mime_type, body, length(body) AS n FROM (SELECT id, mime_type, {_STRIPPED.format("extracted_text")} AS body FROM art) WHERE length(body) >= 15),
w AS (
  SELECT id, mime_type, body, n, CAST(0 AS BIGINT) AS pos, CASE WHEN n > 500 AND length({_MARKED.replace("pos + 1", "1").replace("n - pos", "n")}) >= 15 THEN length({_MARKED.replace("pos + 1", "1").replace("n - pos", "n")}) + 1 ELSE least(500, n) END AS until FROM d
  UNION ALL SELECT id, mime_type, body, n, pos, CASE WHEN pos + 500 < n AND length({_MARKED}) >= 15 THEN pos + length({_MARKED}) + 1 ELSE least(pos + 500, n) END FROM (SELECT id, mime_type, body, n, greatest(until - 100, pos + 1) AS pos FROM w WHERE until < n)
),
c AS (SELECT id, mime_type, pos, until, {_STRIPPED.format("substr(body, pos + 1, until - pos)")} AS piece FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i FROM c WHERE length(piece) >= 15)
"""
_CH = "WITH ch AS (SELECT DISTINCT ON (chunk_id) * FROM vector_chunks), ok AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM ch WHERE len(embedding) = dimension AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
_SIM = _CH + f"s AS (SELECT chunk_id, artifact_id, list_cosine_similarity(v, CAST({PROBE} AS DOUBLE[])) AS similarity FROM ok WHERE model_id = '{MODEL}' AND dimension = {len(PROBE)}) "
QUERIES = {f.__name__: f for f in (cosine_topk, cosine_threshold, max_similarity_per_artifact, chunk_artifacts, embedded_chunks, lsh_topk)}
SQL = {
    "chunk_artifacts": _CHUNKS_SQL + "SELECT id || '_c' || i AS chunk_id, id AS artifact_id, CAST(i AS INT) AS chunk_index, CAST(pos AS INT) AS start_char, CAST(until AS INT) AS end_char, CASE WHEN lower(mime_type) LIKE 'image/%' THEN 'ocr_text' ELSE 'document_text' END AS source_type, md5(piece) AS digest FROM k",
    "embedded_chunks": _CHUNKS_SQL + r"SELECT id || '_c' || i AS chunk_id, 'hash-32' AS model_id, 32 AS dimension, 32 AS size FROM k WHERE regexp_matches(piece, '[\p{L}\p{N}]')",
    "cosine_topk": _SIM + "SELECT chunk_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, chunk_id LIMIT 20",
    "cosine_threshold": _SIM + "SELECT chunk_id, artifact_id, round(similarity, 6) AS similarity FROM s WHERE s.similarity >= 15e-2",
    "max_similarity_per_artifact": _SIM + "SELECT artifact_id, max(round(similarity, 6)) AS similarity FROM s GROUP BY artifact_id",
}
