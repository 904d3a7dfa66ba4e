"""A vector index that is kept: random-hyperplane buckets in a folder, with adding, deleting, saving, loading, rebuilding.

The entries are snapshot tables in folders by part of the buckets, so that a search reads only its query's parts. Deleted
entries are marked in a table of their own until the index is rebuilt. A small JSON file says what the index was made for;
one that is missing, can't be read or doesn't fit makes the store rebuild the index from the chunks.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.vector import cosine_to
from tidepool.operators import vectors
from tidepool.sources.snapshots import SnapshotTable

#: Entries that are added before the index is written again without being asked.
FLUSH_ROWS = 2_000
PARTS = 64
ENTRIES = "label bigint, chunk_id string, artifact_id bigint, bucket int, embedding array<float>, part int"


class VectorIndexBackend(ABC):
    """What a vector index can do. Labels are its own numbers for its entries, and only grow."""

    @abstractmethod
    def add(self, rows: DataFrame) -> None:
        """Add rows (chunk_id, artifact_id, dimension, embedding)."""

    @abstractmethod
    def search(self, query: list[float], k: int) -> DataFrame:
        """chunk_id, artifact_id, similarity of the k nearest entries that are not deleted, nearest first."""

    @abstractmethod
    def mark_deleted(self, artifacts: DataFrame) -> None:
        """Leave out entries of artifacts (id) from now on."""

    @abstractmethod
    def contains(self, chunk_id: str) -> bool: ...

    @abstractmethod
    def count(self) -> int:
        """Entries that are not deleted."""

    @abstractmethod
    def save(self) -> None: ...

    @abstractmethod
    def load(self) -> bool:
        """Whether there is a stored index that fits."""

    @abstractmethod
    def rebuild(self, rows: DataFrame) -> None:
        """Make the index anew of rows; what was deleted is forgotten."""

    @abstractmethod
    def close(self) -> None: ...


def index_folder(root: str, store: str, model_id: str, dimension: int) -> str:
    """Where the index of a store's vectors of a model and dimension is: a key of the store's place, then the model's name."""
    key = hashlib.sha256(store.encode()).hexdigest()[:16]
    slug = "".join(ch if ch.isascii() and (ch.isalnum() or ch in "_.-") else "_" for ch in model_id)
    return f"{root.rstrip('/')}/{key}/{slug}-{dimension}"


def backed_off(k: int, there: int) -> int:
    """How many to give where only so many are there: k, else half of it, else one."""
    return next((n for n in (k, k // 2, 1) if 0 < n <= there), 0)


class BucketIndex(VectorIndexBackend):
    def __init__(self, spark: SparkSession, folder: str, model_id: str, dimension: int, tables: int = 12, bits: int = 8, seed: int = 0):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made_for = {"model_id": model_id, "dimension": dimension, "tables": tables, "bits": bits, "seed": seed}
        self.entries = SnapshotTable(spark, f"{self.folder}/entries", ["part"])
        self.deleted = SnapshotTable(spark, f"{self.folder}/deleted")
        self._waiting: list[DataFrame] = []
        self._n_waiting = 0

    def _meta(self, value: dict | None = None) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/meta.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if value is not None:
            out = fs.create(path, True)
            try:
                out.write(bytearray(json.dumps(value).encode()))
            finally:
                out.close()
            return value
        if not fs.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/meta.json", wholetext=True).first()[0])

    def _bucketed(self, rows: DataFrame, high: int) -> DataFrame:
        """rows as entries, with labels above high."""
        m = self.made_for
        sound = rows.filter(F.col("dimension") == m["dimension"]).filter(vectors.sound(rows)).select("chunk_id", "artifact_id", "dimension", "embedding").dropDuplicates(["chunk_id"])
        labelled = sound.withColumn("label", F.monotonically_increasing_id() + (high + 1))
        buckets = vectors.hyperplane_buckets(labelled, m["tables"], m["bits"], m["seed"])
        return buckets.select("label", "chunk_id", "artifact_id", "bucket", "embedding", F.pmod("bucket", F.lit(PARTS)).cast("int").alias("part"))

    def _stored(self) -> DataFrame:
        rows = self.entries.read() if self.entries.exists() else self.spark.createDataFrame([], ENTRIES)
        return rows.select(*[c.split()[0] for c in ENTRIES.split(", ")])

    def _live(self) -> DataFrame:
        rows = self._stored()
        return rows.join(self.deleted.read(), "label", "left_anti") if self.deleted.exists() else rows

    def add(self, rows: DataFrame) -> None:
        self._waiting.append(rows)
        self._n_waiting += rows.count()
        if self._n_waiting >= FLUSH_ROWS:
            self.save()

    def save(self) -> None:
        if self._waiting:
            high = (self._meta() or {}).get("high", -1)
            rows = self._waiting[0]
            for more in self._waiting[1:]:
                rows = rows.unionByName(more, allowMissingColumns=True)
            added = self._bucketed(rows, high)
            kept = self._stored().join(rows.select("chunk_id"), "chunk_id", "left_anti").select(added.columns)
            self._write(kept.unionByName(added))
            self._waiting, self._n_waiting = [], 0

    def _write(self, entries: DataFrame) -> None:
        written = self.entries.write(entries)
        high = written.agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0]
        self._meta(self.made_for | {"high": max(high, (self._meta() or {}).get("high", -1))})

    def load(self) -> bool:
        try:
            meta = self._meta()
            return meta is not None and self.entries.exists() and all(meta.get(k) == v for k, v in self.made_for.items())
        except Exception:  # what can't be read is no index
            return False

    def rebuild(self, rows: DataFrame) -> None:
        self._waiting, self._n_waiting = [], 0
        self.deleted.write(self.spark.createDataFrame([], "label bigint"))
        try:
            high = (self._meta() or {}).get("high", -1)
        except Exception:
            high = -1
            self._meta({})
        self._write(self._bucketed(rows, high))

    def mark_deleted(self, artifacts: DataFrame) -> None:
        self.save()
        gone = self._stored().join(artifacts.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select("label")
        before = self.deleted.read() if self.deleted.exists() else self.spark.createDataFrame([], "label bigint")
        self.deleted.write(before.unionByName(gone).distinct())

    def contains(self, chunk_id: str) -> bool:
        self.save()
        return bool(self._live().filter(F.col("chunk_id") == chunk_id).take(1))

    def count(self) -> int:
        self.save()
        return self._live().select("label").distinct().count()

    def search(self, query: list[float], k: int) -> DataFrame:
        self.save()
        m, x = self.made_for, np.asarray(query, np.float32)
        if len(x) != m["dimension"] or not np.isfinite(x).all() or not x.any():
            return self.spark.createDataFrame([], "chunk_id string, artifact_id bigint, similarity double")
        mine = vectors.buckets_of(x, m["tables"], m["bits"], m["seed"])
        near = self._live().filter(F.col("part").isin(sorted({b % PARTS for b in mine})) & F.col("bucket").isin(mine)).dropDuplicates(["label"])
        found = near.select("chunk_id", "artifact_id", cosine_to(F.col("embedding"), [float(v) for v in x]).alias("similarity")).orderBy(F.col("similarity").desc(), "chunk_id").limit(k)
        return found

    def close(self) -> None:
        self.save()


class VectorStore:
    """Vector search over chunks (a function that reads them): by the kept index of their model and dimension first, exactly
    where that finds nothing or fails. model_id and dimension never mix."""

    def __init__(self, spark: SparkSession, root: str, name: str, chunks: Callable[[], DataFrame], backend: type = BucketIndex):
        self.spark, self.root, self.name, self.chunks, self.backend = spark, root, name, chunks, backend
        self._open: dict[tuple[str, int], VectorIndexBackend] = {}

    def _own(self, model_id: str, dimension: int) -> DataFrame:
        return self.chunks().filter((F.col("model_id") == model_id) & (F.col("dimension") == dimension))

    def index(self, model_id: str, dimension: int) -> VectorIndexBackend:
        """The index, rebuilt of the chunks if there is none, or none that can be read and fits."""
        key = (model_id, dimension)
        if key not in self._open:
            made = self.backend(self.spark, index_folder(self.root, self.name, model_id, dimension), model_id, dimension)
            if not made.load():
                made.rebuild(self._own(model_id, dimension))
            self._open[key] = made
        return self._open[key]

    def search(self, query: list[float], model_id: str, k: int = 20, least: float = 0.5) -> DataFrame:
        """chunk_id, artifact_id, similarity: the k nearest, then of these those with a similarity of least or more. Where
        fewer than k are left of the index after deletions, half as many are given, or one."""
        try:
            found = [tuple(r) for r in self.index(model_id, len(query)).search(query, k).collect()]  # at most k
            found = found[: backed_off(k, len(found))] if len(found) < k else found
        except Exception:  # the answer is worth more than the index
            logging.getLogger(__name__).warning("the vector index failed, searching exactly", exc_info=True)
            found = []
        if not found:
            return vectors.exact_topk(self.chunks(), query, model_id, k, least).select("chunk_id", "artifact_id", "similarity")
        rows = self.spark.createDataFrame(found, "chunk_id string, artifact_id bigint, similarity double")
        return rows.filter(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), "chunk_id")

    def replace(self, artifacts: DataFrame, chunks: DataFrame, model_id: str, dimension: int) -> None:
        """Bring the index to chunks as the new ones of artifacts (id)."""
        index = self.index(model_id, dimension)
        index.mark_deleted(artifacts)
        index.add(chunks.filter((F.col("model_id") == model_id) & (F.col("dimension") == dimension)))

    def flush(self) -> None:
        for i in self._open.values():
            i.save()

    def close(self) -> None:
        for i in self._open.values():
            i.close()
        self._open = {}


def scaling(spark: SparkSession, folder: str, n: int = 10_000, dimension: int = 384, n_queries: int = 20, k: int = 10, seed: int = 0) -> dict:
    """Seconds to build an index of n random vectors at length one, milliseconds a query by the index and exactly, and the
    index's recall at k."""
    from tidepool.operators.metrics import synthetic_vectors

    rows = synthetic_vectors(spark, n, dimension, seed)
    began = time.perf_counter()
    index = BucketIndex(spark, folder, "synthetic", dimension)
    index.rebuild(rows)
    built = time.perf_counter() - began
    probes = [[float(v) for v in r["embedding"]] for r in synthetic_vectors(spark, n_queries, dimension, seed + 1).collect()]
    spent, found = {"index": 0.0, "exact": 0.0}, 0
    for probe in probes:
        ids = {}
        for name, ask in (("index", lambda: index.search(probe, k)), ("exact", lambda: vectors.exact_topk(rows, probe, "synthetic", k, -1.0))):  # noqa: B023
            at = time.perf_counter()
            ids[name] = {r["chunk_id"] for r in ask().collect()}
            spent[name] += time.perf_counter() - at
        found += len(ids["index"] & ids["exact"])
    return {"n": n, "build_s": round(built, 3), **{f"{name}_ms": round(1000 * s / n_queries, 1) for name, s in spent.items()}, "recall": round(found / (k * n_queries), 4)}
