"""Problem 6: processing only new or changed records, by a Merkle tree over key ranges.

The keys' hashes are cut into equal ranges, FANOUT of them for each node of the tree; its depth follows the number of keys,
so that a leaf has about one key. A node's digest is the exclusive or of the hashes of its (key, content) pairs, down from
the level TOP; the levels above it, which the driver holds (at most FANOUT ** TOP * 16 / 15 digests), hash their children's.
A run makes the digests of the leaves that are reported on from the reports alone, and lays them beside the saved ones, a
narrow table: where they agree, the leaf was reported in full and is unchanged, and its records are not read. It descends
from the root where digests differ, reads only the folders of the state below the nodes reached, there only the leaves that
differ, and takes the records in them that do. Output, which is also the state's and the tree's change, goes to one folder
that is renamed into place at the end: a run that dies leaves nothing behind, and is simply made again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.session import fresh_path, table

FANOUT = 16
#: Levels of the tree below the root that the driver holds.
TOP = 3
LEAVES = FANOUT**TOP
#: Levels at most: 16 ** 12 leaves.
DEEPEST = 12
#: Keys of the state in one of its folders, as many as there are up to LEAVES.
FOLDER_KEYS = 1_000_000
STATE = "key bigint, leaf bigint, digest string, delta bigint, step string, part int"


def leaf_of(key, depth: int = TOP) -> F.Column:
    """Which of the FANOUT ** depth equal ranges of the hashed keys a key belongs to."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - 4 * depth)


def depth_for(n_keys: int) -> int:
    """Levels of a tree over so many keys: about one key a leaf."""
    depth = TOP
    while depth < DEEPEST and FANOUT**depth < n_keys:
        depth += 1
    return depth


def build_tree(leaves: dict[int, int]) -> dict[tuple[int, int], str]:
    """(level, node) -> digest of the levels that the driver holds, (0, 0) being the root; empty nodes are left out."""
    level = {k: format(v & (1 << 64) - 1, "016x") for k, v in leaves.items()}
    tree = {(TOP, k): v for k, v in level.items()}
    for depth in range(TOP - 1, -1, -1):
        parts: dict[int, list[str]] = {}
        for k in sorted(level):
            parts.setdefault(k // FANOUT, []).append(f"{k}:{level[k]}")
        level = {k: hashlib.sha256("|".join(v).encode()).hexdigest()[:16] for k, v in parts.items()}
        tree |= {(depth, k): v for k, v in level.items()}
    return tree


def differing_leaves(current: dict, saved: dict) -> list[int]:
    """The nodes of level TOP whose digests differ, reached by descending from the root through differing nodes only."""
    nodes = [0] if current.get((0, 0)) != saved.get((0, 0)) else []
    for depth in range(1, TOP + 1):
        nodes = [c for n in nodes for c in range(n * FANOUT, (n + 1) * FANOUT) if current.get((depth, c)) != saved.get((depth, c))]
    return nodes


class ChangeTracker:
    """State of what was processed, in a folder: a base, then one folder a run with its changes and the tree's top.

    base and reports: key (bigint), digest (string, null: not processed). Several rows of a key: the greatest digest of
    the base, the given latest of a report; null keys are left out. process() may be called again for a run that was
    published: it returns that run's output and does nothing. Every compact_every runs the changes are folded into a base.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder, compact_every
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _publish(self, staged: str, name: str) -> None:
        if not self.fs.rename(self._path(staged), self._path(name)):
            raise RuntimeError(f"{name} could not be published")

    def _write_tree(self, staged: str, top: dict[int, int], meta: dict) -> None:
        out = self.fs.create(self._path(f"{staged}/_tree.json"), True)
        try:
            out.write(bytearray(json.dumps(meta | {"leaves": {k: v for k, v in top.items() if v}}).encode()))
        finally:
            out.close()

    def published(self) -> list[str]:
        """Names of the published steps in order."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(n for n in names if n.startswith("step="))

    def tree(self) -> tuple[dict[int, int], dict]:
        """Digests of the nodes of level TOP, and what else was saved with the last step (depth, folders, nodes that differed)."""
        steps = self.published()
        if not steps:
            raise RuntimeError("the tracker has no base; call start() first")
        stream = self.fs.open(self._path(f"{steps[-1]}/_tree.json"))
        try:
            size = self.fs.getFileStatus(self._path(f"{steps[-1]}/_tree.json")).getLen()
            raw = bytearray(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
        finally:
            stream.close()
        said = json.loads(bytes(raw))
        return {int(k): v for k, v in said.pop("leaves").items()}, said

    def _rows(self, steps: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).option("basePath", self.folder).parquet(*[f"{self.folder}/{s}" for s in steps])

    def _staged(self, staged: str) -> DataFrame:
        return self.spark.read.schema("key bigint, leaf bigint, digest string, delta bigint, part int").parquet(f"{self.folder}/{staged}")

    def _open_steps(self) -> list[str]:
        steps = self.published()
        return steps[max(i for i, s in enumerate(steps) if s.endswith("-base")) :]

    def state(self, parts: list[int] | None = None) -> DataFrame:
        """key, leaf, digest as last processed; of the folders in parts only, if these are given."""
        steps = self._open_steps()
        rows = self._rows(steps)
        if parts is not None:
            rows = rows.filter(F.col("part").isin(parts))
        if len(steps) == 1:
            return rows.select("key", "leaf", "digest")
        return rows.groupBy("key", "leaf").agg(F.max_by("digest", "step").alias("digest"))

    def leaves(self) -> DataFrame:
        """leaf, saved (digest): the base's leaves, and over them what the runs since changed."""
        base, *runs = self._open_steps()
        rows = self.spark.read.schema("leaf bigint, x bigint").parquet(f"{self.folder}/{base}/_leaves")
        if runs:
            rows = rows.unionByName(self._rows(runs).select("leaf", F.col("delta").alias("x"))).groupBy("leaf").agg(F.bit_xor("x").alias("x"))
        return rows.select("leaf", F.col("x").alias("saved"))

    def _write_base(self, staged: str, rows: DataFrame, depth: int, parts: int) -> dict[int, int]:
        """Write rows (key, leaf, digest) as a base with its leaves; the digests of the nodes of level TOP come back."""
        part = F.floor(F.shiftright("leaf", 4 * (depth - TOP)) * parts / LEAVES).cast("int")
        rows = rows.select("key", "leaf", "digest", F.xxhash64("key", "digest").alias("delta"), part.alias("part"))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{staged}")
        saved = self._staged(staged)
        saved.groupBy("leaf").agg(F.bit_xor("delta").alias("x")).write.mode("overwrite").parquet(f"{self.folder}/{staged}/_leaves")
        return self._top(saved, F.col("delta"), depth)

    def _top(self, rows: DataFrame, x: F.Column, depth: int) -> dict[int, int]:
        got = rows.groupBy(F.shiftright("leaf", 4 * (depth - TOP)).alias("n")).agg(F.bit_xor(x).alias("x")).collect()  # at most LEAVES rows
        return {r["n"]: r["x"] for r in got if r["x"]}

    def start(self, base: DataFrame) -> None:
        """Publish what counts as processed at the start; nothing happens if there is a base already."""
        if self.published():
            return
        staged = f".staged-{hashlib.sha256(self.folder.encode()).hexdigest()[:8]}-base"
        rows = base.filter("key IS NOT NULL").groupBy("key").agg(F.max("digest").alias("digest")).filter("digest IS NOT NULL")
        n = base.agg(F.approx_count_distinct("key")).first()[0]
        depth, parts = depth_for(n), min(LEAVES, -(-n // FOLDER_KEYS) or 1)
        top = self._write_base(staged, rows.select("key", leaf_of(F.col("key"), depth).alias("leaf"), "digest"), depth, parts)
        self._write_tree(staged, top, {"run": None, "depth": depth, "parts": parts})
        self._publish(staged, "step=000000-base")

    def process(self, run: str, reported: DataFrame) -> DataFrame:
        """Publish and return the keys (column key) of reported (key, digest, one row a key) that are new or changed.

        A null digest is passed over. The keys come out exactly once over all runs, however often a run is broken off.
        """
        steps = self.published()
        done = [s for s in steps if s.endswith(f"-run-{run}")]
        if done:
            return self._rows(done).select("key")
        top, said = self.tree()
        depth, parts, staged = said["depth"], said["parts"], f".staged-{run}"
        new = reported.filter("key IS NOT NULL AND digest IS NOT NULL").select("key", leaf_of(F.col("key"), depth).alias("leaf"), F.col("digest").alias("new"))
        told = F.bit_xor(F.xxhash64("key", "new")).over(Window.partitionBy("leaf"))  # a leaf has about one key
        unlike = new.withColumn("told", told).join(self.leaves(), "leaf", "left").filter("NOT (told <=> saved)")
        unlike.select("key", "leaf", "new", "told", "saved").write.mode("overwrite").parquet(f"{self.folder}/{staged}-unlike")
        unlike = self.spark.read.schema("key bigint, leaf bigint, new string, told bigint, saved bigint").parquet(f"{self.folder}/{staged}-unlike")
        each = unlike.groupBy("leaf").agg(F.max("told").alias("told"), F.max("saved").alias("saved"))
        seen = self._top(each, F.col("told").bitwiseXOR(F.coalesce("saved", F.lit(0))), depth)
        nodes = differing_leaves(build_tree({**top, **{k: top.get(k, 0) ^ x for k, x in seen.items()}}), build_tree(top))
        inside = sorted({n * parts // LEAVES for n in nodes})
        there = self.state(inside).select(F.col("key").alias("_key"), F.col("digest").alias("old"))
        rows = unlike.join(there, unlike["key"] == there["_key"], "left").filter("NOT (new <=> old)")
        delta = F.xxhash64("key", "new").bitwiseXOR(F.when(F.col("old").isNotNull(), F.xxhash64("key", "old")).otherwise(F.lit(0)))
        part = F.floor(F.shiftright("leaf", 4 * (depth - TOP)) * parts / LEAVES).cast("int")
        rows = rows.select("key", "leaf", F.col("new").alias("digest"), delta.alias("delta"), part.alias("part"))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{staged}")
        for n, x in self._top(self._staged(staged), F.col("delta"), depth).items():
            top[n] = top.get(n, 0) ^ x
        self.fs.delete(self._path(f"{staged}-unlike"), True)
        self._write_tree(staged, top, {"run": run, "depth": depth, "parts": parts, "nodes": len(nodes)})
        name = f"step={len(steps):06d}-run-{run}"
        self._publish(staged, name)
        if (len(steps) % self.compact_every) == 0:
            self._compact()
        return self._rows([name]).select("key")

    def _compact(self) -> None:
        """Fold the runs' changes into a new base, whose depth and folders follow the number of keys there are now."""
        staged, step = ".staged-compact", len(self.published())
        rows = self.state().filter("digest IS NOT NULL")
        n = rows.agg(F.approx_count_distinct("key")).first()[0]
        depth, parts = depth_for(n), min(LEAVES, -(-n // FOLDER_KEYS) or 1)
        top = self._write_base(staged, rows.select("key", leaf_of(F.col("key"), depth).alias("leaf"), "digest"), depth, parts)
        self._write_tree(staged, top, {"run": None, "depth": depth, "parts": parts})
        self._publish(staged, f"step={step:06d}-base")


def succeeded_runs(spark, sf_dir: str) -> list[tuple]:
    """(run_id, after, up to) of the succeeded runs in order; index_runs is a control table with a row a run."""
    rows = table(spark, sf_dir, "index_runs").filter("run_status = 'succeeded' AND started_at IS NOT NULL").select("run_id", F.col("started_at").cast("string").alias("at")).distinct()
    ordered = sorted((r["at"], r["run_id"]) for r in rows.collect())
    return [(run, ordered[i - 1][0] if i else None, at) for i, (at, run) in enumerate(ordered)]


def p6_found(spark, sf_dir: str) -> DataFrame:
    """run_id, artifact_id: what each succeeded run has to process, made run by run as the runs did."""
    tracker = ChangeTracker(spark, fresh_path(spark, "tracker"))
    base = table(spark, sf_dir, "artifacts").select(F.col("id").alias("key"), F.when(F.col("indexed_at").isNotNull(), F.lower("content_hash")).alias("digest"))
    tracker.start(base)
    scans = table(spark, sf_dir, "artifact_scans").filter("content_hash IS NOT NULL AND artifact_id IS NOT NULL")
    found = []
    for run, after, upto in succeeded_runs(spark, sf_dir):
        covered = scans.filter(F.col("arrived_at") <= F.lit(upto).cast("timestamp_ntz"))
        if after is not None:
            covered = covered.filter(F.col("arrived_at") > F.lit(after).cast("timestamp_ntz"))
        last = covered.groupBy(F.col("artifact_id").alias("key")).agg(F.max_by(F.lower("content_hash"), F.struct("arrived_at", "scan_id")).alias("digest"))
        found.append(tracker.process(str(run), last).select(F.lit(run).cast("bigint").alias("run_id"), F.col("key").alias("artifact_id")))
    if not found:
        return spark.createDataFrame([], "run_id bigint, artifact_id bigint")
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


QUERIES = {"p6_found": p6_found}
SQL = {
    "p6_found": """
WITH runs AS (SELECT run_id, started_at AS upto, lag(started_at) OVER (ORDER BY started_at) AS after FROM (SELECT DISTINCT run_id, started_at FROM index_runs WHERE run_status = 'succeeded')),
last AS (
  SELECT runs.run_id, runs.upto, s.artifact_id, arg_max(lower(s.content_hash), (s.arrived_at, s.scan_id)) AS h
  FROM artifact_scans s JOIN runs ON s.arrived_at <= runs.upto AND (runs.after IS NULL OR s.arrived_at > runs.after)
  WHERE s.content_hash IS NOT NULL GROUP BY ALL
),
base AS (SELECT id, max(CASE WHEN indexed_at IS NOT NULL THEN lower(content_hash) END) AS h FROM artifacts GROUP BY id),
steps AS (SELECT last.*, coalesce(lag(last.h) OVER (PARTITION BY last.artifact_id ORDER BY last.upto), base.h) AS before FROM last LEFT JOIN base ON base.id = last.artifact_id)
SELECT run_id, artifact_id FROM steps WHERE before IS DISTINCT FROM h
"""
}
