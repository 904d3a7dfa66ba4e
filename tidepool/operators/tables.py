"""Changes of tables, as functions from the current rows (and what comes in) to the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.lookups import DOCUMENT_FIELDS
from tidepool.operators import memories as memories_op
from tidepool.session import cut, micros, table
from tidepool.sources import canonical


def latest_scan(scans: DataFrame) -> DataFrame:
    """The last report of each path (by arrived_at, then scan_id); paths that are null are left out."""
    w = Window.partitionBy("path").orderBy(F.col("arrived_at").desc(), F.col("scan_id").desc())
    return scans.filter("path IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def needs_index(scan: DataFrame, catalogue: DataFrame, force: bool = False) -> DataFrame:
    """scan (path, size, modified_at) with reason: new, missing, changed or forced; what the catalogue (path, size,
    modified_at, missing) has just so is left out. A null size or time differs from every value but null."""
    known = catalogue.select("path", F.col("size").alias("_size"), F.col("modified_at").alias("_at"), F.coalesce("missing", F.lit(False)).alias("_missing"), F.lit(True).alias("_known"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_at").eqNullSafe(F.col("_at"))
    reason = F.when(F.col("_known").isNull(), "new").when(F.col("_missing"), "missing").when(~same, "changed")
    if force:
        reason = F.coalesce(reason, F.lit("forced"))
    return scan.join(known, "path", "left").withColumn("reason", reason).filter("reason IS NOT NULL").drop("_size", "_at", "_missing", "_known")


def upsert_artifacts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with incoming (path and any of its columns but id, last_opened_ms, missing) laid over it by path: ids and
    last_opened_ms stay, missing becomes false. New paths get ids after the greatest, in the order of their paths, by the
    numbers of rows in ranges of paths, so that no task sees all. incoming must have a path once."""
    new = incoming.join(existing.select("path"), "path", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # written before it is counted: the ranges of a second evaluation may be others
    ranged = new.repartitionByRange("path").sortWithinPartitions("path").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    ranged = cut(ranged, "new-paths")
    counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offset, at = {}, top + 1
    for p in sorted(counts):
        offset[p] = at
        at += counts[p]
    start = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])[F.col("_p")] if offset else F.lit(top + 1)
    fields = [c for c in existing.columns if c not in ("id", "path", "missing", "last_opened_ms")]
    given = {c for c in incoming.columns}
    types = {f.name: f.dataType for f in existing.schema}
    added = ranged.select(
        *[
            (start + F.col("_i")).cast("bigint").alias("id") if c == "id" else F.lit(False).alias("missing") if c == "missing" else F.col(c).cast(types[c]).alias(c) if c in given and c != "last_opened_ms" else F.lit(None).cast(types[c]).alias(c)
            for c in existing.columns
        ]
    )
    over = incoming.select("path", F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in fields if c in given])
    changed = existing.join(over, "path", "left").select(
        *[
            F.when(F.col("_in"), F.lit(False)).otherwise(F.col("missing")).alias("missing") if c == "missing" else F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(types[c]).alias(c) if c in fields and c in given else F.col(c)
            for c in existing.columns
        ]
    )
    return changed.unionByName(added)


def mark_missing(catalogue: DataFrame, present: DataFrame, folder: str | None = None) -> DataFrame:
    """catalogue with missing set where the path is not among present (path), and cleared where it is; only below folder,
    if one is given. newly_missing tells which became so now."""
    here = present.select("path").distinct().withColumn("_here", F.lit(True))
    inside = F.col("path").startswith(folder.rstrip("/") + "/") if folder else F.lit(True)
    was = F.coalesce("missing", F.lit(False))
    gone = inside & F.col("_here").isNull()
    now = F.when(gone, True).when(inside, False).otherwise(was)
    rows = catalogue.join(here, "path", "left")
    return rows.select(*[now.alias(c) if c == "missing" else F.col(c) for c in catalogue.columns], (gone & ~was).alias("newly_missing"))


def append_new(log: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of incoming whose id the log has not, one an id (the first by us); strict raises ValueError if it has any."""
    if strict and incoming.join(log, "id", "left_semi").take(1):
        raise ValueError("an id is in the log already")
    w = Window.partitionBy("id").orderBy("us")
    fresh = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return fresh.join(log.select("id"), "id", "left_anti")


def without_artifacts(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose artifact_id is not among gone (id); rows without artifact stay."""
    return rows.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti")


def replace_range(current: DataFrame, new: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """current without rows of new's ids, and without those overlapping the closed range if one is given, and new."""
    kept = current
    if start_us is not None and end_us is not None:
        kept = kept.filter((F.col("end_us") < start_us) | (F.col("start_us") > end_us))
    return kept.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def _alive(rows: DataFrame, array: str, ids: DataFrame) -> DataFrame:
    each = rows.select("id", F.explode(array).alias("_x"))
    return each.join(ids.select(F.col("id").alias("_x")), "_x", "left_semi").select("id").distinct()


def prune_episodes(episodes: DataFrame, present: DataFrame) -> DataFrame:
    """Episodes of which an artifact is among present (id); those without artifacts go."""
    return episodes.join(_alive(episodes, "artifact_ids", present), "id", "left_semi")


def prune_memories(memories: DataFrame, present: DataFrame, episodes: DataFrame) -> DataFrame:
    """Memories of which an artifact or an episode is left."""
    alive = _alive(memories, "artifact_ids", present).unionByName(_alive(memories, "episode_ids", episodes)).distinct()
    return memories.join(alive, "id", "left_semi")


def replace_chunks(current: DataFrame, artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """current without any chunk of artifacts (id), of whatever model, and new. An artifact whose text became empty has
    none left."""
    return without_artifacts(current, artifacts).unionByName(new, allowMissingColumns=True)


def without_model(chunks: DataFrame, model_id: str, dimension: int | None = None) -> DataFrame:
    """chunks without those of a model, of one dimension of it if that is given."""
    own = F.col("model_id") == model_id
    if dimension is not None:
        own = own & (F.col("dimension") == dimension)
    return chunks.filter(~F.coalesce(own, F.lit(False)))


def touch(artifacts: DataFrame, opened: DataFrame) -> DataFrame:
    """artifacts with last_opened_ms moved to the latest opening (id, ts_ms) of each, where that is later."""
    last = opened.groupBy(F.col("id").alias("_id")).agg(F.max("ts_ms").alias("_ms"))
    rows = artifacts.join(last, artifacts["id"] == last["_id"], "left").withColumn("last_opened_ms", F.greatest("last_opened_ms", "_ms"))
    return rows.select(artifacts.columns)


def recorded(feedback: DataFrame) -> DataFrame:
    """feedback with access_type: its action where that is an access, clicks and pins. One row says both, so that no failure
    leaves one without the other."""
    return feedback.withColumn("access_type", F.when(F.col("action") != "ignore", F.col("action")))


def record_feedback(query: Column, document_id: Column, action: Column, ts_ms: Column) -> list[Column]:
    """Columns of feedback to append; an action other than click, ignore and pin raises when the row is made."""
    checked = F.when(action.isin("click", "ignore", "pin"), action).otherwise(F.raise_error(F.concat(F.lit("no such action: "), action)))
    return [query.alias("query_text"), document_id.cast("string").alias("document_id"), checked.alias("action"), ts_ms.alias("ts_ms")]


def cleanup(gone: DataFrame, present: DataFrame, events: DataFrame, chunks: DataFrame, episodes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """events, chunks, episodes and memories without what hangs on artifacts that are gone (id)."""
    left = prune_episodes(episodes, present)
    return without_artifacts(events, gone), without_artifacts(chunks, gone), left, prune_memories(memories, present, left)


# Queries -----------------------------------------------------------------------------------------------------------


def _scan(spark, sf_dir: str) -> DataFrame:
    return latest_scan(table(spark, sf_dir, "artifact_scans").distinct())


def _present(spark, sf_dir: str) -> DataFrame:
    return canonical.artifacts(spark, sf_dir).filter(~F.coalesce("missing", F.lit(False))).select("id")


def incremental_diff(spark, sf_dir: str) -> DataFrame:
    return needs_index(_scan(spark, sf_dir).select("path", "size", "modified_at"), canonical.artifacts(spark, sf_dir)).select("path", "reason")


def missing_artifacts(spark, sf_dir: str) -> DataFrame:
    return mark_missing(canonical.artifacts(spark, sf_dir), _scan(spark, sf_dir), "/vault").select("id", "missing", "newly_missing")


def upserted_artifacts(spark, sf_dir: str) -> DataFrame:
    incoming = _scan(spark, sf_dir).select("path", "size", "modified_at", "content_hash")
    rows = upsert_artifacts(canonical.artifacts(spark, sf_dir).select(*DOCUMENT_FIELDS), incoming)
    return rows.select("id", "path", "size", micros(F.col("modified_at")).alias("modified_us"), "content_hash", "missing", "last_opened_ms")


def dedupe_events(spark, sf_dir: str) -> DataFrame:
    return canonical.events(spark, sf_dir).select("id", "us", "recorded_us")


def prune_dangling_episodes(spark, sf_dir: str) -> DataFrame:
    return prune_episodes(canonical.episodes(spark, sf_dir), _present(spark, sf_dir)).select("id")


def prune_dangling_memories(spark, sf_dir: str) -> DataFrame:
    """Memories left when the artifacts gone take their episodes with them."""
    present = _present(spark, sf_dir)
    episodes = canonical.episodes(spark, sf_dir)
    return prune_memories(memories_op.memories(spark, sf_dir), present, prune_episodes(episodes, present)).select("id")


def surviving_chunks(spark, sf_dir: str) -> DataFrame:
    gone = canonical.artifacts(spark, sf_dir).filter("missing").select("id")
    return without_artifacts(canonical.chunks(spark, sf_dir), gone).select("chunk_id")


_SCAN = "scan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY arrived_at DESC, scan_id DESC) AS rn FROM artifact_scans WHERE path IS NOT NULL) WHERE rn = 1)"
_BOTH = f"WITH {canonical.ARTIFACTS_SQL}, {_SCAN} "
_KEPT = f"WITH {canonical.ARTIFACTS_SQL}, {canonical.EPISODES_SQL}, here AS (SELECT id FROM art WHERE NOT coalesce(missing, false)), kept AS (SELECT id FROM ep WHERE EXISTS (SELECT 1 FROM (SELECT unnest(artifact_ids) AS a) x JOIN here ON here.id = x.a)) "
QUERIES = {f.__name__: f for f in (incremental_diff, missing_artifacts, upserted_artifacts, dedupe_events, prune_dangling_episodes, prune_dangling_memories, surviving_chunks)}
SQL = {
    "incremental_diff": _BOTH
    + "SELECT * FROM (SELECT scan.path, CASE WHEN art.path IS NULL THEN 'new' WHEN coalesce(art.missing, false) THEN 'missing' WHEN scan.size IS DISTINCT FROM art.size OR scan.modified_at IS DISTINCT FROM art.modified_at THEN 'changed' END AS reason FROM scan LEFT JOIN art ON art.path = scan.path) WHERE reason IS NOT NULL",
    "missing_artifacts": _BOTH
    + "SELECT art.id, CASE WHEN NOT starts_with(art.path, '/vault/') THEN coalesce(art.missing, false) ELSE scan.path IS NULL END AS missing, starts_with(art.path, '/vault/') AND scan.path IS NULL AND NOT coalesce(art.missing, false) AS newly_missing FROM art LEFT JOIN scan ON art.path = scan.path",
    "upserted_artifacts": _BOTH
    + """SELECT art.id, art.path, CASE WHEN scan.path IS NULL THEN art.size ELSE scan.size END AS size, epoch_us(CASE WHEN scan.path IS NULL THEN art.modified_at ELSE scan.modified_at END) AS modified_us, CASE WHEN scan.path IS NULL THEN art.content_hash ELSE scan.content_hash END AS content_hash, CASE WHEN scan.path IS NULL THEN art.missing ELSE false END AS missing, art.last_opened_ms FROM art LEFT JOIN scan ON art.path = scan.path
UNION ALL SELECT (SELECT max(id) FROM art) + row_number() OVER (ORDER BY scan.path), scan.path, scan.size, epoch_us(scan.modified_at), scan.content_hash, false, NULL FROM scan WHERE scan.path NOT IN (SELECT path FROM art WHERE path IS NOT NULL)""",
    "dedupe_events": f"WITH {canonical.EVENTS_SQL} SELECT id, epoch_us(ts) AS us, epoch_us(recorded_at) AS recorded_us FROM ev",
    "prune_dangling_episodes": _KEPT + "SELECT id FROM kept",
    "prune_dangling_memories": memories_op.MEMORIES_SQL
    + f", {canonical.ARTIFACTS_SQL}, here AS (SELECT id FROM art WHERE NOT coalesce(missing, false)) SELECT mid AS id FROM m WHERE EXISTS (SELECT 1 FROM (SELECT unnest(artifact_ids) AS a) x JOIN here ON here.id = x.a)",
    "surviving_chunks": f"WITH {canonical.ARTIFACTS_SQL} SELECT DISTINCT chunk_id FROM vector_chunks WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM art WHERE missing)",
}
