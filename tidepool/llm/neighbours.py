"""Problem 5: most similar vectors for every vector, by a permutation index.

Each vector is represented by its nearest pivots in order. It is posted in the inverted files of the first of them; files
that grow too large are split by pivots of their own, level by level. Inside a file every member is compared with all others
by cosine (or, where a number to rerank is given, with the first of them by Spearman's footrule between the prefixes); a
vector's best over all its files are its neighbours. Exact copies of a vector are one member, and are given back at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import cut, table

#: Pivots in a vector's prefix, by which the footrule ranks, and the first of them, in whose files it is posted at least; in how
#: many more is measured on SAMPLED vectors of a group, so that RECALL of their neighbours share a file with them.
PREFIX = 12
POSTED = 5
MOST_POSTED, SAMPLED, RECALL = 24, 200, 0.97
#: Members that a file should have: it makes the number of pivots follow the number of vectors. As many vectors or fewer are
#: one file, and their answer is exact. The first level has MOST_PIVOTS pivots at most; files of SPLIT_FILES times FILE_ROWS
#: members, be it by the number of vectors or because many are near each other, get pivots of their own, to the LOCAL_POSTED
#: nearest of which their members are posted, for MOST_LEVELS levels: members whose pivots can't tell them apart stay together.
FILE_ROWS = 8_000
MOST_PIVOTS = 4_096
SPLIT_FILES, LOCAL_POSTED, MOST_LEVELS = 4, 3, 6
#: A file is worked off in blocks of so many members, of fewer where BLOCK_CELLS cosines are reached, against all its members.
BLOCK_ROWS = 2_048
BLOCK_CELLS = 1 << 24
#: Stripes of a file of which only the k with the highest cosines are looked into for the k best.
STRIPES = 32


def usable(vectors: DataFrame) -> DataFrame:
    """grp (model and dimension), id, v (the vector at length one, as bytes of float32) of the rows of vectors (chunk_id,
    model_id, dimension, embedding) that count: without nulls, of exactly dimension finite elements, not all zero."""

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            lists = b.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = lists.offsets.to_numpy()[:-1]
            ids, groups, out = [], [], []
            for n in np.unique(dims):
                rows = np.flatnonzero((dims == n) & (sizes == n))
                if n <= 0 or not len(rows):
                    continue
                x = flat[starts[rows][:, None] + np.arange(int(n))]
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(x).all(axis=1) & (top > 0)
                rows, x = rows[ok], x[ok] / top[ok][:, None]
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                ids.append(b.column(0).take(pa.array(rows)))
                groups.append(pa.array([f"{m}\x1f{int(n)}" for m in b.column(1).take(pa.array(rows)).to_pylist()], pa.string()))
                out.append(pa.array([r.tobytes() for r in x], pa.binary()))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(groups), pa.concat_arrays(ids), pa.concat_arrays(out)], names=["grp", "id", "v"])

    rows = vectors.select("chunk_id", "model_id", F.col("dimension").cast("int").alias("dimension"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.dropna().filter((F.size("embedding") == F.col("dimension")) & ~F.exists("embedding", lambda x: x.isNull()))
    return rows.mapInArrow(run, "grp string, id string, v binary")


def _matrix(column, kind=np.float32) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _unit(column) -> np.ndarray:
    x = _matrix(column, np.int16).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best_columns(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, greatest first. Each of them is in one of the k stripes with the greatest maxima."""
    n, m = cos.shape
    wide = m // STRIPES
    if wide <= k:
        return np.argsort(-cos, axis=1, kind="stable")[:, :k]
    tops = cos[:, : wide * STRIPES].reshape(n, STRIPES, wide).max(axis=1)
    stripes = np.argpartition(tops, wide - k, axis=1)[:, wide - k :]
    columns = (stripes[:, :, None] + np.arange(STRIPES) * wide).reshape(n, -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(wide * STRIPES, m), (n, m - wide * STRIPES))], axis=1)
    order = np.argsort(-np.take_along_axis(cos, columns, 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(columns, order, 1)


def best_of_file(x: np.ndarray, prefix: np.ndarray | None, k: int, reranked: int | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, other, cosine): of each member of a file its k most similar, cosines of least or more.

    Without reranked, or where it takes in the whole file, all members are compared; else the reranked first by footrule.
    The footrule of two prefixes of length n, absent pivots standing at n, is n * (n + 1) less twice the sum over common
    pivots of the smaller closeness n - position: more of that sum is nearer.
    """
    m = len(x)
    if reranked is None or reranked >= m - 1:
        return _best_of_all(x, k, least)
    n = prefix.shape[1]
    pivots, local = np.unique(prefix, return_inverse=True)
    local = local.reshape(m, n)
    close = np.zeros((len(pivots), m), np.uint8)
    for pos in range(n):
        close[local[:, pos], np.arange(m)] = n - pos
    found = []
    for a in range(0, m, BLOCK_ROWS):
        rows = slice(a, min(m, a + BLOCK_ROWS))
        near = np.zeros((rows.stop - a, m), np.uint8)
        for pos in range(n):
            near += np.minimum(close[local[rows, pos]], n - pos)
        near[np.arange(rows.stop - a), np.arange(a, rows.stop)] = 0
        keep = min(reranked, m - 1)
        if keep <= 0:
            continue
        best = np.argpartition(near, m - keep, axis=1)[:, m - keep :] if keep < m else np.broadcast_to(np.arange(m), near.shape)
        cos = np.einsum("ijk,ik->ij", x[best], x[rows], optimize=True)
        cos[best == np.arange(a, rows.stop)[:, None]] = -2
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        cos, best = np.take_along_axis(cos, order, 1), np.take_along_axis(best, order, 1)
        ok = cos >= max(least, -1.5)
        i, j = np.nonzero(ok)
        found.append((i + a, best[i, j], cos[i, j]))
    if not found:
        return np.array([], int), np.array([], int), np.array([], np.float32)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best_of_all(x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, found = len(x), []
    step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, m)))
    for a in range(0, m, step):
        cos = x[a : a + step] @ x.T
        cos[np.arange(len(cos)), np.arange(a, a + len(cos))] = -2
        best = _best_columns(cos, k)
        cos = np.take_along_axis(cos, best, 1)
        i, j = np.nonzero(cos >= max(least, -1.5))
        found.append((i + a, best[i, j], cos[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def posted_for(heads: DataFrame, pivots, k: int, least: float, floor: int, seed: int) -> dict[str, int]:
    """In how many files the vectors of each group have to be posted, floor or more and MOST_POSTED at most, so that RECALL of
    the neighbours that SAMPLED vectors of a group have (their exact k best among all heads, with cosines of least or more)
    share a file with them. pivots: a broadcast of the groups' pivots."""
    probes: dict[str, np.ndarray] = {}
    for grp, p in pivots.value.items():
        if len(p) > floor:
            part = heads.filter(F.col("grp") == grp).select("v", F.xxhash64(F.lit(seed + 3), "v").alias("h")).orderBy("h").limit(SAMPLED)
            x = [bytes(r["v"]) for r in part.collect()]  # at most SAMPLED
            probes[grp] = np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1)
    if not probes:
        return {}
    shared = heads.sparkSession.sparkContext.broadcast(probes)

    def near(batches):
        for b in batches:
            groups = np.array(b.column(0).to_pylist(), dtype=object)
            for grp in np.unique(groups):
                if grp not in shared.value:
                    continue
                part = b.take(pa.array(np.flatnonzero(groups == grp)))
                x, q, p = _matrix(part.column(1)), shared.value[grp], pivots.value[grp]
                cos = q @ x.T
                best = _best_columns(np.where(cos > 0.999999, -2, cos), k)  # itself is no neighbour
                i, j = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                depth = min(MOST_POSTED, len(p))
                files = np.argsort(-(x[j] @ p.T), axis=1, kind="stable")[:, :depth].astype(np.int32)
                ok = cos[i, j] >= least
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ok.sum() * depth + 1, depth, dtype=np.int32)), pa.array(files[ok].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([grp] * int(ok.sum()), pa.string()), pa.array(i[ok].astype(np.int32)), pa.array(cos[i, j][ok].astype(np.float64)), lists], names=["grp", "q", "cos", "files"])

    w = Window.partitionBy("grp", "q").orderBy(F.col("cos").desc())
    found = heads.select("grp", "v").mapInArrow(near, "grp string, q int, cos double, files array<int>").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)
    met: dict[str, list[int]] = {}
    for r in found.select("grp", "q", "files").collect():  # at most SAMPLED * k rows a group
        p = pivots.value[r["grp"]]
        own = np.argsort(-(p @ probes[r["grp"]][r["q"]]), kind="stable")[:MOST_POSTED].tolist()
        # the least depth at which both prefixes have a pivot in common
        met.setdefault(r["grp"], []).append(min((max(own.index(f), at) + 1 for at, f in enumerate(r["files"]) if f in own), default=MOST_POSTED + 1))
    return {grp: int(min(MOST_POSTED, max(floor, np.quantile(depths, RECALL, method="higher")))) for grp, depths in met.items()}


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, prefix: int = PREFIX, posted: int = POSTED, file_rows: int = FILE_ROWS, reranked: int | None = None, seed: int = 0) -> DataFrame:
    """chunk_id, neighbour_id, similarity, position: of each usable vector its k most similar of the same model and
    dimension, ties by id, with a cosine of least or more.

    vectors: chunk_id (unique), model_id, dimension, embedding. Which rows count: see usable; others neither get nor are
    neighbours. Repeated rows count once. Pivots are a seeded sample of at most MOST_PIVOTS vectors of each model and
    dimension, and of each file that is too large for one task; every vector is posted, its elements as 16-bit numbers, which
    changes cosines by about 3e-6, in the files of its posted nearest pivots, or more (see posted_for). A pair is found if the
    two share a file; up to file_rows vectors of a model and dimension are one file. With reranked, only so many members
    of a file, the first by footrule, are compared with each. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(usable(vectors), "vectors")
    # only vectors whose hash stands in several rows travel to be compared; the others are their own heads
    rows = rows.withColumn("h", F.xxhash64("v"))
    again = cut(rows.groupBy("grp", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", "h"), "again")
    same = rows.join(again, ["grp", "h"], "left_semi").groupBy("grp", "v").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    heads = rows.join(again, ["grp", "h"], "left_anti").select("grp", "v", "id", F.col("id").alias("last")).unionByName(same)
    sizes = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a model and dimension
    pivots: dict[str, np.ndarray] = {}
    for grp, n in sizes.items():
        count = 1 if n <= file_rows else int(min(MOST_PIVOTS, -(-n * posted // file_rows)))
        part = rows.filter(F.col("grp") == grp).select("v", F.xxhash64(F.lit(seed), "v").alias("h")).filter(F.pmod("h", F.lit(1_000_003)) <= 1_000_003 * min(1.0, 4 * (count + 64) / n))
        taken = part.distinct().orderBy("h").limit(count).select("v").collect()  # at most MOST_PIVOTS
        pivots[grp] = np.frombuffer(b"".join(bytes(r["v"]) for r in taken), np.float32).reshape(len(taken), -1)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    depth = posted_for(heads, shared, k, least, posted, seed)

    def post(batches):
        for b in batches:
            groups = np.array(b.column(0).to_pylist(), dtype=object)
            for grp in np.unique(groups):
                at = np.flatnonzero(groups == grp)
                for piece in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                    part = b.take(pa.array(piece))
                    x, p = _matrix(part.column(2)), shared.value[grp]
                    deep = depth.get(grp, posted)
                    n = min(max(prefix, deep) if reranked is not None else deep, len(p))
                    cos = x @ p.T
                    best = np.argpartition(-cos, n - 1, axis=1)[:, :n]
                    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(cos, best, 1), axis=1, kind="stable"), 1).astype(np.int16)
                    files = min(deep, n)
                    times = pa.array(np.repeat(np.arange(len(piece)), files))
                    small = pa.array([r.tobytes() for r in np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16)], pa.binary())
                    perm = pa.array([r.tobytes() if reranked is not None else None for r in best], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(times), pa.array(best[:, :files].ravel().astype(str).astype(object), pa.string()), part.column(1).take(times), perm.take(times), small.take(times)], names=["grp", "file", "id", "perm", "v"])

    files = heads.select("grp", "id", "v").mapInArrow(post, "grp string, file string, id string, perm binary, v binary")
    for _ in range(MOST_LEVELS):
        # sizes are taken from a sample of the members; of a file at the limit it has about a hundred
        rate = min(1.0, 100 / (SPLIT_FILES * file_rows))
        part = files.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1_000_003)) < 1_000_003 * rate)
        large = part.groupBy("grp", "file").agg((F.count(F.lit(1)) / rate).alias("size")).filter(F.col("size") > SPLIT_FILES * file_rows)
        large = cut(large, "large")
        if large.isEmpty():
            break
        files = cut(_split_files(files, large, file_rows, seed), "files")

    def file(group: pa.Table) -> pa.Table:
        x = _unit(group.column("v"))
        perm = _matrix(group.column("perm"), np.int16) if reranked is not None else None
        i, j, cos = best_of_file(x, perm, k, reranked, least)
        ids = group.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(cos.astype(np.float64))], names=["chunk_id", "neighbour_id", "similarity"])

    near = files.groupBy("grp", "file").applyInArrow(file, "chunk_id string, neighbour_id string, similarity double")
    near = near.groupBy("chunk_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    near = cut(_first(near, k), "near")
    return _with_copies(near, rows, same, k, least)


def _split_files(files: DataFrame, large: DataFrame, file_rows: int, seed: int) -> DataFrame:
    """files, the members of large ones (grp, file, size) posted again inside their file: to the LOCAL_POSTED nearest of
    pivots drawn from the file itself, as many as make files of about file_rows members. A large file's members are spread
    over salts, to each of which its pivots go."""
    count = F.ceil(F.col("size") * LOCAL_POSTED / file_rows).cast("int")
    large = large.select("grp", "file", count.alias("pivots"), F.ceil(F.col("size") / (4 * file_rows)).cast("int").alias("salts"), "size")
    joined = files.join(large.hint("merge") if large.count() > MOST_PIVOTS * 16 else F.broadcast(large), ["grp", "file"], "left")
    kept = joined.filter("size IS NULL").select(files.columns)
    inside = joined.filter("size IS NOT NULL")
    h = F.pmod(F.xxhash64(F.lit(seed + 2), "v"), F.lit(1_000_003)).alias("h")
    some = inside.filter(h <= 1_000_003 * F.least(F.lit(1.0), 4 * (F.col("pivots") + 16) / F.col("size"))).select("grp", "file", "pivots", "salts", "v", h).distinct()
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("grp", "file").orderBy("h", "v"))).filter("at <= pivots")
    pivots = some.select(F.col("grp").alias("own_grp"), F.col("file").alias("own_file"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("own_salt"), F.col("v").alias("pivot"))
    members = inside.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("grp", "file", "salt", "id", "perm", "v")

    def post(group: pa.Table, own: pa.Table) -> pa.Table:
        p = _unit(own.column("pivot"))
        n, best = min(LOCAL_POSTED, len(p)), []
        for i in range(0, group.num_rows, 4096):
            best.append(np.argsort(-(_unit(group.column("v").slice(i, 4096)) @ p.T), axis=1, kind="stable")[:, :n])
        times = pa.array(np.repeat(np.arange(group.num_rows), n))
        name = group.column("file")[0].as_py() if group.num_rows else ""
        below = pa.array([f"{name}.{k}" for k in np.concatenate(best).ravel().tolist()] if best else [], pa.string())
        return pa.table([group.column("grp").take(times), below, *[group.column(c).take(times) for c in ("id", "perm", "v")]], names=["grp", "file", "id", "perm", "v"])

    split = members.groupBy("grp", "file", "salt").cogroup(pivots.groupBy("own_grp", "own_file", "own_salt")).applyInArrow(post, "grp string, file string, id string, perm binary, v binary")
    return kept.unionByName(split)


def _first(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy(F.col("similarity").desc(), "neighbour_id")
    return pairs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _with_copies(near: DataFrame, rows: DataFrame, same: DataFrame, k: int, least: float) -> DataFrame:
    """near of heads, given to their exact copies as well: a member's candidates are the first k + 1 members of its own head
    and the first k of each neighbouring head. Copies are never paired beyond that."""
    several = cut(same.filter("id <> last").select("grp", "v", F.col("id").alias("head")), "copied")
    copies = rows.join(several, ["grp", "v"]).select("head", "id").distinct()
    w = Window.partitionBy("head").orderBy("id")
    first = copies.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1)
    other = F.coalesce("id", "neighbour_id")
    wide = near.join(first.select(F.col("head").alias("neighbour_id"), "id"), "neighbour_id", "left").select("chunk_id", other.alias("neighbour_id"), "similarity")
    wide = wide.join(copies.select(F.col("head").alias("chunk_id"), "id"), "chunk_id", "left").select(F.coalesce("id", "chunk_id").alias("chunk_id"), "neighbour_id", "similarity")
    own = copies.join(first.select("head", F.col("id").alias("neighbour_id")), "head").filter("id <> neighbour_id").select(F.col("id").alias("chunk_id"), "neighbour_id", F.lit(1.0).alias("similarity"))
    return _first(wide.unionByName(own.filter(F.lit(1.0 >= least))), k)


def p5_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five most similar of every vector with their cosines, however low."""
    return nearest(table(spark, sf_dir, "vector_chunks"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "vector_chunks"), least=0.85)
    return near.select(F.least("chunk_id", "neighbour_id").alias("chunk_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
_NEAR_SQL = """
WITH v AS (SELECT DISTINCT chunk_id, model_id || '-' || dimension AS grp, CAST(embedding AS DOUBLE[]) AS x FROM vector_chunks WHERE chunk_id IS NOT NULL AND model_id IS NOT NULL AND len(embedding) = dimension AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
c AS (SELECT a.chunk_id AS chunk_id, b.chunk_id AS neighbour_id, list_cosine_similarity(a.x, b.x) AS cos FROM v a JOIN v b ON a.grp = b.grp AND a.chunk_id <> b.chunk_id),
near AS (SELECT chunk_id, neighbour_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY cos DESC, neighbour_id) AS place FROM c) WHERE place <= 5)
"""
SQL = {"p5_found": _NEAR_SQL + "SELECT DISTINCT least(chunk_id, neighbour_id) AS chunk_a, greatest(chunk_id, neighbour_id) AS chunk_b FROM near WHERE cos >= 85e-2"}
