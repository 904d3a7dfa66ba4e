"""Problem 10: long exact spans shared between records, by super-k-mers.

Every window of LENGTH characters has a minimiser: the smallest hash of the m-character strings in it. Consecutive
windows with the same minimiser make one super-k-mer. First only the minimisers travel, and those of a single text are
dropped; then the super-k-mers of the others travel to the minimiser's bucket as one packed string each, where their
windows are sorted and counted exactly. A bucket's result is, for each window that several texts have, the set of these
texts; equal sets are one group, however many windows they share. Copies of a text are one text until the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import cut, table

LENGTH = 200
#: Characters hashed for a minimiser.
MINIMISER = 64
#: A bucket of more windows is sorted in several tasks: a part's different windows travel once, as digests.
BUCKET_WINDOWS = 400_000
#: Buckets that are so split at most; more than one part in as many of all windows is never one task's.
MOST_SPLIT = 1_000_000
#: Windows of small buckets that are sorted together.
TOGETHER = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of them."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _tables:
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _tables[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[size]


def string_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of m codes."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=sums[1:])
    h = (sums[m:] - sums[:-m]) * down[: len(codes) - m + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima of blocks of w from both sides."""
    n = len(a)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def super_kmers(texts: list[str], length: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, start, windows, minimiser) of the super-k-mers of texts that have length characters or more."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    least = sliding_min(string_hashes(codes, m), length - m + 1)
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes - length + 1
    # of the joined texts' windows only those inside one text count
    offset = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = np.arange(int(n.sum())) + offset
    value = least[at]
    fresh = np.empty(len(value), bool)
    fresh[0] = True
    np.not_equal(value[1:], value[:-1], out=fresh[1:])
    fresh[np.cumsum(n)[:-1]] = True
    first = np.flatnonzero(fresh)
    which = np.repeat(np.arange(len(texts)), n)[first]
    return which, at[first] - begin[which], np.diff(np.append(first, len(value))), value[first]


def _batches(texts: list[str], most: int = 400_000):
    """Runs of texts of about most characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _minimisers(docs: DataFrame, length: int, m: int) -> DataFrame:
    """id, key (hash of the text), bucket (minimiser), start, windows."""

    def run(batches):
        for b in batches:
            ids, keys, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for i, j in _batches(texts):
                which, start, windows, value = super_kmers(texts[i:j], length, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][which]), pa.array(keys[i:j][which]), pa.array(value.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=["id", "key", "bucket", "start", "windows"],
                )

    return docs.select("id", "key", "text").mapInArrow(run, "id bigint, key bigint, bucket bigint, start int, windows int")


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    h = (ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_of(ids) -> tuple[int, int, int]:
    """(two fingerprints, number) of a set of ids: the fingerprints of disjoint sets join by exclusive or."""
    x = np.array(sorted(set(ids)), np.int64)
    a, b = (int(np.bitwise_xor.reduce(_mixed(x, seed)).view(np.int64)) for seed in (1, 2))
    return a, b, len(x)


def equal_windows(ids: list[int], starts: list[int], packed: list[str], length: int, several: bool = True):
    """Of super-k-mers: each string of length characters in them (of different ids, where several), with the (id, start) it
    stands at. Windows are sorted by a hash, and those of equal hashes told apart as strings."""
    sizes = np.array([len(t) for t in packed])
    codes = np.frombuffer("".join(packed).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    which = np.repeat(np.arange(len(packed)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    h = string_hashes(codes, length)[begin[which] + inner]
    order = np.argsort(h, kind="stable")
    h, which, inner = h[order], which[order], inner[order]
    edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    owner = np.array(ids)[which]
    if several:  # of runs of equal hashes only those of different ids
        keep = np.minimum.reduceat(owner, edges[:-1]) < np.maximum.reduceat(owner, edges[:-1])
    else:
        keep = np.ones(len(edges) - 1, bool)
    for a, b in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), strict=True):
        same: dict[str, list] = {}
        for w, k in zip(which[a:b].tolist(), inner[a:b].tolist(), strict=True):
            same.setdefault(packed[w][k : k + length], []).append((ids[w], starts[w] + k))
        for text, at in same.items():
            if not several or any(i != at[0][0] for i, _ in at):
                yield text, at


class _Found:
    """What is found in a bucket: by id the shared windows' starts, and the sets of ids that share a window."""

    schema = "class bigint, a bigint, b bigint, n int, start int, end int"

    def __init__(self):
        self.starts: dict[int, list] = {}
        self.sets: set[tuple] = set()

    def table(self, length: int) -> pa.Table:
        out = [(i, *s, None, None) for i, s in sorted(self.sets)]
        for i, starts in self.starts.items():
            starts = sorted(set(starts))
            cuts = [0, *[k for k in range(1, len(starts)) if starts[k] > starts[k - 1] + 1], len(starts)]
            out += [(i, None, None, None, starts[x], starts[y - 1] + length) for x, y in zip(cuts, cuts[1:], strict=False)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["class", "a", "b", "n", "start", "end"])


def _packed(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """id, bucket, start, packed (the super-k-mer as one string): a text meets its super-k-mers once and is cut up in one go."""

    def run(batches):
        for b in batches:
            for i, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pieces = [text[p["start"] : p["start"] + p["windows"] + length - 1] for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(parts), pa.int64()), pa.array([p["bucket"] for p in parts], pa.int64()), pa.array([p["salt"] for p in parts], pa.int32()), pa.array([p["start"] for p in parts], pa.int32()), pa.array(pieces, pa.string())],
                    names=["id", "bucket", "salt", "start", "packed"],
                )

    parts = wanted.groupBy("id").agg(F.collect_list(F.struct("bucket", "salt", "start", "windows")).alias("parts"))
    return texts.join(parts, "id").select("id", "text", "parts").mapInArrow(run, "id bigint, bucket bigint, salt int, start int, packed string")


def _columns(group: pa.Table) -> tuple[list, list, list]:
    return group.column("id").to_pylist(), group.column("start").to_pylist(), group.column("packed").to_pylist()


def _split_buckets(packed: DataFrame, length: int) -> DataFrame:
    """What is shared in buckets that are spread over salts: each part gives its different windows once, as 128-bit digests
    with the set of ids; windows whose parts together have several ids go back to these parts."""

    def digests(group: pa.Table) -> pa.Table:
        ids, starts, pieces = _columns(group)
        out = []
        for text, at in equal_windows(ids, starts, pieces, length, several=False):
            a, b, n = set_of(i for i, _ in at)
            out.append((hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), a, b, n, min(at)[0], max(at)[0]))
        cols = list(zip(*out, strict=True))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        keys = [pa.array([group.column(k)[0].as_py()] * len(out), t) for k, t in (("bucket", pa.int64()), ("salt", pa.int32()))]
        return pa.table([*keys, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["bucket", "salt", "d", "a", "b", "n", "lo", "hi"])

    seen = cut(packed.groupBy("bucket", "salt").applyInArrow(digests, "bucket bigint, salt int, d binary, a bigint, b bigint, n int, lo bigint, hi bigint"), "digests")
    both = seen.groupBy("bucket", "d").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").cast("int").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    back = seen.select("bucket", "salt", "d").join(both.select("bucket", "d", "a", "b", "n"), ["bucket", "d"])

    def place(group: pa.Table, shared: pa.Table) -> pa.Table:
        found = _Found()
        sets = {r["d"]: (r["a"], r["b"], r["n"]) for r in shared.to_pylist()}
        if sets and group.num_rows:
            for text, at in equal_windows(*_columns(group), length, several=False):
                s = sets.get(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                if s is not None:
                    for i, start in at:
                        found.starts.setdefault(i, []).append(start)
                        found.sets.add((i, s))
        return found.table(length)

    return packed.groupBy("bucket", "salt").cogroup(back.groupBy("bucket", "salt")).applyInArrow(place, _Found.schema)


def shared_windows(docs: DataFrame, length: int = LENGTH, m: int = MINIMISER, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: id (bigint, unique), text. Returns classes (id, class: the least id with the same text, of texts of length
    characters or more), groups (class, grp: the sets of classes that share a window, each once) and spans (class, start, end:
    stretches of a class's text made of windows that stand in another class's text as well).

    Null texts and texts shorter than length share nothing. Rows that repeat a row count once.
    """
    long = docs.filter(F.col("id").isNotNull() & (F.length("text") >= length)).select("id", "text")
    keyed = long.withColumn("key", F.xxhash64("text"))
    seen = cut(_minimisers(keyed, length, m), "minimisers")
    text_ids = long.select("id", F.md5("text").alias("digest"), F.length("text").alias("size"))
    least = text_ids.groupBy("digest", "size").agg(F.min("id").alias("class"))
    classes = cut(text_ids.join(least, ["digest", "size"]).select("id", "class").distinct(), "classes")
    common = seen.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("bucket")
    heads = classes.filter("id = class").select("id")
    wanted = cut(seen.join(common, "bucket").join(heads, "id", "left_semi").select("id", "bucket", "start", "windows").distinct(), "wanted")
    counts = wanted.groupBy("bucket").agg(F.sum("windows").alias("n"))
    n_windows = wanted.agg(F.sum("windows")).first()[0] or 0
    most = max(bucket_windows, n_windows // MOST_SPLIT)
    full = counts.filter(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("salts"))  # at most MOST_SPLIT rows
    salt = F.when(F.col("salts").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")
    salted = wanted.join(F.broadcast(full), "bucket", "left").withColumn("salt", salt).drop("salts")
    texts = long.join(wanted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    packed = _packed(salted, texts, length)

    def sort_buckets(group: pa.Table) -> pa.Table:
        found, sets = _Found(), {}
        for _, at in equal_windows(*_columns(group), length):
            ids = tuple(sorted({i for i, _ in at}))
            s = sets.get(ids)
            if s is None:
                s = sets[ids] = set_of(ids)
                found.sets.update((i, s) for i in ids)
            for i, start in at:
                found.starts.setdefault(i, []).append(start)
        return found.table(length)

    # equal windows are in one bucket, so that several buckets may be sorted together: about TOGETHER windows a call
    bins = max(1, n_windows // TOGETHER)
    found = packed.filter("salt < 0").groupBy(F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("bin")).applyInArrow(sort_buckets, _Found.schema)
    if not full.isEmpty():
        found = found.unionByName(_split_buckets(cut(packed.filter("salt >= 0"), "packed"), length))
    found = cut(found, "shared")
    groups = found.filter("n IS NOT NULL").select("class", F.concat_ws(".", "a", "b", "n").alias("grp"), "n").distinct()
    return classes, groups, found.filter("start IS NOT NULL").select("class", "start", "end")


def shared_pairs(docs: DataFrame, length: int = LENGTH, m: int = MINIMISER) -> DataFrame:
    """doc_a < doc_b: every pair of records with a window in common, copies of a text included. As many rows as there are
    such pairs; shared_groups says the same in a row for each record and set of texts."""
    classes, groups, _ = shared_windows(docs, length, m)
    a, b = groups.select("grp", F.col("class").alias("ca")), groups.select("grp", F.col("class").alias("cb"))
    between = a.join(b, "grp").filter("ca < cb").select("ca", "cb").distinct()
    left, right = classes.select(F.col("class").alias("ca"), F.col("id").alias("x")), classes.select(F.col("class").alias("cb"), F.col("id").alias("y"))
    pairs = between.join(left, "ca").join(right, "cb").select("x", "y")
    copies = left.join(right, F.col("ca") == F.col("cb")).filter("x < y").select("x", "y")
    return pairs.unionByName(copies).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_groups(docs: DataFrame, length: int = LENGTH, m: int = MINIMISER) -> DataFrame:
    """doc_id, class_id, group_id, n_classes: the sets of texts with a window in common that a record's text is in. Two
    records share a stretch exactly if they have a class or a group in common; a class without groups has a null one."""
    classes, groups, _ = shared_windows(docs, length, m)
    rows = classes.join(groups, "class", "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("grp").alias("group_id"), F.coalesce("n", F.lit(1)).alias("n_classes"))


def shared_report(docs: DataFrame, length: int = LENGTH, m: int = MINIMISER) -> DataFrame:
    """doc_id, class_id (least id with the same text), n_chars, shared_chars, share, of every record: how much of its text
    stands in another record in stretches of length characters or more. Null and short texts share nothing (class null)."""
    classes, _, spans = shared_windows(docs, length, m)
    w = Window.partitionBy("class").orderBy("start", "end")
    covered = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.distinct().withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", F.coalesce(covered, F.lit(0))), F.lit(0)))
    merged = merged.groupBy("class").agg(F.sum("fresh").alias("fresh"))
    copies = classes.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    sizes = docs.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    rows = sizes.join(classes, "id", "left").join(copies, "class", "left").join(merged, "class", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("fresh", F.lit(0))).cast("bigint")
    share = F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0)
    return rows.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("n_chars").cast("bigint").alias("n_chars"), shared.alias("shared_chars"), share.alias("share"))


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return shared_pairs(_docs(spark, sf_dir))


def p10_shares(spark, sf_dir: str) -> DataFrame:
    return shared_report(_docs(spark, sf_dir))


def p10_groups(spark, sf_dir: str) -> DataFrame:
    return shared_groups(_docs(spark, sf_dir)).groupBy("doc_id", "class_id").agg(F.count("group_id").alias("n_groups"), F.max("n_classes").alias("most_classes"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_groups": p10_groups}
_WINDOWS_SQL = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies, n FROM d WHERE n >= 200),
w AS (SELECT doc_id, k, md5(substr(text, k, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 198)) AS k FROM d WHERE n >= 200 AND doc_id IN (SELECT class_id FROM c))),
m AS (SELECT h, list_sort(list(DISTINCT doc_id)) AS ids FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)
"""
SQL = {
    "p10_found": _WINDOWS_SQL
    + """, s AS (SELECT DISTINCT ids FROM m),
p AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(ids) AS b FROM (SELECT ids, unnest(ids) AS a FROM s)) WHERE a < b),
x AS (SELECT l.doc_id AS x, r.doc_id AS y FROM p JOIN c l ON l.class_id = a JOIN c r ON r.class_id = b UNION ALL SELECT l.doc_id, r.doc_id FROM c l JOIN c r ON l.class_id = r.class_id AND l.doc_id < r.doc_id)
SELECT least(x, y) AS doc_a, greatest(x, y) AS doc_b FROM x""",
    "p10_shares": _WINDOWS_SQL
    + """, o AS (SELECT doc_id, k, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k), 200) AS step FROM w WHERE h IN (SELECT h FROM m)),
f AS (SELECT doc_id, sum(least(step, 200)) AS fresh FROM o GROUP BY doc_id),
r AS (SELECT d.doc_id, c.class_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_chars, CAST(CASE WHEN copies > 1 THEN d.n ELSE coalesce(fresh, 0) END AS BIGINT) AS shared_chars FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f ON f.doc_id = c.class_id)
SELECT *, CASE WHEN n_chars > 0 THEN shared_chars / n_chars ELSE 0e0 END AS share FROM r""",
    "p10_groups": _WINDOWS_SQL
    + """, g AS (SELECT class_id, count(*) AS sets, max(len(ids)) AS most FROM (SELECT ids, unnest(ids) AS class_id FROM (SELECT DISTINCT ids FROM m)) GROUP BY class_id)
SELECT doc_id, class_id, coalesce(sets, 0) AS n_groups, CAST(coalesce(most, 1) AS INT) AS most_classes FROM c LEFT JOIN g USING (class_id)""",
}
