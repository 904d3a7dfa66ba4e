"""Orphans, sessions and incremental runs: brute force on small tables, and the cases their docstrings define."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import incremental, orphans, sessions

REFS = "ref_table string, row_key string, ref_value string, key bigint, t bigint, extra string"
KNOWN = "id bigint, missing boolean, created bigint, t bigint"
DAY = 86_400_000_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(refs, known):
    have = {}
    for i, missing, created, _ in known:
        m, c = have.get(i, (True, None))
        have[i] = (m and bool(missing), created if c is None else c if created is None else min(c, created))
    found = {}
    for table, row_key, value, key, t, _ in refs:
        if key is None or key not in have:
            s = "missing"
        elif have[key][0]:
            s = "deleted"
        elif t is not None and have[key][1] is not None and have[key][1] > t:
            s = "late"
        else:
            continue
        old = found.get((table, row_key, value))
        found[table, row_key, value] = (s, t if old is None or old[1] is None else old[1] if t is None else min(old[1], t))
    month = lambda t: None if t is None else f"{1970 + t // DAY // 365:04d}"
    return {k: (s, month(t)) for k, (s, t) in found.items()}


def test_orphans_like_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    known = [(i, rng.random() < 0.2, rng.choice([None, rng.randrange(100) * DAY]), 5) for i in range(1, 40)]
    known += known[:5]
    refs = [("a", str(n), "7", 7, rng.randrange(120) * DAY, "x") for n in range(300)]  # a hot key
    refs += [(rng.choice("ab"), str(n), str(k), k, rng.choice([None, rng.randrange(120) * DAY]), None) for n in range(300) for k in [rng.randrange(60)]]
    refs += [("b", "n1", "n/a", None, 3 * DAY, None), ("b", "n2", "x", None, None, None)] + refs[:20]
    got = orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(known, KNOWN), heavy_rows=100).collect()
    want = brute(refs, known)
    assert {(r.ref_table, r.row_key, r.ref_value): r.ref_status for r in got} == {k: v[0] for k, v in want.items()}
    assert all((r.ref_month is None) == (want[r.ref_table, r.row_key, r.ref_value][1] is None) for r in got)


def test_orphans_of_empty_tables(spark):
    none, known = spark.createDataFrame([], REFS), spark.createDataFrame([], KNOWN)
    assert orphans.find_orphans(none, known).count() == 0
    one = spark.createDataFrame([("a", "1", "5", 5, 40 * DAY, None)], REFS)
    assert rows(orphans.find_orphans(one, known)) == [("a", "1", "5", "missing", "1970-02")]


def brute_sessions(events, gap):
    by = {}
    for source, i, t in set(events):
        if None not in (source, i, t):
            by.setdefault(source, []).append((t, i))
    out = []
    for source, es in by.items():
        es.sort()
        start = 0
        for k in range(1, len(es) + 1):
            if k == len(es) or es[k][0] - es[k - 1][0] > gap * 1_000_000:
                out.append((source, es[start][1], es[k - 1][1], k - start, es[start][0], es[k - 1][0]))
                start = k
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_like_brute_force(spark, seed):
    rng = random.Random(seed)
    events = [("hot", f"h{n}", n * 900_000_000) for n in range(200)]  # one session over 25 stretches
    events += [(rng.choice("xyz"), f"e{n:04d}", rng.randrange(400) * 1_000_000 * rng.choice([60, 600, 1800])) for n in range(400)]
    events += [("edge", "a", 0), ("edge", "b", 1_800_000_000), ("edge", "c", 3_600_000_001), (None, "n", 1), ("x", None, 1), ("x", "n", None)] + events[:30]
    df = spark.createDataFrame(events, "source string, id string, t bigint").withColumn("stretch", F.lit(1)).withColumn("first", F.lit("clash"))
    assert rows(sessions.sessionize(df)) == brute_sessions(events, 1800)
    assert sessions.sessionize(df.limit(0)).count() == 0
    assert rows(sessions.sessionize(df, 1800, 60)) == rows(sessions.sessionize(df, 1800, 10**7, most=9)) == brute_sessions(events, 1800)


def test_pointer_doubling_takes_a_long_chain_to_its_root(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 100)], "n bigint, p_n bigint")
    assert {r["p_n"] for r in sessions.double_pointers(links, ["n"]).collect()} == {0}


def test_merkle_tree_finds_what_differs():
    rng = random.Random(3)
    saved = {rng.randrange(incremental.LEAVES): rng.getrandbits(64) for _ in range(500)}
    now = dict(saved)
    changed = set(rng.sample(sorted(saved), 7))
    for k in changed:
        now[k] ^= 5
    new = next(k for k in range(incremental.LEAVES) if k not in saved)
    now[new] = 1
    assert set(incremental.differing_leaves(incremental.build_tree(now), incremental.build_tree(saved))) == changed | {new}
    assert incremental.differing_leaves(incremental.build_tree(now), incremental.build_tree(dict(now))) == []
    assert incremental.differing_leaves(incremental.build_tree({}), incremental.build_tree({})) == []


def test_runs_give_each_change_once_and_survive_failures(spark, tmp_path, monkeypatch):
    schema = "key bigint, digest string"
    t = incremental.ChangeTracker(spark, str(tmp_path / "state"), compact_every=2)
    t.start(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, "x")], schema))
    keys = lambda df: sorted(r["key"] for r in df.collect())
    first = spark.createDataFrame([(1, "a"), (2, "B2"), (3, "c"), (4, "d"), (5, None), (None, "y")], schema)
    publish = incremental.ChangeTracker._publish
    monkeypatch.setattr(incremental.ChangeTracker, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.process("r1", first)
    monkeypatch.setattr(incremental.ChangeTracker, "_publish", publish)
    again = incremental.ChangeTracker(spark, str(tmp_path / "state"), compact_every=2)
    assert keys(again.process("r1", first)) == [2, 3, 4]
    assert keys(again.process("r1", first)) == [2, 3, 4]  # asked again, not done again
    assert keys(again.process("r2", first)) == []
    assert keys(again.process("r3", spark.createDataFrame([(1, "a2"), (4, "d"), (2, "b")], schema))) == [1, 2]
    assert keys(again.process("r4", spark.createDataFrame([], schema))) == []
    assert sorted((r["key"], r["digest"]) for r in again.state().collect()) == [(1, "a2"), (2, "b"), (3, "c"), (4, "d")]


def test_runs_descend_only_where_digests_differ(spark, tmp_path):
    rows = lambda a, b, d: spark.range(a, b).select(F.col("id").alias("key"), F.concat(F.lit(d), F.col("id")).alias("digest"))
    t = incremental.ChangeTracker(spark, str(tmp_path / "state"))
    t.start(rows(0, 9000, "a"))
    assert t.tree()[1]["depth"] == incremental.depth_for(9000) == 4 and incremental.depth_for(0) == incremental.TOP
    assert t.process("same", rows(0, 9000, "a")).count() == 0 and t.tree()[1]["nodes"] == 0
    one = rows(0, 9000, "a").filter("key <> 77").unionByName(rows(77, 78, "b"))
    assert [r["key"] for r in t.process("one", one).collect()] == [77] and t.tree()[1]["nodes"] == 1
    sparse = rows(0, 9000, "a").filter("key % 100 = 3")
    assert t.process("sparse", sparse).count() == 0  # leaves reported in part are read, nothing in them differs
    top = t.tree()[0]
    t._compact()
    assert t.tree()[0] == top and t.state().count() == 9000
