"""Value anchors of the operators: query understanding, full text, episodes, memories, filters, feedback, fusion."""

import re
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidepool.functions import clock, text
from tidepool.functions.porter import stem
from tidepool.operators.textindex import TextIndex, bucket_of
from tidepool.operators import episodes, feedback, fulltext, fusion, lookups, memories, metrics, summaries, tables, vectors
from tidepool.plans.search import Request
from tidepool.plans.understanding import resolve_time, understand

WEDNESDAY = datetime(2026, 8, 12, 10, tzinfo=UTC)
EVENT = "id string, us bigint, event_type string, artifact_id bigint, path string, app string, tags array<string>"
S = 1_000_000
T0 = 1_786_000_000 * S // (300 * S) * (300 * S)


def one(df, column):
    return df.first()[column]


@pytest.mark.parametrize(
    ("phrase", "start", "end"),
    [
        ("last Tuesday", "2026-08-11T00:00", "2026-08-11T23:59:59.999999"),
        ("last week", "2026-08-03T00:00", "2026-08-09T23:59:59.999999"),
        ("this week", "2026-08-10T00:00", "2026-08-12T23:59:59.999999"),
        ("last month", "2026-07-01T00:00", "2026-07-31T23:59:59.999999"),
        ("two days ago", "2026-08-10T00:00", "2026-08-10T23:59:59.999999"),
        ("around May", "2026-04-03T12:00", "2026-06-26T12:00"),
        ("around December", "2025-11-03T12:00", "2026-01-26T12:00"),
        ("in February 2024", "2024-02-01T00:00", "2024-02-29T23:59:59.999999"),
        ("between 10pm and 11pm on 2026-08-05", "2026-08-05T22:00", "2026-08-05T23:00"),
        ("between 12am and 12pm", "2026-08-12T00:00", "2026-08-12T12:00"),
    ],
)
def test_time_phrases(phrase, start, end):
    got = resolve_time(phrase, WEDNESDAY)
    assert got.start == datetime.fromisoformat(start).replace(tzinfo=UTC)
    assert got.end == datetime.fromisoformat(end).replace(tzinfo=UTC)


def test_time_phrases_that_mean_nothing():
    assert resolve_time("last tuesday", datetime(2026, 8, 11)).start.day == 4
    for phrase in ("", "this month", "tomorrow", "2026-02-30", "between 45pm and 3am", "between 3 and 4"):
        assert not resolve_time(phrase, WEDNESDAY).resolved


def test_understanding():
    q = understand("Find the Qdrant PDF I downloaded around May.")
    assert (q.terms, q.file_type, q.time_expression, q.intent) == (["qdrant", "downloaded"], "pdf", "around May", "search")
    assert understand("what was I working on yesterday").intent == "activity"
    assert understand("screenshot of the error").file_type == "image"
    assert understand("open retrieval.py").filename_hint == "retrieval.py"
    assert understand("  ").terms == []


def test_requests():
    assert Request.from_dict({"query": " a "}).k == 10
    for bad in ({}, {"query": " "}, {"query": "a", "k": 0}, {"query": "a", "k": True}, {"query": "a", "filters": []}, {"query": "a", "filters": {"mime_types": "x"}}, {"query": "a", "filters": {"date_from": True}}):
        with pytest.raises(ValueError):
            Request.from_dict(bad)


DOCS = [
    (1, "/a/qdrant_notes.txt", "qdrant_notes.txt", "text/plain", "Vector databases and connections are compared here", False),
    (2, "/a/plan.md", "plan.md", "text/markdown", "connecting the databases to the vector service; vector vector", False),
    (3, "/b/photo.png", "photo.png", "image/png", None, False),
    (4, "/b/old.txt", "old.txt", "text/plain", "a vector database that is gone", True),
    (5, "/b/notes qdrant.txt", "notes qdrant.txt", "text/plain", "notes about qdrant, not the other way round", False),
    (6, "/b/empty.txt", "empty.txt", "text/plain", "", None),
]
DOC_SCHEMA = "id bigint, path string, file_name string, mime_type string, extracted_text string, missing boolean"


@pytest.mark.parametrize("query", ["vector", "vector databases", "connected", "qdrant_notes", "notes", "the vector service", "nothing"])
def test_full_text_like_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path, file_name, mime_type, extracted_text, tokenize='porter')")
    db.executemany("INSERT INTO t(rowid, path, file_name, mime_type, extracted_text) VALUES (?,?,?,?,?)", [d[:5] for d in DOCS])
    missing = {d[0] for d in DOCS if d[5]}
    want = {i: r for i, r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,)) if i not in missing}
    got = {r["id"]: r["rank"] for r in fulltext.search(spark.createDataFrame(DOCS, DOC_SCHEMA), query, stemmed=True).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_index_search_agrees_with_the_scan(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).filter("NOT coalesce(missing, false)")
    many = fulltext.search_many(fulltext.postings(docs), spark.createDataFrame([(1, "vector databases"), (2, " "), (1, "vector databases")], "query_id int, query_text string"))
    assert {(r["id"], r["rank"]) for r in many.collect()} == {(r["id"], round(r["rank"], 6)) for r in fulltext.search(docs, "vector databases").collect()}
    assert fulltext.search(docs, " ?! ").count() == 0
    assert fulltext.search(docs.limit(0), "vector").count() == 0


def test_many_queries_find_what_brute_force_finds(spark, tmp_path, monkeypatch):
    import math
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(30)]
    texts = {i: [t for t in vocabulary if rng.random() < (0.5 if t[0] == "w" else 0.03)] * rng.choice([1, 1, 2]) for i in range(1, 301)}
    texts |= {i: ["w0", "w1", "w2"] for i in range(301, 331)}  # equal ranks
    docs = spark.createDataFrame([(i, "p", "f", "m", " ".join(t), i % 50 == 0) for i, t in texts.items()], DOC_SCHEMA)
    asked = [(i, " ".join(rng.sample(vocabulary, 1 + i % 4))) for i in range(60)] + [(60, "W0, w1 w2 w1"), (60, "W0, w1 w2 w1"), (61, None), (62, "w0 nowhere"), (63, ""), (64, "w0 w1"), (64, "w0 w2"), (64, "w3")]
    bags = {i: ["p", "f", "m", *t] for i, t in texts.items()}
    df = {t: sum(t in b for b in bags.values()) for t in vocabulary}
    avgdl = sum(map(len, bags.values())) / len(bags)
    sets: dict = {}
    for q, text in asked:
        words = {t.strip(",").lower() for t in (text or "").split()}
        sets.setdefault((q, len(words)), set()).update(words)
    by: dict = {}
    for (q, n), words in sets.items():
        for i, b in bags.items():
            have = [t for t in words if t in b]
            if words and len(have) == n:
                score = lambda t: max(math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / avgdl))  # noqa: B023, E731
                by.setdefault(q, []).append((round(-sum(map(score, have)), 6), i))
    want = sorted((q, i, r, n) for q, rows in by.items() for n, (r, i) in enumerate(sorted(rows)[:5], 1))
    monkeypatch.setattr(fulltext, "BLOCK_POSTINGS", 400)
    monkeypatch.setattr(fulltext, "BLOCK_QUERIES", 20)
    queries = spark.createDataFrame(asked, "query_id int, query_text string")
    for got in (TextIndex(spark, str(tmp_path / "index")).build(docs).search_many(queries, 5), fulltext.search_many(fulltext.postings(docs), queries, 5)):
        assert sorted(tuple(r) for r in got.collect()) == want
    empty = TextIndex(spark, str(tmp_path / "empty")).build(docs.limit(0))
    assert empty.search_many(queries).count() == 0 and fulltext.search_many(fulltext.postings(docs), queries.limit(0)).count() == 0


def test_many_queries_move_no_pairs(spark):
    docs = spark.createDataFrame([(i, "p", "f", "m", "one two three", False) for i in range(400)], DOC_SCHEMA)
    queries = spark.createDataFrame([(i, "three two one") for i in range(200)], "query_id int, query_text string")
    rows, moved = shuffled_rows(spark, fulltext.search_many(fulltext.postings(docs).localCheckpoint(), queries))
    assert len(rows) == 4_000 and moved < 20_000  # 80,000 pairs


def test_stored_index_finds_what_the_scan_finds(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    for stemmed in (False, True):
        index = TextIndex(spark, str(tmp_path / f"index{stemmed}"), stemmed)
        assert index.search("vector").count() == 0 and index.numbers()["n_docs"] == 0
        index.replace(docs)
        for query in ("vector databases", "vector", "vector_databases", "databases_vector", "nowhere", "", "text/plain pdf"):
            for mime in (None, "plain"):
                want = [(r["id"], round(r["rank"], 9)) for r in fulltext.search(docs, query, 20, mime, stemmed).collect()]
                assert [(r["id"], round(r["rank"], 9)) for r in index.search(query, 20, mime).collect()] == want
        numbers, told = index.numbers(), fulltext.corpus_numbers(docs, stemmed).first()
        assert numbers["n_tokens"] == told["n_tokens"] and abs(numbers["avgdl"] - told["avgdl"]) < 1e-9
    tokens = ["vector", "é", "x" * 70, "日本"]
    told = spark.createDataFrame([(t,) for t in tokens], "t string").select(F.pmod(F.xxhash64("t"), F.lit(13)).alias("b")).collect()
    assert [r["b"] for r in told] == [bucket_of(t, 13) for t in tokens]


def test_documents_are_replaced_in_the_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    index = TextIndex(spark, str(tmp_path / "index")).build(docs)
    first = docs.orderBy("id").limit(1).withColumn("extracted_text", F.lit("quite other words, vector"))
    last = docs.agg(F.max("id").alias("id"))
    now = docs.join(first.select("id"), "id", "left_anti").unionByName(first).join(last, "id", "left_anti")
    index.replace(first, last)
    same = lambda q: [(r["id"], round(r["rank"], 9)) for r in index.search(q).collect()] == [(r["id"], round(r["rank"], 9)) for r in fulltext.search(now, q).collect()]
    assert len(index.segments()) == 2 and all(same(q) for q in ("other words", "vector", "databases"))
    index._fold()
    assert len(index.segments()) == 1 and all(same(q) for q in ("other words", "vector", "databases"))
    assert index.docs().count() == now.count() == index.numbers()["n_docs"]


def test_stemmer_anchors():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "agreed", "é", "at")] == ["caress", "poni", "relat", "hop", "sky", "agre", "é", "at"]


def test_snippet_and_normalised_ranks(spark):
    df = spark.createDataFrame([("one two three four five six seven eight nine ten eleven calendar twelve",), (None,)], "t string")
    got = [r[0] for r in df.select(fulltext.snippet(F.col("t"), ["calendar"])).collect()]
    assert "[calendar]" in got[0] and got[0].startswith("...") and got[1] == ""
    ranks = spark.createDataFrame([(-10.5,), (-5.0,), (-1.0,)], "r double").select(fulltext.normalized(F.col("r")).alias("n"))
    assert [round(r["n"], 3) for r in ranks.orderBy(F.col("n").desc()).collect()] == [1.0, 0.421, 0.0]


def group(spark, events, **kw):
    return episodes.group(spark.createDataFrame(events, EVENT), **kw).orderBy("start_us").collect()


def ev(i, minutes, path=None, art=None, kind="FILE_MODIFIED", app=None, tags=None):
    return (i, T0 + round(minutes * 60 * S), kind, art, path, app, tags)


def test_episodes_anchors(spark):
    got = group(spark, [ev("a", 0, "/w/p/retrieval.py", 1), ev("b", 5, "/w/p/retrieval.py", 1)])
    assert len(got) == 1 and got[0]["title"] == "Activity involving retrieval.py"
    assert len(group(spark, [ev("a", 0, "/home/Downloads/a.pdf", 1), ev("b", 3, "/home/Downloads/b.png", 2, "SCREENSHOT_DISCOVERED")])) == 2
    assert len(group(spark, [ev("a", 0, "/w/proj/a.py", 1), ev("b", 3, "/w/proj/b.py", 2)])) == 1
    assert len(group(spark, [ev("a", 0, None, 1, app="x"), ev("b", 3, None, 2, app="x")])) == 2
    assert len(group(spark, [ev("a", 0, None, 1), ev("b", 2.5, None, 1)], rules=episodes.Rules(max_gap_s=60))) == 2
    assert len(group(spark, [ev("a", 0, "/x/n.txt", None, "FILE_OPENED"), ev("b", 5, "/y/n.txt", None, "APPLICATION_ACTIVE")])) == 1  # 0.45 + 0.30
    alone = group(spark, [ev("a", 0)])[0]
    assert alone["grouping_confidence"] == 0.5 and re.fullmatch(r"Activity — \d\d:\d\d–\d\d:\d\d", alone["title"])
    assert group(spark, []) == []


def test_episodes_do_not_depend_on_the_order_or_the_stretches(spark):
    events = [ev(f"e{n:03d}", n * 7, f"/w/proj{n // 9}/f{n % 3}.txt", n % 4) for n in range(60)]
    want = [r["id"] for r in group(spark, events)]
    assert [r["id"] for r in group(spark, events[::-1])] == want
    judged = episodes.judge(spark.createDataFrame(events, EVENT)).orderBy("us").collect()
    assert [r["prev"]["id"] if r["prev"] else None for r in judged] == [None] + [e[0] for e in events[:-1]]


def derive(spark, events, ids=None):
    eps = spark.createDataFrame([("ep", T0, T0 + 300 * S, ids or [e[0] for e in events], [1], 0.8)], "id string, start_us bigint, end_us bigint, event_ids array<string>, artifact_ids array<bigint>, grouping_confidence double")
    return memories.derive(eps, spark.createDataFrame(events, EVENT)).collect()


def test_memories_anchors(spark):
    assert derive(spark, [ev("a", 0, "/home/ann/Downloads/data.qdrant.md")])[0]["topics"] == ["qdrant", "data"]
    m = derive(spark, [ev("a", 0, "/tmp/qdrant_notes.txt"), ev("b", 1, "/tmp/qdrant_summary.txt")])[0]
    assert m["topics"] == ["qdrant", "notes", "summary"] and m["title"] == "Activity involving qdrant_notes.txt and qdrant_summary.txt"
    assert abs(m["confidence"] - 0.95) < 1e-9 and m["id"] == "memory_ep"
    plain = derive(spark, [ev("a", 0)])[0]
    assert plain["title_basis"] == "time_range" and plain["topics"] == []
    assert derive(spark, [ev("a", 0, tags=["Budget", "12", "pdf"])])[0]["topics"] == ["budget"]
    assert derive(spark, [ev("a", 0)], ["gone"]) == []


def test_filters(spark):
    rows = [(1, "application/pdf", "2024-03-10T00:00:00Z"), (2, "image/png", "2024-06-15T00:00:00+02:00"), (3, "text/plain", "2024-09-20"), (4, None, "not-a-date"), (5, " Image/PNG ", None)]
    df = spark.createDataFrame(rows, "id int, mime_type string, modified_at string")
    ids = lambda f: sorted(r["id"] for r in lookups.structured_filter(df, f).collect())
    assert ids(None) == ids({"mime_types": []}) == ids({"mime_types": "x"}) == ids({"unknown": 1, "date_from": True}) == [1, 2, 3, 4, 5]
    assert ids({"mime_types": ["image"]}) == [2, 5]
    assert ids({"mime_types": [" "]}) == []
    day = lambda *d: int(datetime(*d, tzinfo=UTC).timestamp() * 1000)
    assert ids({"date_from": day(2024, 6, 14, 22), "date_to": day(2024, 9, 20)}) == [2, 3]
    assert ids({"date_from": day(2024, 6, 14, 23)}) == [3]


def test_iso_times(spark):
    rows = [("2026-04-23T21:00:49Z",), ("2026-04-23T23:00:49.5+02:00",), ("2026-04-23 21:00",), ("2026/04/23",), ("2026-13-01",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(clock.epoch_ms(clock.parse_iso("t"))).collect()]
    assert got == [1776978049000, 1776978049500, 1776978000000, None, None, None, None]
    shown = spark.range(1).select(clock.iso_text(F.lit(1_500_000)).alias("a"), clock.iso_text(F.lit(2_000_000)).alias("b")).first()
    assert tuple(shown) == ("1970-01-01T00:00:01.500000+00:00", "1970-01-01T00:00:02+00:00")


def test_nearness_and_decay(spark):
    day = 86_400 * S
    got = spark.range(1).select(*[clock.nearness(F.lit(x), 100 * day, 130 * day).alias(f"n{i}") for i, x in enumerate((110 * day, 133 * day, 200 * day))], clock.decay(F.lit(0), 1).alias("z"), clock.decay(F.lit(1), 1 + 30 * 86_400_000).alias("h")).first()
    assert got["n0"] == 1.0 and got["n1"] == 0.5 and got["n2"] == 0.0 and got["z"] == 0.0 and abs(got["h"] - 0.5) < 1e-12


FEEDBACK = "id bigint, document_id string, query_text string, action string, ts_ms bigint"


def test_feedback(spark):
    now = 1_700_000_000_000
    results = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 2), (3, 0.5, 3)], "id bigint, score double, position int")

    def moved(*fb):
        b = feedback.boosts(spark.createDataFrame([(n, *f) for n, f in enumerate(fb)], FEEDBACK), "quantum notes", now)
        return {r["id"]: (round(r["score"], 6), r["position"]) for r in feedback.rerank(results, b).collect()}

    assert moved() == {1: (0.5, 1), 2: (0.5, 2), 3: (0.5, 3)}
    assert moved(*[("2", "quantum notes", "pin", now)] * 5)[2] == (0.55, 1)
    assert moved(("1", "quantum", "ignore", now))[1] == (0.475, 3)
    assert moved(("3", "cooking", "pin", now), (None, "quantum", "pin", now), ("3", "the", "pin", now))[3] == (0.5, 3)
    old, new = moved(("2", "quantum notes", " Pin ", now - 200 * 86_400_000))[2][0], moved(("2", "quantum notes", "pin", now - 86_400_000))[2][0]
    assert 0.5 < old < new < 0.55


def test_tables(spark):
    schema = "id bigint, path string, size bigint, missing boolean, last_opened_ms bigint"
    have = spark.createDataFrame([(1, "/f/a", 1, False, 9), (2, "/f/b", 2, True, None), (3, "/g/c", 3, None, None)], schema)
    new = spark.createDataFrame([("/f/b", 5), ("/f/z", 7), ("/f/d", None)], "path string, size bigint")
    got = {r["path"]: (r["id"], r["size"], r["missing"], r["last_opened_ms"]) for r in tables.upsert_artifacts(have, new).collect()}
    assert got == {"/f/a": (1, 1, False, 9), "/f/b": (2, 5, False, None), "/g/c": (3, 3, None, None), "/f/d": (4, None, False, None), "/f/z": (5, 7, False, None)}
    marked = {r["path"]: (r["missing"], r["newly_missing"]) for r in tables.mark_missing(have, new, "/f").collect()}
    assert marked == {"/f/a": (True, True), "/f/b": (False, False), "/g/c": (False, False)}
    eps = spark.createDataFrame([("x", [1, 9], 0, 5), ("y", [9], 6, 9), ("z", [], 0, 1), ("n", None, 0, 1)], "id string, artifact_ids array<bigint>, start_us bigint, end_us bigint")
    assert {r["id"] for r in tables.prune_episodes(eps, have.filter("id = 1")).collect()} == {"x"}
    mem = spark.createDataFrame([("m1", [9], ["x"]), ("m2", [9], ["y"])], "id string, artifact_ids array<bigint>, episode_ids array<string>")
    assert {r["id"] for r in tables.prune_memories(mem, have.filter("id = 1"), eps.filter("id = 'x'")).collect()} == {"m1"}
    put = tables.replace_range(eps, eps.filter("id = 'y'"), 0, 3)
    assert sorted(r["id"] for r in put.collect()) == ["y"]
    log = spark.createDataFrame([("a", 1)], "id string, us bigint")
    more = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], "id string, us bigint")
    assert [tuple(r) for r in tables.append_new(log, more).collect()] == [("b", 2)]
    with pytest.raises(ValueError):
        tables.append_new(log, more, strict=True)


def test_chunks():
    text_ = ("Sentence number one is here. " * 40).strip()
    spans = vectors.chunk_spans(text_)
    assert spans[0][:2] == (0, 492) and all(b - a <= 500 for a, b, _ in spans) and spans[-1][1] == len(text_)
    assert all(n[0] == max(p[1] - 100, p[0] + 1) for p, n in zip(spans, spans[1:], strict=False))
    assert vectors.chunk_spans("short") == [] and vectors.chunk_spans("") == []
    assert len(vectors.chunk_spans("x" * 1200)) == 3
    assert vectors.chunk_spans("a" * 30 + "\n" + "b" * 300, 100, 95, 10)[-1][1] == 331  # boundaries within the overlap still advance


def test_vector_search_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1234)
    x = rng.standard_normal((600, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i), "m", 384, v.tolist()) for i, v in enumerate(x)], "chunk_id string, model_id string, dimension int, embedding array<float>")
    q = df.limit(50).withColumnRenamed("chunk_id", "query_id")
    found = vectors.bucketed_topk(df, q, 5, tables=16, bits=2).select("query_id", F.col("chunk_id").alias("id"))
    truth = [(r["query_id"], str(j)) for r in q.collect() for j in np.argsort(-(x @ np.array(r["embedding"], np.float32)))[:5]]
    assert one(metrics.recall_at_k(found, spark.createDataFrame(truth, "query_id string, id string")), "recall") >= 0.95


def shuffled_rows(spark, df):
    """The rows that df writes to shuffles, all stages together."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Double.TYPE, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows = df.collect()
    return rows, total() - before


def _neighbours(vectors_, queries, k, buckets=None):
    """What nearest finds, by comparing all: (query_id, chunk_id, similarity) of rows (id, model, vector)."""
    import numpy as np

    out = []
    for qid, qm, qv in queries:
        best = {}
        for cid, m, v in vectors_:
            if m != qm or len(v) != len(qv) or not np.isfinite(v).all() or not np.any(v):
                continue
            if buckets and not {*vectors.buckets_of(np.float32(qv), *buckets)} & {*vectors.buckets_of(np.float32(v), *buckets)}:
                continue
            a, b = np.float64(np.float32(qv)), np.float64(np.float32(v))
            best[cid] = max(best.get(cid, -2), float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(a * a)[-1]) * np.sqrt(np.cumsum(b * b)[-1]))))
        out += [(qid, c, s) for c, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("buckets", [None, (16, 4, 0), (3, 6, 1)])
def test_neighbours_are_those_of_brute_force(spark, monkeypatch, buckets):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"c{i}", "m" if i % 3 else "n", rng.standard_normal(24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(f"same{i:02}", "m", rows[1][2]) for i in range(30)]  # equal cosines
    rows += [("c1", "m", rows[2][2]), ("c2", "m", rows[2][2]), ("zero", "m", [0.0] * 24), ("nan", "m", [float("nan")] * 24), ("short", "m", [1.0] * 23), ("long", "m", [1e30] * 24), ("tiny", "n", [1e-6] + [0.0] * 23)]
    rows += [("few", "o", [1.0] * 24), ("none", None, [1.0] * 24)]
    df = spark.createDataFrame([(c, m, 24, v) for c, m, v in rows], "chunk_id string, model_id string, dimension int, embedding array<float>").repartition(3)
    asked = [*rows[1:400:10], *[r for r in rows if r[0] in ("same01", "few", "nan", "tiny", "none")]]
    q = spark.createDataFrame([(f"q{i}", m, 24, v) for i, (_, m, v) in enumerate(asked)], "query_id string, model_id string, dimension int, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vectors, "TILE", 32)
    got = sorted((r["query_id"], r["chunk_id"], r["similarity"]) for r in vectors.nearest(df, q, 5, buckets).collect())
    want = _neighbours([(c, m or "?", v) for c, m, v in rows], [(f"q{i}", m or "!", v) for i, (_, m, v) in enumerate(asked) if np.isfinite(v).all()], 5, buckets)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=0, atol=1e-12)


def test_bucketed_search_moves_no_pairs(spark):
    import numpy as np

    x = np.random.default_rng(6).standard_normal((1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"c{i}", "m", 8, v.tolist()) for i, v in enumerate(x)], "chunk_id string, model_id string, dimension int, embedding array<float>")
    rows, moved = shuffled_rows(spark, vectors.bucketed_topk(df, df.limit(300).withColumnRenamed("chunk_id", "query_id"), tables=16, bits=4))
    assert len(rows) == 1500 and moved < 20_000  # 450,000 pairs


def test_recall_moves_no_pairs(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(7).standard_normal((1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"c{i}", 100 if i < 300 else i, "m", 8, v.tolist()) for i, v in enumerate(x)], "chunk_id string, artifact_id bigint, model_id string, dimension int, embedding array<float>")
    df.filter("artifact_id <> 200").write.parquet(str(tmp_path / "vector_chunks.parquet"))
    rows, moved = shuffled_rows(spark, metrics.lsh_recall_at_5(spark, str(tmp_path)))
    assert rows[0]["n_queries"] >= 300 and rows[0]["recall"] > 0.9 and moved < 40_000


def test_exact_vector_search(spark):
    rows = [("a", 1, "m", 3, [1.0, 0.0, 0.0]), ("b", 2, "m", 3, [0.0, 1.0, 0.0]), ("c", 3, "m", 3, [0.0, 0.0, 0.0]), ("d", 4, "m", 3, None), ("e", 5, "m", 3, [1.0, float("nan"), 0.0]), ("f", 6, "o", 3, [1.0, 0.0, 0.0]), ("g", 7, "m", 3, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, artifact_id int, model_id string, dimension int, embedding array<float>")
    got = vectors.exact_topk(df, [0.9, 0.1, 0.0], "m", 5, 0.5).collect()
    assert [r["chunk_id"] for r in got] == ["a"] and got[0]["similarity"] > 0.8
    assert vectors.exact_topk(df, [0.0, 0.0, 0.0], "m").count() == 0


def test_evidence_and_scores(spark):
    cand = spark.createDataFrame([(1, "/p/a.txt", "a.txt", "text/plain", 5, T0, None, (2, 1), True, -2.0, "some text", None), (2, "/p/b.txt", "b.txt", "text/plain", 5, T0, None, (2, 2), True, -1.0, "", None)],
        "id bigint, path string, file_name string, mime_type string, size bigint, modified_us bigint, last_opened_ms bigint, found struct<path_no int, path_at int>, fts_matched boolean, rank double, snippet string, semantic double")
    events = spark.createDataFrame([("e1", T0, "FILE_OPENED", 1, None, None, None)], EVENT).withColumns({"source": F.lit("s"), "source_kind": F.lit("filesystem"), "event_confidence": F.lit(1.0)})
    ep = "id string, start_us bigint, end_us bigint, event_ids array<string>, artifact_ids array<bigint>, grouping_confidence double, title string"
    eps = spark.createDataFrame([("p1", T0, T0, ["e1"], [1], 0.7, "one"), ("p2", T0 + 1, T0 + 1, ["nope"], [1], 0.6, "two")], ep)
    mem = spark.createDataFrame([("m1", ["p1"], ["e1"], [1], T0, T0, "memo", 0.9)], "id string, episode_ids array<string>, event_ids array<string>, artifact_ids array<bigint>, start_us bigint, end_us bigint, title string, confidence double")
    got = {r["id"]: r for r in fusion.rank(fusion.enrich(cand, events, eps, mem), understand("a.txt text"), None, 10).collect()}
    assert [(e["type"], e["id"], e["confidence_type"]) for e in got[1]["evidence"]] == [("event", "e1", "FACT"), ("episode", "p2", "GUESS"), ("episode", "p1", "INFERENCE"), ("memory", "m1", "INFERENCE")]
    assert abs(got[1]["score"] - (0.35 + 0.15 + 0.08 + 0.05)) < 1e-9 and got[1]["position"] == 1
    assert got[1]["why"].startswith("Matched 'a.txt' in filename.") and "Topic matches associated memory 'memo'." in got[1]["why"]
    assert 2 not in got or got[2]["score"] > 0  # the worst full-text hit has no score of its own


def test_expressions(spark):
    row = spark.createDataFrame([("/a/b/c.TXT", "/a/b/d.txt", '{"path": "/x", "tags": ["t"]}', '{"path": "/x')], "p string, q string, j string, cut string").select(
        text.basename("p").alias("base"), text.extension("p").alias("ext"), text.shared_depth(text.segments("p"), text.segments("q")).alias("depth"), text.json_text("j", "path").alias("path"), text.json_text("cut", "path").alias("none"),
        text.meaning_tokens(F.lit("What did I find in the Qdrant notes, qdrant?")).alias("words"), text.glob_matches(F.col("p"), "*b*.txt").alias("glob"), text.file_slug(F.lit("a/b c")).alias("slug"), text.query_text(F.lit("é: a_b?")).alias("query"),
    ).first()
    assert tuple(row)[:5] == ("c.TXT", ".txt", 2, "/x", None)
    assert row["words"] == ["qdrant", "notes"] and row["glob"] and row["slug"] == "a_b_c" and row["query"] == "é  a_b"


def test_document_stats_with_and_without_fan_out(spark):
    arts, chunks = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1,), (1,)], "artifact_id bigint")
    acc = spark.createDataFrame([(1, 5), (1, 7), (1, 6)], "id bigint, ts_ms bigint")
    plain = {r["id"]: (r["chunk_count"], r["last_access_ms"]) for r in summaries.document_stats(arts, chunks, acc).collect()}
    assert plain == {1: (2, 7), 2: (0, None)}
    assert {r["id"]: r["chunk_count"] for r in summaries.document_stats(arts, chunks, acc, fan_out=True).collect()} == {1: 6, 2: 0}


def test_hit_rate(spark):
    res = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "case_id string, id int, position int")
    rel = spark.createDataFrame([("a", 2), ("b", 9), ("c", 1)], "case_id string, id int")
    assert tuple(metrics.hit_rate_and_mrr(res, rel).first()) == (3, pytest.approx(1 / 3), pytest.approx(0.5 / 3))


def test_events_of_json_and_small_lookups(spark, tmp_path):
    rows = [('{"id": "a", "type": "FILE_OPENED", "timestamp": "2026-08-12T10:00:00Z", "artifact_id": 3, "payload": {"path": "/x", "application": "y"}}',), ('{"type": "X"}',), ('{"type": ',), ('{"event_confidence": 2}',), ('{"timestamp": "later"}',), (None,)]
    got = {r["event_type"]: r for r in lookups.events_from_json(spark.createDataFrame(rows, "j string"), "j", 5).collect()}
    assert set(got) == {"FILE_OPENED", "X"} and got["FILE_OPENED"]["app"] == "y" and got["X"]["us"] == 5 and len(got["X"]["id"]) == 32
    df = spark.createDataFrame([("a", 1, "m", 2, [1.0, 0.0]), ("b", 1, "m", 2, [0.6, 0.8])], "chunk_id string, artifact_id int, model_id string, dimension int, embedding array<float>")
    assert [r["chunk_id"] for r in vectors.similar(df, [1.0, 0.0], "m", least=0.9, mode="buckets").collect()] == ["a"]
    assert lookups.chunks_of(df, chunk_ids=["b"]).count() == 1 and lookups.chunks_of(df, model_id="o").count() == 0
    assert vectors.model_status(str(tmp_path))["missing"] == ["model.onnx", "tokenizer.json"]
    metrics.write_report(df.select("chunk_id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
