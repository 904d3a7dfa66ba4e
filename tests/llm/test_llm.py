"""The llm operators against brute force, exact round trips and held-out accuracy, and the cases their docstrings define."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidepool.llm")

from tidepool.llm import encode, mix, neighbours, rank, scans, spans, split  # noqa: E402

VOCABULARY = encode.default_vocabulary()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
WORDS = "the calendar of our warehouse was moved before early spring because nobody could open its archive again".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Splitting ----------------------------------------------------------------------------------------------------------

TEXTS = [
    "One sentence. " * 90, "a" * 1700, "para one " * 30 + "\n\n" + "para two " * 90 + "\n\n\n" + "last " * 20, "資料は確認され、会議が終わった。" * 60,
    "word " * 20 + "x" * 900 + " tail " * 30, "line one\r\nline two\r\n" * 60, " " * 1300, "ab\f" * 400, "é" * 499 + " " + "ü" * 40, "early end " + "y" * 900,
]


@pytest.mark.parametrize("t", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(500, 100), (50, 0), (7, 6)])
def test_pieces_cover_the_text_within_the_limit(t, limit, overlap):
    got = split.split_text(t, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    assert all(0 < b - a <= limit for a, b in got)
    assert all(n[0] == p[1] - overlap and n[1] > p[1] for p, n in zip(got, got[1:], strict=False))
    for a, b in got[:-1]:
        if split.inside_word(t[b - 1], t[b]):
            assert not split.SEPARATORS[split.WORD][1].search(t, max(a + overlap + 1, 0), b) or a == 0


def test_pieces_prefer_paragraphs():
    t = "first paragraph here\n\n" + "second one. " * 3
    assert split.split_text(t, 40, 0)[0] == (0, 22)
    assert split.split_text("", 10, 2) == [] and split.split_text("short") == [(0, 5)]


def test_own_pieces_pass_the_audit_and_faulty_ones_do_not(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(90, None, ""), (91, "", "")] + [(0, TEXTS[0], "clash")], "id bigint, text string, size string")
    made = split.split_documents(docs.distinct()).withColumn("chunk_id", F.concat_ws("_", "artifact_id", "chunk_index"))
    assert split.audit_pieces(made, docs).count() == 0
    t = TEXTS[0]
    rows = [("a", 0, 0, 0, 510, t[:510]), ("b", 0, 1, 400, 505, t[400:505]), ("c", 0, 3, 410, len(t) - 1, "other"), ("c", 0, 3, 410, len(t) - 1, "other"), ("d", 90, 0, 0, 5, "x"), ("e", 77, 0, 0, 5, "x"), ("f", 8, 0, 3, 10, None), ("g", None, 0, 0, 1, "x")]
    pieces = spark.createDataFrame(rows, "chunk_id string, artifact_id bigint, chunk_index int, start_char int, end_char int, text string")
    got = {tuple(r) for r in split.audit_pieces(pieces, docs).collect()}
    faults = {(0, 0): "oversize broken_word", (0, 1): "overlap broken_word", (0, 3): "oversize overlap text tail", (8, 0): "overlap text tail"}
    assert got == {(*k, d) for k, ds in faults.items() for d in ds.split()}
    assert split.audit_pieces(pieces.limit(0), docs).count() == 0 and split.audit_pieces(pieces, docs.limit(0)).count() == 0


def test_audit_of_long_texts_across_blocks(spark):
    t = text(random.Random(5), 9000)
    docs = spark.createDataFrame([(1, t)], "id bigint, text string")
    made = split.split_documents(docs).withColumn("chunk_id", F.col("chunk_index").cast("string"))
    assert made.count() > 100 and split.audit_pieces(made, docs).count() == 0
    long = spark.createDataFrame([("x", 1, 0, 0, len(t), t)], "chunk_id string, artifact_id bigint, chunk_index int, start_char int, end_char int, text string")
    assert {r["defect"] for r in split.audit_pieces(long, docs).collect()} == {"oversize"}
    whole = spark.createDataFrame([(2, "ab " * 10_923 )], "id bigint, text string").withColumn("text", F.substring("text", 1, 2 * split.BLOCK))
    beyond = spark.createDataFrame([("y", 2, 0, 2 * split.BLOCK, 2 * split.BLOCK + 9, "x"), ("z", 2, 1, split.BLOCK - 3, split.BLOCK + 5_000, "x")], "chunk_id string, artifact_id bigint, chunk_index int, start_char int, end_char int, text string")
    got = {(r["chunk_index"], r["defect"]) for r in split.audit_pieces(beyond, whole).collect()}
    assert {(0, "overlap"), (0, "text"), (1, "oversize"), (1, "overlap"), (1, "text"), (1, "tail")} <= got


# Ranking ------------------------------------------------------------------------------------------------------------


def test_ranking_is_not_ruled_by_range_or_extremes(spark):
    rng = random.Random(2)
    rows, good = [], set()
    for q in range(12):
        for i in range(60):
            relevant = i < 4
            u = [rng.uniform(0.9, 1.0) if relevant else rng.uniform(0, 0.8) for _ in range(3)]
            s = [-(10 ** (q % 4)) * u[0], 0.5 + 0.01 * u[1], u[2] ** 2]
            if not relevant and i % 20 == 10:
                s[i % 3] = [-1e7, 0.99, 50.0][i % 3]
            if rng.random() < 0.15:
                s[rng.randrange(2)] = rng.choice([None, float("nan")])
            rows.append((q, i, *s, "extra"))
            if relevant:
                good.add((q, i))
    df = spark.createDataFrame(rows + rows[:50], "query_id bigint, artifact_id bigint, a double, b double, c double, g string")
    scores = [rank.Score("a", False), rank.Score("b"), rank.Score("c")]
    ranked = rank.rank_by_closeness(df, "query_id", "artifact_id", scores)
    wanted = spark.createDataFrame([(q, 4) for q in range(12)] + [(99, 3), (None, 1)], "query_id bigint, n int")
    got = {(r[0], r[1]) for r in rank.first_of_each(ranked, wanted, "query_id", "artifact_id", "n").collect()}
    assert len(got) == 48 and len(got & good) / 48 >= 0.95
    assert got == {(r[0], r[1]) for r in rank.first_of_each(ranked, wanted, "query_id", "artifact_id", "n", hot_rows=10).collect()}
    hot = rank.rank_by_closeness(df, "query_id", "artifact_id", scores, hot_rows=10)  # every group treated as a large one
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, ranked.collect()))


def test_ranking_keeps_the_order_of_all_values(spark):
    values = [float(v) for v in range(40)] + [1e6, 2e6, float("inf"), -1e6]
    df = spark.createDataFrame([(1, -i, v) for i, v in enumerate(values)], "q bigint, i bigint, a double")  # ids run against the values
    got = {r["i"]: r["closeness"] for r in rank.rank_by_closeness(df, "q", "i", [rank.Score("a")]).collect()}
    close = [got[-i] for i in sorted(range(len(values)), key=lambda i: values[i])]
    assert all(a < b for a, b in zip(close, close[1:], strict=False))
    assert 0.4 < got[-20] < 0.6 and got[-39] > 0.97  # the extreme values don't stretch the scale
    # a rare score that most items lack: most values are equal
    rare = spark.createDataFrame([(1, i, 0.0 if i < 30 else float(i)) for i in range(40)] + [(2, 1, 3.0), (2, 2, 3.0)], "q bigint, i bigint, a double")
    got = {(r["q"], r["i"]): r["closeness"] for r in rank.rank_by_closeness(rare, "q", "i", [rank.Score("a")]).collect()}
    assert got[1, 0] == 0 < got[1, 30] < got[1, 39] == 1 and got[2, 1] == got[2, 2] == 0.5


def test_ranking_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, None, 1.0), (2, 1, None, None), (None, 1, 1.0, 1.0), (3, 1, float("inf"), 1.0), (3, 2, 0.0, 0.0), (3, 3, 5.0, 0.5)], "q bigint, i bigint, a double, b double")
    got = {(r["q"], r["i"]): r["closeness"] for r in rank.rank_by_closeness(df, "q", "i", [rank.Score("a"), rank.Score("b")]).collect()}
    assert got[1, 1] == got[1, 2] == got[2, 1] == 0.5 and len(got) == 6 and 0 <= got[3, 2] <= 1
    assert rank.rank_by_closeness(df.limit(0), "q", "i", [rank.Score("a")]).count() == 0


# Neighbours ---------------------------------------------------------------------------------------------------------

VEC = "chunk_id string, model_id string, dimension int, embedding array<float>, pivot string"


def test_neighbours_against_brute_force_with_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 32))
    for i in range(0, 600, 3):
        x[i + 1] = x[i] + 0.25 * rng.standard_normal(32)
    x[1400:] = x[3]  # a hundred copies
    rows = [(f"c{i:04d}", "m" if i % 5 else "n", 32, v.astype(float).tolist(), "x") for i, v in enumerate(x)]
    rows[1400:] = [(r[0], "m", *r[2:]) for r in rows[1400:]]
    bad = [("n1", "m", 32, None, ""), ("n2", "m", 32, [0.0] * 32, ""), ("n3", "m", 32, [1.0] * 31, ""), ("n4", "m", 32, [float("nan")] * 32, ""), ("n5", None, 32, [1.0] * 32, "")]
    df = spark.createDataFrame(rows + bad + rows[:40], VEC)
    got = neighbours.nearest(df, 5, least=0.85).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = hit = 0
    for i in range(1400):
        if rows[i][1] == "n" or i == 3:
            continue
        same = [j for j in range(1500) if j != i and rows[j][1] == "m"]
        cos = unit[same] @ unit[i]
        near = [f"c{same[j]:04d}" for j in np.argsort(-cos, kind="stable")[:5] if cos[j] >= 0.85]
        want += len(near)
        hit += len(set(near) & set(by.get(rows[i][0], [])))
    assert hit / want >= 0.9
    assert all(len(by[f"c{i:04d}"]) == 5 and set(by[f"c{i:04d}"]) <= {"c0003"} | {f"c{j:04d}" for j in range(1400, 1410)} for i in range(1400, 1500))
    assert not {r["chunk_id"] for r in got} & {b[0] for b in bad}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_near_copies_are_a_third_of_all_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x[:1000] = rng.standard_normal(64) + 0.3 * rng.standard_normal((1000, 64))  # cosine about 0.92 to each other
    df = spark.createDataFrame([(f"c{i:04d}", "m", 64, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T - 3 * np.eye(3000)
    want = {(f"c{i:04d}", f"c{j:04d}") for i in range(1000) for j in np.argsort(-cos[i])[:5] if cos[i, j] >= 0.85}
    pairs = lambda df: {(r["chunk_id"], r["neighbour_id"]) for r in df.collect()}
    assert len(want) > 4900
    assert len(want & pairs(neighbours.nearest(df, 5, least=0.85))) / len(want) >= 0.99
    assert len(want & pairs(neighbours.nearest(df, 5, least=0.85, file_rows=1000))) / len(want) >= 0.9  # in several files
    assert len(want & pairs(neighbours.nearest(df, 5, least=0.85, file_rows=150))) / len(want) >= 0.6  # files are split again


def test_all_members_of_a_file_are_compared(monkeypatch):
    x = np.random.default_rng(2).standard_normal((1337, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = x @ x.T - 3 * np.eye(1337)
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 200_000)
    i, j, _ = neighbours.best_of_file(x, None, 5, None, -1)
    assert set(zip(i, j, strict=True)) == {(i, j) for i in range(1337) for j in np.argsort(-exact[i])[:5]}


def test_every_vector_gets_its_five_neighbours(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 64))  # no two of them near
    spark.createDataFrame([(f"c{i:03d}", "m", 64, v.tolist(), "x") for i, v in enumerate(x)], VEC).write.parquet(str(tmp_path / "vector_chunks.parquet"))
    got = {(r["chunk_id"], r["neighbour_id"]) for r in neighbours.p5_neighbours(spark, str(tmp_path)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T - 3 * np.eye(400)
    want = {(f"c{i:03d}", f"c{j:03d}") for i in range(400) for j in np.argsort(-cos[i])[:5]}
    assert len(got) == 2000 and len(got & want) / 2000 >= 0.99


def test_posting_goes_as_deep_as_the_recall_wants(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(f"c{i:04d}", "m", 16, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T - 3 * np.eye(1500)
    want = {(f"c{i:04d}", f"c{j:04d}") for i in range(1500) for j in np.argsort(-cos[i])[:5]}
    got = {(r["chunk_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5, file_rows=400, posted=1).collect()}
    assert len(got & want) / len(want) >= 0.95


def test_a_file_larger_than_a_block(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    prefix = np.argsort(-(x @ x[:10].T), axis=1)[:, :6].astype(np.int16)
    whole = neighbours.best_of_file(x, prefix, 3, 60, -1)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    parts = neighbours.best_of_file(x, prefix, 3, 60, -1)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:2], parts[:2], strict=True))
    exact = x @ x.T - 3 * np.eye(50)
    assert {(i, j) for i, j in zip(*whole[:2], strict=True)} == {(i, j) for i in range(50) for j in np.argsort(-exact[i])[:3]}


# Encoding -----------------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "hello world", "<|endoftext|> and more", "naïve café 😅 é́", "tabs\tand\r\n\r\n  spaces   ", "x" * 3000, "it's we'll they've 123 4567", "   \n" * 500, "日本語のテキスト。" * 200, "a b c d\x1ce"]


@needs_vocabulary
@pytest.mark.parametrize(("chunk", "overlap", "spread"), [(4_096, 256, 1 << 22), (120, 20, 1 << 22), (120, 20, 200), (64, 32, 0)])
def test_chunked_encoding_is_that_of_the_whole_text(spark, chunk, overlap, spread):
    rng = random.Random(4)
    texts = ODD + [text(rng, 700), "".join(rng.choice("ab 1.,'\n\té😅") for _ in range(2500))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_documents(df, chunk_chars=chunk, overlap=overlap, spread_chars=spread).collect()}
    whole = encode.encoding(VOCABULARY).encode_ordinary
    assert got == {i: list(whole(t)) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in encode.decode_documents(encode.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@needs_vocabulary
def test_chunks_are_stitched():
    t = text(random.Random(1), 2000)
    whole = encode.encoding(VOCABULARY).encode_ordinary
    stitched = encode.encode_chunked(t, VOCABULARY, 4_096, 256)
    assert stitched == whole(t) and len(encode.chunks_of(t, 4_096, 256)) > 2
    ends = [encode.meeting_ends(b, c, 256) for b, c in encode.chunks_of(t, 4_096, 256)]
    assert all(set(r) & set(left) for (_, r), (left, _) in zip(ends, ends[1:], strict=False))


@needs_vocabulary
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}
    assert encode.encode_documents(df.limit(0)).count() == 0


# Mixing -------------------------------------------------------------------------------------------------------------


def test_counts_fit_the_budget():
    rng = random.Random(6)
    for _ in range(30):
        lengths = rng.sample(range(0, 60), 12)
        counts = [rng.randrange(1, 9) for _ in lengths]
        budget = rng.randrange(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 20)
        take = mix.fit_counts(lengths, counts, budget, seed=1)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = sum(a * b for a, b in zip(lengths, take, strict=True))
        assert got <= budget and budget - got <= max(lengths)
    assert mix.fit_counts([7, 11], [3, 2], 29) == [1, 2]
    lengths = list(range(100, 900))
    take = mix.fit_counts(lengths, [50] * 800, 7_654_321, dp_tokens=5000)
    assert sum(a * b for a, b in zip(lengths, take, strict=True)) == 7_654_321


def test_mix_reaches_the_shares(spark):
    rng = random.Random(8)
    rows = [(i, "big", 40, None) for i in range(3000)]  # one length holds most rows
    rows += [(5000 + i, "small", rng.randrange(1, 90), None) for i in range(200)] + [(7000 + i, "none", 5, None) for i in range(50)] + [(8000 + i, None, 5, None) for i in range(5)] + [(9000, "big", None, None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int, copies string")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("absent", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix.mix_sources(sizes, targets)
    again = mix.mix_sources(sizes.repartition(7), targets)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    spread = mix.mix_sources(sizes, targets, range_rows=100)  # the length that holds most is cut into ranges, and hot
    total = lambda df: sorted(map(tuple, df.groupBy("source", "n_tokens", "copies").count().collect()))
    assert total(spread) == total(got)
    assert got.groupBy("doc_id").count().filter("count > 1").count() == 0
    report = {r["source"]: r for r in mix.mix_report(got, targets).collect()}
    assert abs(report["big"]["actual_share"] - 0.6) < 2e-3 and abs(report["small"]["actual_share"] - 0.4) < 2e-3
    assert report["small"]["most_copies"] <= 3 and report["big"]["most_copies"] <= 2 and report["absent"]["n_docs"] == 0
    short = {r["source"]: r for r in mix.mix_report(mix.mix_sources(sizes, targets, total=10**6), targets).collect()}
    assert short["small"]["actual_tokens"] == 3 * sum(r[2] for r in rows if r[1] == "small") and short["big"]["actual_tokens"] == 2 * 120_000
    assert mix.mix_sources(sizes.limit(0), targets).count() == 0 and mix.mix_sources(sizes, targets.limit(0)).count() == 0


# Shared spans -------------------------------------------------------------------------------------------------------


def brute_spans(docs, length):
    where = {}
    for i, t in docs.items():
        for k in range(len(t) - length + 1):
            where.setdefault(t[k : k + length], {}).setdefault(i, set()).add(k)
    pairs, covered = set(), {}
    for at in where.values():
        ids = sorted(at)
        pairs |= {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}
        if len(ids) > 1:
            for i, ks in at.items():
                covered.setdefault(i, set()).update(p for k in ks for p in range(k, k + length))
    return pairs, {i: len(c) for i, c in covered.items()}


@pytest.mark.parametrize("bucket", [400_000, 30])
def test_shared_spans_like_brute_force(spark, monkeypatch, bucket):
    split = spans.shared_windows
    monkeypatch.setattr(spans, "shared_windows", lambda docs, length, m: split(docs, length, m, bucket))
    rng = random.Random(9)
    common = [text(rng, 12) for _ in range(6)] + ["=" * 90, "ab" * 45]
    docs = {}
    for i in range(60):
        parts = [text(rng, rng.randrange(1, 15)) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(common))
        docs[i] = " ".join(parts)
    docs |= {70: docs[1], 71: docs[1], 72: "é😅" * 60, 73: "x" + "é😅" * 60, 74: "short", 75: "-" * 300, 76: "-" * 200 + text(rng, 3)}
    df = spark.createDataFrame([(i, t, "c") for i, t in docs.items()] + [(90, None, "c"), (91, "", "c"), (1, docs[1], "c")], "id bigint, text string, class string")
    pairs, covered = brute_spans(docs, 40)
    assert {tuple(r) for r in spans.shared_pairs(df, 40, 16).collect()} == pairs
    report = {r["doc_id"]: r for r in spans.shared_report(df, 40, 16).collect()}
    assert {i: r["shared_chars"] for i, r in report.items() if r["shared_chars"]} == covered
    assert report[90]["share"] == 0.0 and report[70]["share"] == 1.0 and report[71]["class_id"] == 1
    assert spans.shared_pairs(df.limit(0), 40, 16).count() == 0
    groups, links = spans.shared_groups(df, 40, 16).collect(), {}
    for r in groups:
        for key in (("class", r["class_id"]), ("group", r["group_id"])):
            if key[1] is not None:
                links.setdefault(key, set()).add(r["doc_id"])
    assert {(a, b) for ids in links.values() for a in ids for b in ids if a < b} == pairs


# Scanned pages ------------------------------------------------------------------------------------------------------


def test_page_numbers():
    for line in ("p. 3", "Page 3 of 9", "Seite 12", "— 4 —", "[7]", "- 5 -", "3 / 9", "iv", "Page ll of l9", "   ii"):
        assert scans.page_number(line) and scans.page_number(line)[1], line
    assert scans.page_number("7") == (7, False)
    for line in ("", "mix", "355.15", "v2 of it", "3 apples", "Seite an Seite"):
        assert not scans.page_number(line), line


def test_furniture():
    body = [f"The {a} of the house was {b} and" for a, b in zip(["roof", "door", "wall", "sill"], ["old", "new", "red", "low"], strict=True)]
    lines = ["KABRTAV TICKET", *body[:2], "8567", "     1", "\fKABRTAV TlCKET", *body[2:], "", "     2"]
    assert scans.furniture(lines) == {0: "header", 4: "page_number", 5: "header", 9: "page_number"}
    assert scans.furniture([]) == {} and scans.furniture(["", " "]) == {}


CORRECTOR = {w: 50 for w in ["replaced", "final", "compressed", "temporary", "configuration", "well-known", "inspected", "match", "march", "works", "workshop", "the", "and", "modern", "annual", "was", "indexed", "library"]}


def test_words_are_joined_and_corrected():
    c = scans.Corrector(CORRECTOR)
    got = {w: c.correct(w) for w in ("replacecl", "fin@l", "cornpressed", "tempor@ry", "corifiguration", "armual", "xyzzy", "v2", "!nspected")}
    assert got == {"replacecl": "replaced", "fin@l": "final", "cornpressed": "compressed", "tempor@ry": "temporary", "corifiguration": "configuration", "armual": "annual", "xyzzy": None, "v2": None, "!nspected": "inspected"}
    found, _ = scans.inspect("The works-\nhop was well-\nknown and pre-\nor inde\xad\nxed final.", c)
    assert set(found) == {(0, "hyphen_break", "workshop"), (1, "hyphen_break", "well-known"), (3, "hyphen_break", "indexed")}
    assert scans.repair("The works-\nhop was\nfin@l.\n\nThe library.", c) == "The workshop was final.\n\nThe library."
    assert scans.repair("", c) == "" and scans.inspect("", c)[0] == []


def test_context_decides_between_words():
    vectors = {"match": np.array([1.0, 0]), "march": np.array([0, 1.0]), "final": np.array([0.1, 1.0]), "library": np.array([1.0, 0.1])}
    c = scans.Corrector(CORRECTOR, vectors)
    c.links = {"ma+ch": [(1.0, "match"), (1.0, "march")]}
    assert c.correct("ma+ch", ["final"]) == "march" and c.correct("ma+ch", ["library"]) == "match"


def test_right_words_stay(spark):
    frequent = {w: 50 for w in ("house", "mouse", "the", "roof", "door", "eat", "bread")}
    c = scans.Corrector(frequent)
    assert c.correct("hause") is None and c.correct("louse") is None and c.correct("horse") is None  # no known confusion
    assert c.correct("hou5e") == "house" and c.correct("mousc") == "mouse"
    vectors = {"house": np.array([1.0, 0] + [0] * 22), "roof": np.array([1.0, 0.2] + [0] * 22), "bread": np.array([-1.0, 0.1] + [0] * 22), "eat": np.array([-1.0, 0] + [0] * 22)}
    c = scans.Corrector(frequent, vectors)
    assert [w for _, w in c.neighbours("hause", vectors["roof"])] == ["house"] and c.neighbours("hause", vectors["bread"]) == []
    assert c.neighbours("cat", vectors["roof"]) == [] and [w for _, w in c.neighbours("cat", vectors["bread"])] == ["eat"]
    texts = spark.createDataFrame([(1, "the roof hause the roof housc"), (2, "bread hause, mousc"), (3, None), (4, "")], "id bigint, text string").filter("text IS NOT NULL")
    parts = spark.sparkContext.broadcast((frequent, vectors))
    support = spark.createDataFrame([("mousc", True), ("housc", None)], "word string, right boolean")
    got = {r["id"]: {x["word"]: [y["word"] for y in x["links"]] for x in r["links"] or []} for r in scans.link_words(texts, parts, support).collect()}
    assert got == {1: {"hause": ["house"], "housc": ["house"]}, 2: {"hause": ["house"], "mousc": ["mousc"]}, 4: {}}
    assert {(r["artifact_id"], r["word"]) for r in scans.find_noise(texts, parts, support).collect()} == {(1, "house"), (2, "house")}


def test_scans_with_planted_noise(spark):
    rng = random.Random(10)
    clean = [text(rng, 60) for _ in range(80)]
    swaps = [("d", "cl"), ("m", "rn"), ("a", "@"), ("o", "0"), ("i", "1"), ("e", "c")]
    truth, docs = {}, []
    for i in range(40):
        words = text(rng, 80).split()
        lines = [words[k : k + 8] for k in range(0, 80, 8)]
        for k, line in enumerate(lines):
            j = rng.randrange(8)
            a, b = rng.choice(swaps)
            if rng.random() < 0.4 and a in line[j] and len(line[j]) > 4:
                truth[i, k + 1 + 2 * (k >= 5), "misread", line[j]] = 1
                line[j] = line[j].replace(a, b, 1)
        page = lambda n, ls: ["Early report of Somewhere", *[" ".join(x) for x in ls], f"— {n} —"]  # noqa: B023, E731
        docs.append((i, "\n".join(page(1, lines[:5]) + page(2, lines[5:]))))
        truth |= {(i, k, "header", ""): 1 for k in (0, 7)} | {(i, k, "page_number", ""): 1 for k in (6, 13)}
    scanned = spark.createDataFrame(docs, "id bigint, text string")
    every = scanned.select("text", F.lit(True).alias("is_scan")).unionByName(spark.createDataFrame([(t, False) for t in clean], "text string, is_scan boolean"))
    counts = scans.learn_vocabulary(every)
    vectors = scans.learn_vectors(scanned.select("text"), counts)
    assert set(WORDS) <= set(counts) and all(np.isfinite(v).all() for v in vectors.values())
    parts = spark.sparkContext.broadcast((counts, vectors))
    got = {tuple(r) for r in scans.find_noise(scanned, parts).collect()}
    assert len(got & set(truth)) / len(truth) > 0.95 and len(got & set(truth)) / len(got) > 0.95
    shown = scans.repair_texts(scanned, parts).first()["text"]
    assert "Somewhere" not in shown and "—" not in shown
    assert scans.find_noise(scanned.limit(0), parts).count() == 0
    empty = spark.createDataFrame([], "text string, is_scan boolean")
    assert scans.learn_vocabulary(empty) == {} and scans.learn_vectors(empty.select("text"), {}) == {}
