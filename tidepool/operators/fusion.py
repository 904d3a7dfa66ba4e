"""Fusion of candidates from several paths, hybrid scores, explanations, and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.clock import iso_text, nearness
from tidepool.functions.text import contains_any
from tidepool.operators.lookups import members, newest_per
from tidepool.plans.understanding import TimeRange, Understood

#: Weights of the parts of a score, and how many episodes of an artifact are shown.
W_FTS, W_SEMANTIC, W_FILENAME, W_TEMPORAL, W_EPISODE, W_MEMORY = 0.35, 0.25, 0.15, 0.12, 0.08, 0.05
SHOWN = 3
BASE = ["id", "path", "file_name", "mime_type", "size", "modified_us", "last_opened_ms"]


def path_rows(rows: DataFrame, ordinal: int, order: list[Column], place: list[Column] | None = None) -> DataFrame:
    """A retrieval path's rows with what the merge needs. They were found in the order given: of a path that ends in a limit
    the rows are numbered; for others place has its four parts (two numbers, a text, a number), and no row need see another."""
    if place is None:
        place = [F.row_number().over(Window.partitionBy(F.lit(ordinal)).orderBy(*order)), F.lit(None), F.lit(None), F.lit(None)]
    at = F.struct(*[c.cast(t).alias(n) for c, t, n in zip(place, ("bigint", "bigint", "string", "int"), "abcd", strict=True)])
    have = set(rows.columns)
    extra = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("rank", "double"), ("snippet", "string"), ("similarity", "double"))]
    return rows.select(*BASE, *extra, F.lit(ordinal).alias("path_no"), at.alias("path_at"))


def merge(paths: list[DataFrame]) -> DataFrame:
    """One row an artifact: where it was first found (path_no, path_at), rank and snippet of the full-text path (2), the
    greatest similarity, and the semantic path's (3) text as snippet where there is no other."""
    rows = paths[0]
    for p in paths[1:]:
        rows = rows.unionByName(p)
    place = F.struct("path_no", "path_at")
    base = F.min_by(F.struct(*BASE), place)
    lexical = F.col("path_no") == 2
    return (
        rows.groupBy("id")
        .agg(
            base.alias("b"), F.min(place).alias("found"), F.bool_or(lexical).alias("fts_matched"), F.max(F.when(lexical, F.col("rank"))).alias("rank"),
            F.max(F.when(lexical, F.nullif("snippet", F.lit("")))).alias("_s2"), F.max(F.when(F.col("path_no") == 3, F.col("snippet"))).alias("_s3"), F.max("similarity").alias("semantic"),
        )
        .select("b.*", "found", "fts_matched", "rank", F.coalesce("_s2", "_s3", F.lit("")).alias("snippet"), "semantic")
    )


def classify(direct: Column, signals: Column) -> Column:
    """FACT for what was observed itself, INFERENCE for what was derived from something observed, else GUESS."""
    return F.when(direct, "FACT").when(signals, "INFERENCE").otherwise("GUESS")


def related(ids: DataFrame, episodes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of artifacts (id): the newest SHOWN episodes of each (artifact_id, episode_id, position and more), and the memories of
    these episodes (artifact_id, memory_id, position and more), each once."""
    mine = members(episodes.select(F.col("id").alias("episode_id"), "start_us", "end_us", "title", "event_ids", "grouping_confidence", "artifact_ids"), "artifact_ids", "artifact_id")
    mine = newest_per(mine.join(ids, mine["artifact_id"] == ids["id"], "left_semi").withColumn("id", F.col("episode_id")), "artifact_id", SHOWN)
    told = members(memories.select(F.col("id").alias("memory_id"), F.col("start_us").alias("m_start"), F.col("title").alias("m_title"), "confidence", "event_ids", "episode_ids"), "episode_ids", "episode_id")
    told = told.join(mine.select("artifact_id", "episode_id", "position"), "episode_id")
    once = Window.partitionBy("artifact_id", "memory_id").orderBy("position")
    return mine, told.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")


def without_evidence(candidates: DataFrame) -> DataFrame:
    """candidates as enrich gives those that have nothing."""
    text = "string"
    proof = f"array<struct<type: {text}, id: {text}, confidence_type: {text}, confidence: double, source: {text}, source_kind: {text}, title: {text}, snippet: {text}, path: {text}, timestamp: {text}>>"
    kinds = {"episodes": "array<struct<position: int, id: string, title: string, start_ts: string, end_ts: string>>", "memories": "array<struct<position: int, id: string, title: string>>", "evidence": proof}
    return candidates.withColumns({c: F.array().cast(t) for c, t in kinds.items()})


def proofs(ids: DataFrame, events: DataFrame, episodes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What speaks for artifacts (id), a row a piece: artifact_id, p (o: its place, x: what it says); and what related gives."""
    log = events.select(F.col("id").alias("event_id"))

    def resolves(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(name, "event_ids").distinct().select(name, F.explode("event_ids").alias("event_id"))
        return each.join(log, "event_id", "left_semi").select(name).distinct().withColumn("resolves", F.lit(True))

    mine, told = related(ids, episodes, memories)
    mine = mine.join(resolves(mine, "episode_id"), "episode_id", "left").withColumn("resolves", F.coalesce("resolves", F.lit(False)))
    told = told.join(resolves(told, "memory_id"), "memory_id", "left").withColumn("resolves", F.coalesce("resolves", F.lit(False)))

    def proof(kind: str, order: Column, ident: str, certain: Column, confidence: Column, source: Column, source_kind: Column, title: Column, snippet: Column, path: Column, at: Column) -> Column:
        given = {"type": F.lit(kind), "id": F.col(ident), "confidence_type": certain, "confidence": confidence.cast("double"), "source": source, "source_kind": source_kind, "title": title, "snippet": snippet, "path": path, "timestamp": at}
        return F.struct(order.alias("o"), F.struct(*[v.alias(k) for k, v in given.items()]).alias("x"))

    none = F.lit(None).cast("string")
    seen = events.select(F.col("id").alias("event_id"), "us", "event_type", "source", "source_kind", "event_confidence", F.col("path").alias("event_path"), F.col("artifact_id"))
    seen = seen.join(ids, seen["artifact_id"] == ids["id"], "left_semi")
    title = F.concat(F.coalesce("event_type", F.lit("event")), F.lit(" ("), F.coalesce("source_kind", F.lit("")), F.lit(")"))
    order = lambda part, *rest: F.struct(F.lit(part).alias("part"), *[r.alias(f"k{i}") for i, r in enumerate(rest)])
    e1 = seen.select("artifact_id", proof("event", order(0, F.col("us"), F.col("event_id")), "event_id", classify(F.lit(True), F.lit(False)), F.coalesce("event_confidence", F.lit(1.0)), F.col("source"), F.col("source_kind"), title, none, F.col("event_path"), iso_text(F.col("us"))).alias("p"))
    e2 = mine.select("artifact_id", proof("episode", order(1, F.col("position").cast("bigint"), F.col("episode_id")), "episode_id", classify(F.lit(False), F.col("resolves")), F.col("grouping_confidence"), F.lit("episode"), F.lit("derived"), F.col("title"), F.lit(""), none, iso_text(F.col("start_us"))).alias("p"))
    e3 = told.select("artifact_id", proof("memory", order(2, F.col("position").cast("bigint"), F.col("memory_id")), "memory_id", classify(F.lit(False), F.col("resolves")), F.col("confidence"), F.lit("memory"), F.lit("derived"), F.col("m_title"), F.col("m_title"), none, iso_text(F.col("m_start"))).alias("p"))
    return e1.unionByName(e2).unionByName(e3), mine, told


def evidence_rows(results: DataFrame, events: DataFrame, episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """artifact_id, ordinal and the fields of each piece of evidence for results (id): what enrich collects, as rows, for
    artifacts that have very much of it. Paths and snippets are those of the evidence itself."""
    rows, _, _ = proofs(results.select("id"), events, episodes, memories)
    at = F.row_number().over(Window.partitionBy("artifact_id").orderBy("p.o")) - 1
    return rows.select("artifact_id", at.cast("bigint").alias("ordinal"), "p.x.*")


def enrich(candidates: DataFrame, events: DataFrame, episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """candidates with episodes (the newest SHOWN), memories (of these, each once) and evidence: events by time, then these
    episodes, then these memories. What has none has empty arrays."""
    pieces, mine, told = proofs(candidates.select("id"), events, episodes, memories)
    pieces = pieces.groupBy("artifact_id").agg(F.array_sort(F.collect_list("p")).alias("proofs"))
    ep = mine.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("episode_id").alias("id"), "title", iso_text(F.col("start_us")).alias("start_ts"), iso_text(F.col("end_us")).alias("end_ts")))).alias("episodes"))
    mem = told.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("memory_id").alias("id"), F.col("m_title").alias("title")))).alias("memories"))
    rows = candidates
    for part in (ep, mem, pieces):
        rows = rows.join(part.withColumnRenamed("artifact_id", "_a"), rows["id"] == F.col("_a"), "left").drop("_a")
    fill = lambda x: x["x"].withField("path", F.coalesce(x["x"]["path"], F.col("path"), F.lit(""))).withField("snippet", F.coalesce(x["x"]["snippet"], F.col("snippet"), F.lit("")))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    return rows.withColumns({"episodes": empty("episodes"), "memories": empty("memories"), "evidence": F.transform(empty("proofs"), fill)}).drop("proofs")


def explain(said: Understood, when: TimeRange | None, temporal: Column) -> Column:
    """The sentences that tell why a candidate was found, in their order."""
    name, mime, shot = F.lower(F.coalesce("file_name", F.lit(""))), F.lower(F.coalesce("mime_type", F.lit(""))), F.lower(F.coalesce("snippet", F.lit("")))

    def first(text: Column) -> Column:
        return F.coalesce(*[F.when(text.contains(t.lower()), F.lit(t)) for t in said.terms], F.lit(None).cast("string"))

    named, told = first(name), first(shot)
    where = F.when(mime.startswith("image/"), "OCR text from screenshot").otherwise("document text")
    content = named.isNull() & told.isNotNull()
    semantic = F.greatest(F.coalesce("semantic", F.lit(0.0)), F.lit(0.0))
    parts = [
        F.when(named.isNotNull(), F.concat(F.lit("Matched '"), named, F.lit("' in filename."))),
        F.when(content, F.concat(F.lit("Matched '"), told, F.lit("' in "), where, F.lit("."))),
        F.when((semantic > 0) & ~content & named.isNull(), F.concat(F.lit("Semantic match to concepts in "), where, F.format_string(" (similarity: %.2f).", semantic))),
    ]
    if said.file_type:
        parts.append(F.when(mime.contains(said.file_type) | name.contains(said.file_type), F.lit(f"File type matches '{said.file_type}'.")))
    if when is not None:
        inside = f"Modified within approximate range of {when.original_expression}." if when.precision == "approximate" else f"Modified within requested range ({when.original_expression})."
        parts.append(F.when(temporal == 1.0, F.lit(inside)).when(temporal == 0.5, F.lit(f"Modified near requested range ({when.original_expression}).")))
    ep = F.get("episodes", F.lit(0))
    if said.intent == "activity":
        active = F.concat(F.lit("Artifact was active during episode on "), F.substring(iso_text(F.col("modified_us")), 1, 10), F.lit("."))
    else:
        active = F.concat(F.lit("Part of episode '"), ep["title"], F.lit("' ("), F.substring(ep["start_ts"], 1, 16), F.lit("–"), F.substring(ep["end_ts"], 1, 16), F.lit(")."))
    parts.append(F.when(F.size("episodes") > 0, active))
    parts.append(F.when(F.size("memories") > 0, F.concat(F.lit("Topic matches associated memory '"), F.get("memories", F.lit(0))["title"], F.lit("'."))))
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("Artifact matched search criteria."))


def score(candidates: DataFrame, said: Understood, when: TimeRange | None, has_episode: Column, has_memory: Column) -> DataFrame:
    """candidates with score. Full-text ranks are normalised over those that the full text matched: their ends are read
    first, so candidates should be a stored table."""
    start, end = when.micros() if when is not None and when.resolved else (None, None)
    value = F.when(F.col("fts_matched"), F.coalesce("rank", F.lit(0.0)))
    ends = candidates.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    lexical = F.when(value.isNotNull(), F.lit(1.0) if ends["low"] == ends["high"] else (ends["high"] - value) / (ends["high"] - ends["low"]))
    total = (
        W_FTS * F.coalesce(lexical, F.lit(0.0)) + W_SEMANTIC * F.greatest(F.coalesce("semantic", F.lit(0.0)), F.lit(0.0)) + W_FILENAME * contains_any("file_name", said.terms)
        + W_TEMPORAL * nearness(F.col("modified_us"), start, end) + W_EPISODE * has_episode.cast("double") + W_MEMORY * has_memory.cast("double")
    )
    return candidates.withColumn("score", total)


def first(scored: DataFrame, limit: int) -> DataFrame:
    """The limit best by score with position (equal ones in the order they were found); those without any score are left out."""
    best = scored.filter("score > 0").orderBy(F.round("score", 9).desc(), "found").limit(limit)
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("score", 9).desc(), "found")  # limit rows
    return best.withColumn("position", F.row_number().over(w))


def explained(rows: DataFrame, said: Understood, when: TimeRange | None) -> DataFrame:
    """rows with why."""
    resolved = when if when is not None and when.resolved else None
    start, end = resolved.micros() if resolved else (None, None)
    return rows.withColumn("why", explain(said, resolved, nearness(F.col("modified_us"), start, end)))


def rank(candidates: DataFrame, said: Understood, when: TimeRange | None, limit: int) -> DataFrame:
    """Enriched candidates with score, why and position: the limit best."""
    return explained(first(score(candidates, said, when, F.size("episodes") > 0, F.size("memories") > 0), limit), said, when)
