"""Memories: titled, topic-tagged derivations of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import segments
from tidepool.sources import canonical
from tidepool.sources.files import EventSource

#: Directories and tokens that name no topic, and directories whose next part is a user's name.
BROAD = ["downloads", "documents", "desktop", "pictures", "videos", "music", "users", "user", "project", "projects", "workspace", "workspaces", "home", "appdata", "local", "temp", "tmp", "c", "d", "e"]
GENERIC = [
    "pdf", "py", "md", "docs", "docx", "download", "downloads", "file", "files", "desktop", "documents", "pictures", "videos", "music", "jpg", "jpeg", "png", "txt", "screenshot",
    "screenshotdiscovered", "application", "active", "project", "projects", "users", "user", "workspace", "workspaces", "c", "d", "e", "appdata", "local", "temp", "tmp", "home", "usr", "var",
]
HOMES = ["users", "user", "home"]
ARTIFACT_BONUS, TOPIC_BONUS = 0.1, 0.05


def is_topic(token: Column) -> Column:
    """Three characters or more, not digits alone, not generic."""
    low = F.lower(token)
    return (F.length(low) >= 3) & ~low.rlike("^[0-9]+$") & ~low.isin(GENERIC)


def topic_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0), is_topic)


def with_topics(rows: DataFrame) -> DataFrame:
    """rows (path, tags) with name, the file's name; filename_topics, of that name without its last extension, dotted parts
    from the back, case kept; folder_topics, of the directories, the deepest first, in lower case, without broad ones and
    users' names; tag_topics. In steps, so that nothing is worked out twice."""
    none = F.array().cast("array<string>")
    among = lambda x: x.isin(BROAD) | x.isin(GENERIC)
    return (
        rows.withColumn("_parts", F.coalesce(segments("path"), none))
        .withColumn("name", F.when(F.size("_parts") > 0, F.element_at("_parts", -1)))
        .withColumn("_dots", F.filter(F.split("name", r"\."), lambda p: p != ""))
        .withColumn("_dots", F.when(F.size("_dots") > 1, F.slice("_dots", 1, F.size("_dots") - 1)).otherwise(F.col("_dots")))
        .withColumn("_folders", F.transform(F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda x: F.lower(x)))
        .withColumn("_owners", F.filter(F.transform("_folders", lambda x, i: F.when((i > 0) & F.get("_folders", i - 1).isin(HOMES), F.trim(x))), lambda x: x.isNotNull()))
        .withColumn("_kept", F.filter(F.transform(F.reverse("_folders"), lambda x: F.trim(x)), lambda x: ~among(x) & ~F.array_contains("_owners", x)))
        .withColumn("filename_topics", F.coalesce(F.array_distinct(F.flatten(F.transform(F.reverse("_dots"), topic_tokens))), none))
        .withColumn("folder_topics", F.coalesce(F.array_distinct(F.flatten(F.transform("_kept", topic_tokens))), none))
        .withColumn("tag_topics", F.coalesce(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), is_topic), none))
        .drop("_parts", "_dots", "_folders", "_owners", "_kept")
    )


def episode_events(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """episode_id, pos, event_id, path, tags of the events of episodes that exist; an id repeated in an episode counts at
    its first place."""
    ids = episodes.select(F.col("id").alias("episode_id"), F.posexplode("event_ids").alias("pos", "event_id")).filter("event_id IS NOT NULL")
    ids = ids.groupBy("episode_id", "event_id").agg(F.min("pos").alias("pos"))
    return ids.join(events.select(F.col("id").alias("event_id"), "path", "tags"), "event_id")


def topic_sources(found: DataFrame) -> DataFrame:
    """episode_id, topic, source, source_type, ord: each topic of an episode where it first comes up; file names of an event
    come before its folders, these before its tags."""
    entry = lambda topics, kind, of, n: F.transform(topics, lambda t, i: F.struct(t.alias("topic"), of.alias("source"), F.lit(kind).alias("source_type"), F.lit(n).alias("rank"), i.alias("i")))
    rows = with_topics(found)
    entries = F.concat(
        entry(F.col("filename_topics"), "filename", F.col("name"), 0), entry(F.col("folder_topics"), "path_segment", F.col("path"), 1),
        entry(F.col("tag_topics"), "event_tag", F.lit(None).cast("string"), 2),
    )
    rows = rows.select("episode_id", "pos", F.explode(entries).alias("x")).select("episode_id", F.struct("pos", "x.rank", "x.i").alias("ord"), "x.topic", "x.source", "x.source_type")
    first = rows.groupBy("episode_id", "topic").agg(F.min(F.struct("ord", "source", "source_type")).alias("f"))
    return first.select("episode_id", "topic", F.coalesce("f.source", "topic").alias("source"), "f.source_type", "f.ord")


def derive(episodes: DataFrame, events: DataFrame | EventSource) -> DataFrame:
    """Memories of episodes (id, start_us, end_us, event_ids, artifact_ids, grouping_confidence) of which an event exists:
    id, episode_ids, event_ids, artifact_ids, start_us, end_us, title, topics, confidence, title_basis, topic_sources."""
    found = episode_events(episodes, events.events(episodes.sparkSession) if isinstance(events, EventSource) else events)
    alive = found.select("episode_id").distinct()
    topics = topic_sources(found).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("ord", "topic", "source", "source_type"))).alias("t"))
    rows = episodes.join(alive, episodes["id"] == alive["episode_id"], "left_semi").join(topics, episodes["id"] == topics["episode_id"], "left")
    t = F.coalesce(F.col("t"), F.array().cast(topics.schema["t"].dataType))
    names = F.array_distinct(F.transform(F.filter(t, lambda x: x["source_type"] == "filename"), lambda x: x["source"]))
    words = F.transform(t, lambda x: x["topic"])
    two = lambda xs: F.concat(F.lit("Activity involving "), F.array_join(F.slice(xs, 1, 2), " and "))
    hour = lambda c: F.date_format(F.timestamp_add("MICROSECOND", F.col(c), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), "HH:mm")
    title = F.when(F.size(names) > 0, two(names)).when(F.size(words) > 0, two(words)).otherwise(F.concat(F.lit("Activity — "), hour("start_us"), F.lit("–"), hour("end_us")))
    bonus = F.when(F.coalesce(F.size("artifact_ids"), F.lit(0)) > 0, ARTIFACT_BONUS).otherwise(0.0) + F.when(F.size(words) > 0, TOPIC_BONUS).otherwise(0.0)
    return rows.select(
        F.concat(F.lit("memory_"), F.col("id")).alias("id"), F.array("id").alias("episode_ids"), "event_ids", "artifact_ids", "start_us", "end_us", title.alias("title"), words.alias("topics"),
        F.least(F.greatest(F.coalesce("grouping_confidence", F.lit(0.0)) + bonus, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.when(F.size(names) > 0, "artifact_names").when(F.size(words) > 0, "topics").otherwise("time_range").alias("title_basis"),
        F.transform(t, lambda x: F.struct(x["topic"].alias("topic"), x["source"].alias("source"), x["source_type"].alias("source_type"))).alias("topic_sources"),
    )


def memories(spark, sf_dir: str) -> DataFrame:
    """Memories of the stored episodes."""
    return derive(canonical.episodes(spark, sf_dir), canonical.events(spark, sf_dir))


# Queries -----------------------------------------------------------------------------------------------------------


def memory_topics(spark, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.array_join("topics", ",").alias("topics"), F.size("topics").cast("bigint").alias("n_topics"))


def memory_titles(spark, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", "title", "title_basis")


def memory_confidence(spark, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round("confidence", 6).alias("confidence"))


_words = lambda ws: ", ".join(f"'{w}'" for w in ws)
_TOPICS = "list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND lower(w) NOT IN (" + _words(GENERIC) + "))"
MEMORIES_SQL = f"""
WITH {canonical.EVENTS_SQL}, {canonical.EPISODES_SQL},
ids AS (SELECT episode_id, event_id, min(pos) AS pos FROM (SELECT id AS episode_id, unnest(event_ids) AS event_id, generate_subscripts(event_ids, 1) AS pos FROM ep) WHERE event_id IS NOT NULL GROUP BY ALL),
found AS (SELECT ids.*, ev.path, ev.tags, list_filter(string_split(ev.path, '/'), lambda x: x <> '') AS parts FROM ids JOIN ev ON ev.id = ids.event_id),
named AS (SELECT *, parts[len(parts)] AS name, list_filter(string_split(parts[len(parts)], '.'), lambda p: p <> '') AS dotted, list_transform(parts[1:len(parts) - 1], lambda x: lower(x)) AS folders FROM found WHERE len(parts) > 0),
kept AS (
  SELECT *, list_reverse(CASE WHEN len(dotted) > 1 THEN dotted[1:len(dotted) - 1] ELSE dotted END) AS stems,
    list_filter(list_reverse(folders), lambda x: trim(x) NOT IN ({_words(BROAD)}) AND trim(x) NOT IN ({_words(GENERIC)}) AND NOT list_contains(list_transform(list_filter(range(1, len(folders)), lambda i: folders[i] IN ({_words(HOMES)})), lambda i: folders[i + 1]), trim(x))) AS dirs
  FROM named
),
toks AS (
  SELECT episode_id, pos, 0 AS r, name AS source, 'filename' AS kind, flatten(list_transform(stems, lambda p: {_TOPICS.format("p")})) AS ts FROM kept
  UNION ALL SELECT episode_id, pos, 1, path, 'path_segment', flatten(list_transform(dirs, lambda p: {_TOPICS.format("trim(p)")})) FROM kept
  UNION ALL SELECT episode_id, pos, 2, NULL, 'event_tag', list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_words(GENERIC)})) FROM found WHERE tags IS NOT NULL
),
each AS (SELECT episode_id, pos, r, source, kind, unnest(ts) AS topic, generate_subscripts(ts, 1) AS i FROM toks),
firsts AS (SELECT episode_id, topic, min((pos, r, i)) AS o, arg_min(source, (pos, r, i)) AS source, arg_min(kind, (pos, r, i)) AS kind FROM each GROUP BY ALL),
agg AS (SELECT episode_id, list(topic ORDER BY o) AS topics FROM firsts GROUP BY ALL),
files AS (SELECT episode_id, list(source ORDER BY o) AS names FROM (SELECT episode_id, source, min(o) AS o FROM firsts WHERE kind = 'filename' GROUP BY ALL) GROUP BY ALL),
m AS (SELECT ep.*, 'memory_' || ep.id AS mid, coalesce(agg.topics, []) AS topics, coalesce(files.names, []) AS names FROM ep LEFT JOIN agg ON agg.episode_id = ep.id LEFT JOIN files ON files.episode_id = ep.id WHERE ep.id IN (SELECT episode_id FROM found))
"""
QUERIES = {"memory_topics": memory_topics, "memory_titles": memory_titles, "memory_confidence": memory_confidence}
SQL = {
    "memory_topics": MEMORIES_SQL + "SELECT mid AS id, array_to_string(topics, ',') AS topics, len(topics) AS n_topics FROM m",
    "memory_titles": MEMORIES_SQL
    + "SELECT mid AS id, CASE WHEN len(names) > 0 THEN 'Activity involving ' || array_to_string(names[1:2], ' and ') WHEN len(topics) > 0 THEN 'Activity involving ' || array_to_string(topics[1:2], ' and ') ELSE 'Activity — ' || strftime(start_ts, '%H:%M') || '–' || strftime(end_ts, '%H:%M') END AS title, CASE WHEN len(names) > 0 THEN 'artifact_names' WHEN len(topics) > 0 THEN 'topics' ELSE 'time_range' END AS title_basis FROM m",
    "memory_confidence": MEMORIES_SQL
    + "SELECT mid AS id, round(least(greatest(coalesce(grouping_confidence, 0) + CASE WHEN len(artifact_ids) > 0 THEN 1e-1 ELSE 0e0 END + CASE WHEN len(topics) > 0 THEN 5e-2 ELSE 0e0 END, 0), 1), 6) AS confidence FROM m",
}
