"""A stored inverted index: postings by token in buckets, what is known of each document, and the collection's numbers.

The index is a folder of segments, each published by one rename. A document belongs to the newest segment that has it, so
replacing documents writes a small segment and leaves the others as they are; many segments are folded into one. A search
reads only the buckets, and in them only the row groups, of its own words.
"""

from __future__ import annotations

import json
import math

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.porter import stem
from tidepool.operators.fulltext import B, COLUMNS, K1, LEAST_IDF, _tokens, best_of_many, terms_of

#: A segment has eight buckets for so many documents, and MOST_BUCKETS at most.
BUCKET_DOCS, MOST_BUCKETS = 20_000, 4_096
#: Segments that are folded into one, and the places of a token kept apart for each column.
MOST_SEGMENTS, COLUMN_PLACES = 8, 1 << 26
DOCS = "id bigint, path string, mime_type string, missing boolean, dl bigint, deleted boolean"
POSTINGS = "token string, id bigint, tf bigint, dl bigint, places array<int>, bucket int"


def bucket_of(token: str, buckets: int) -> int:
    """The bucket of a token: pmod(xxhash64(token), buckets), which Spark seeds with 42."""
    h = xxhash.xxh64_intdigest(token.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = False):
        self.spark, self.folder, self.stemmed = spark, folder.rstrip("/"), stemmed
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def segments(self) -> list[str]:
        """Names of the segments, oldest first; a folded one replaces those before it."""
        if not self._fs.exists(self._path("")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        names = [n for n in names if n.startswith("segment-")]
        whole = [i for i, n in enumerate(names) if n.endswith("-whole")]
        return names[whole[-1] if whole else 0 :]

    def _meta(self, segment: str) -> dict:
        stream = self._fs.open(self._path(f"{segment}/meta.json"))
        try:
            size = self._fs.getFileStatus(self._path(f"{segment}/meta.json")).getLen()
            return json.loads(bytes(bytearray(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))))
        finally:
            stream.close()

    def build(self, docs: DataFrame) -> TextIndex:
        """Index docs (id, path, mime_type, missing and COLUMNS) as a whole."""
        return self._add(docs, None, "-whole")

    def replace(self, docs: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """Index docs anew, in place of what the index has of their ids, and forget the ids of gone (id)."""
        self._add(docs, gone, "" if self.segments() else "-whole")
        if len(self.segments()) > MOST_SEGMENTS:
            self._fold()
        return self

    def _add(self, docs: DataFrame, gone: DataFrame | None, kind: str) -> TextIndex:
        parts = [_placed(_tokens(c, self.stemmed), k * COLUMN_PLACES) for k, c in enumerate(COLUMNS)]
        rows = docs.select("id", "path", "mime_type", F.coalesce("missing", F.lit(False)).alias("missing"), F.concat(*parts).alias("tokens"))
        known = rows.select("id", "path", "mime_type", "missing", F.size("tokens").cast("bigint").alias("dl"), F.lit(False).alias("deleted"))
        if gone is not None:
            dropped = gone.select("id").distinct().select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("mime_type"), F.lit(False).alias("missing"), F.lit(0).cast("bigint").alias("dl"), F.lit(True).alias("deleted"))
            known = known.unionByName(dropped.join(known.select("id"), "id", "left_anti"))
        each = rows.select("id", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("t")).groupBy(F.col("t.token").alias("token"), "id", "dl")
        posted = each.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("t.place")).alias("places"))
        return self._publish(known, posted, kind)

    def _publish(self, known: DataFrame, posted: DataFrame, kind: str) -> TextIndex:
        number = len([s for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("segment-")]) if self._fs.exists(self._path("")) else 0
        name = f"segment-{number + 1:06d}{kind}"
        staged = f"{self.folder}/.staged-{name}"
        known.write.mode("overwrite").parquet(f"{staged}/docs")
        live = self.spark.read.schema(DOCS).parquet(f"{staged}/docs").filter("NOT deleted")
        n, n_tokens = live.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        buckets = min(MOST_BUCKETS, 8 * max(1, n // BUCKET_DOCS))
        bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
        posted.select("token", "id", "tf", "dl", "places", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/postings")
        out = self._fs.create(self._path(f".staged-{name}/meta.json"), True)
        try:
            out.write(bytearray(json.dumps({"buckets": buckets, "n_docs": n, "n_tokens": n_tokens}).encode()))
        finally:
            out.close()
        if not self._fs.rename(self._path(f".staged-{name}"), self._path(name)):
            raise RuntimeError(f"{name} could not be published")
        return self

    def _fold(self) -> None:
        docs = self.docs().withColumn("deleted", F.lit(False))
        self._publish(docs, self.postings().drop("bucket"), "-whole")

    def docs(self) -> DataFrame:
        """id, path, mime_type, missing, dl of each document as it was indexed last."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], DOCS).drop("deleted")
        parts = [self.spark.read.schema(DOCS).parquet(f"{self.folder}/{s}/docs").withColumn("_s", F.lit(s)) for s in segments]
        if len(parts) == 1:
            return parts[0].filter("NOT deleted").drop("deleted", "_s")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        last = rows.groupBy("id").agg(F.max_by(F.struct("path", "mime_type", "missing", "dl", "deleted"), "_s").alias("d"))
        return last.filter("NOT d.deleted").select("id", "d.path", "d.mime_type", "d.missing", "d.dl")

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """token, id, tf, dl, places; of the tokens given only."""
        segments, rows = self.segments(), None
        for i, s in enumerate(segments):
            part = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{s}/postings")
            if tokens is not None:
                buckets = self._meta(s)["buckets"]
                part = part.filter(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in tokens})) & F.col("token").isin(tokens))
            for newer in segments[i + 1 :]:
                part = part.join(self.spark.read.schema(DOCS).parquet(f"{self.folder}/{newer}/docs").select("id"), "id", "left_anti")
            rows = part if rows is None else rows.unionByName(part)
        return rows if rows is not None else self.spark.createDataFrame([], POSTINGS)

    def numbers(self) -> dict:
        """n_docs, n_tokens, avgdl of the collection, from what is known of the documents."""
        segments = self.segments()
        if len(segments) == 1:
            meta = self._meta(segments[0])
            return {"n_docs": meta["n_docs"], "n_tokens": meta["n_tokens"], "avgdl": meta["n_tokens"] / meta["n_docs"] if meta["n_docs"] else 0.0}
        got = self.docs().agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.avg("dl").alias("avgdl")).first().asDict()
        return got | {"avgdl": got["avgdl"] or 0.0}

    def search(self, query: str, limit: int = 20, mime_contains: str | None = None) -> DataFrame:
        """id, path, rank of the limit best documents that have every term of the query and are not missing (smaller ranks
        are better), ordered by rank, then path: what fulltext.search finds by reading all texts."""
        phrases = [[stem(t) if self.stemmed else t for t in p] for p in terms_of(query)]
        tokens = sorted({t for p in phrases for t in p})
        none = self.spark.createDataFrame([], "id bigint, path string, rank double")
        if not phrases:
            return none
        places = [F.max(F.when(F.col("token") == t, F.col("places"))).alias(f"_p{tokens.index(t)}") for t in tokens]
        rows = self.postings(tokens).groupBy("id", "dl").agg(*places)
        at = {t: F.col(f"_p{i}") for i, t in enumerate(tokens)}
        names = [f"_f{i}" for i in range(len(phrases))]
        rows = rows.select("id", "dl", *[F.coalesce(_occurrences([at[t] for t in p]), F.lit(0.0)).alias(n) for n, p in zip(names, phrases, strict=True)])
        found = rows.agg(*[F.count_if(F.col(n) > 0).alias(n) for n in names]).first()
        if not all(found[n] for n in names):
            return none
        numbers, score, every = self.numbers(), F.lit(0.0), F.lit(True)
        for n in names:
            idf = math.log((numbers["n_docs"] - found[n] + 0.5) / (found[n] + 0.5))
            every = every & (F.col(n) > 0)
            score = score + (idf if idf > 0 else LEAST_IDF) * (F.col(n) * (K1 + 1)) / (F.col(n) + K1 * (1 - B + B * F.col("dl").cast("double") / (numbers["avgdl"] or 1.0)))
        kept = self.docs().filter("NOT missing")
        if mime_contains:
            kept = kept.filter(F.lower("mime_type").contains(mime_contains.lower()))
        hits = rows.filter(every).select("id", (-score).alias("rank")).join(kept.select("id", "path"), "id")
        return hits.orderBy("rank", "path").limit(limit).select("id", "path", "rank")

    def search_many(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """query_id, id, rank, position: of each query (query_id, query_text) the limit best documents, missing ones too,
        that have all its words. Queries without words find nothing; repeated ones count once."""
        numbers = self.numbers()
        return best_of_many(self.postings().select("token", "id", "tf", "dl"), queries, numbers["n_docs"], float(numbers["avgdl"] or 1.0), limit)


def _placed(tokens: Column, first: int) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (i + first).cast("int").alias("place")))


def _occurrences(places: list[Column]) -> Column:
    """How often the tokens with these places stand in a row; null where one has none."""
    if len(places) == 1:
        return F.when(places[0].isNotNull(), F.size(places[0]).cast("double"))
    first, *rest = places
    together = lambda p: _all([F.array_contains(x, p + i) for i, x in enumerate(rest, 1)])
    return F.when(_all([p.isNotNull() for p in places]), F.size(F.filter(first, together)).cast("double"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
