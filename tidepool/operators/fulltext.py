"""Full-text retrieval: inverted index, BM25 with implicit AND and phrases, snippets.

A query without a stored index (operators.textindex) is scored in one scan of the texts: terms are counted in each row,
nothing is exploded. Many queries at once meet the postings of their words in blocks of documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.porter import stem, stems
from tidepool.functions.text import index_tokens
from tidepool.session import cut
from tidepool.sources import canonical

#: BM25 parameters, the least idf, the columns that are indexed.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ["path", "file_name", "mime_type", "extracted_text"]
#: Postings and queries of a block in which many queries meet the documents.
BLOCK_POSTINGS, BLOCK_QUERIES = 1 << 20, 1 << 16


def _tokens(column: str, stemmed: bool) -> Column:
    return stems(index_tokens(column)) if stemmed else index_tokens(column)


def postings(docs: DataFrame, stemmed: bool = False, columns: list[str] = COLUMNS) -> DataFrame:
    """token, id, tf, dl (tokens in all columns) of docs (id, columns). Null columns count as empty."""
    rows = docs.select("id", F.concat(*[_tokens(c, stemmed) for c in columns]).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))
    return rows.select("id", "dl", F.explode("tokens").alias("token")).groupBy("token", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_numbers(docs: DataFrame, stemmed: bool = False, columns: list[str] = COLUMNS) -> DataFrame:
    """n_docs, n_tokens, avgdl: one row."""
    size = F.size(F.concat(*[_tokens(c, stemmed) for c in columns])).cast("bigint")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_tokens"), F.avg(size).alias("avgdl"))


def terms_of(query: str) -> list[list[str]]:
    """The query's words; one with underscores is the phrase of its parts."""
    words = re.sub(r"[^\w\s]", " ", query or "").split()
    phrases = [[t for t in re.split(r"[\W_]+", w.lower()) if t] for w in words]
    return [p for i, p in enumerate(phrases) if p and p not in phrases[:i]]


def _count(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0])).cast("double")
    wanted = F.array(*[F.lit(p) for p in phrase])
    starts = F.filter(F.transform(tokens, lambda t, i: i), lambda i: F.slice(tokens, i + 1, len(phrase)) == wanted)
    return F.size(starts).cast("double")


def search(docs: DataFrame, query: str, limit: int = 20, mime_contains: str | None = None, stemmed: bool = False) -> DataFrame:
    """The limit best of docs (id, missing and COLUMNS, others are kept) that have every term: docs' columns and rank
    (smaller is better), ordered by rank, then path. Missing docs count for the statistics only. A query without words, or
    an empty table, finds nothing."""
    phrases = [[stem(t) if stemmed else t for t in p] for p in terms_of(query)]
    if not phrases:
        return docs.limit(0).withColumn("rank", F.lit(0.0))
    names = [f"_f{i}" for i in range(len(phrases))]
    # tokens are made once a row; phrases stay within a column
    rows = docs.withColumns({f"_t{j}": _tokens(c, stemmed) for j, c in enumerate(COLUMNS)})
    counts = {n: sum((_count(F.col(f"_t{j}"), p) for j in range(len(COLUMNS))), F.lit(0.0)) for n, p in zip(names, phrases, strict=True)}
    length = sum((F.size(f"_t{j}") for j in range(len(COLUMNS))), F.lit(0)).cast("double")
    rows = rows.withColumns(counts | {"_dl": length})
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(n) for n in names]).first()
    score, every = F.lit(0.0), F.lit(True)
    for n in names:
        idf = math.log((totals["n"] - totals[n] + 0.5) / (totals[n] + 0.5))
        every = every & (F.col(n) > 0)
        score = score + (idf if idf > 0 else LEAST_IDF) * (F.col(n) * (K1 + 1)) / (F.col(n) + K1 * (1 - B + B * F.col("_dl") / (totals["avgdl"] or 1.0)))
    kept = every & ~F.coalesce("missing", F.lit(False))
    if mime_contains:
        kept = kept & F.lower("mime_type").contains(mime_contains.lower())
    found = rows.filter(kept).withColumn("rank", -score).drop(*names, "_dl", *[f"_t{j}" for j in range(len(COLUMNS))])
    return found.orderBy("rank", "path").limit(limit)


def search_many(index: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, id, rank, position: of each query (query_id, query_text) the limit best docs that have all its words.

    index: postings. Statistics are the index's own. Queries without words find nothing; repeated ones count once."""
    totals = index.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return best_of_many(index, queries, totals["n"], float(totals["avgdl"] or 1.0), limit)


def matches_of_block(tokens: list, posted: tuple[np.ndarray, np.ndarray, np.ndarray], asked: list[tuple[int, list]], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, document, score): of each query (least number of words, words) the limit best documents that have
    so many of its words, by their summed scores rounded to six digits, then the smaller document. posted: index into tokens,
    document from 0 on, score; a word's documents are narrowed down by the next words, the rarest is first."""
    word, doc, score = posted
    order = np.lexsort((doc, word))
    doc, score = doc[order], score[order]
    sizes = np.bincount(word, minlength=len(tokens))
    lists = {t: (doc[b - n : b], score[b - n : b]) for t, n, b in zip(tokens, sizes, np.cumsum(sizes), strict=True)}
    n = int(doc.max(initial=-1)) + 1
    dense: dict = {}
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, (least, words) in enumerate(asked):
        mine = sorted((lists[t] + (t,) for t in words if t in lists), key=lambda x: len(x[0]))
        if len(mine) < least:
            continue
        if len(words) > least:  # an id that repeats with other words: any so many of them, as the SQL has it
            d = np.concatenate([x[0] for x in mine])
            d, at, times = np.unique(d, return_inverse=True, return_counts=True)
            s = np.bincount(at, np.concatenate([x[1] for x in mine]))
            d, s = d[times == least], s[times == least]
        else:
            d, s, _ = mine[0]
            for docs, scores, t in mine[1:]:
                if len(docs) * 8 > n:
                    if t not in dense:
                        dense[t] = np.full(n, np.nan)
                        dense[t][docs] = scores
                    more = dense[t][d]
                    both = ~np.isnan(more)
                else:
                    at = np.minimum(np.searchsorted(docs, d), len(docs) - 1)
                    both, more = docs[at] == d, scores[at]
                d, s = d[both], s[both] + more[both]
        if len(d) > limit:
            best = np.argsort(np.round(-s, 6), kind="stable")[:limit]
            d, s = d[best], s[best]
        if len(d):
            found.append((np.full(len(d), i), d, s))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def best_of_many(index: DataFrame, queries: DataFrame, n_docs: int, avgdl: float, limit: int) -> DataFrame:
    """search_many over postings of n_docs documents of avgdl tokens. Blocks of documents meet blocks of queries, and only
    each block's limit best of a query travel on."""
    spark = index.sparkSession
    tokens = F.array_distinct(index_tokens("query_text"))
    words = queries.select("query_id", F.size(tokens).alias("n_terms"), F.explode(tokens).alias("token")).distinct()
    df = cut(index.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df")
    posted = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    d_blocks = max(1, math.ceil(posted / BLOCK_POSTINGS), min(2 * spark.sparkContext.defaultParallelism, posted // (BLOCK_POSTINGS // 32)))
    q_blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    hits = index.join(df, "token").select("token", "id", (F.when(idf > 0, idf).otherwise(LEAST_IDF) * weight).alias("s"))
    hits = hits.withColumn("_d", F.pmod(F.xxhash64("id"), F.lit(d_blocks)).cast("int")).withColumn("_q", every(q_blocks))
    asked = words.groupBy("query_id", "n_terms").agg(F.collect_list("token").alias("tokens"))
    asked = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("_d", every(d_blocks))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        token = b["token"].combine_chunks().dictionary_encode()
        _, at, doc = np.unique(b["id"].to_numpy(), return_index=True, return_inverse=True)
        posted = token.indices.to_numpy(), doc, b["s"].to_numpy()
        i, d, s = matches_of_block(token.dictionary.to_pylist(), posted, list(zip(a["n_terms"].to_pylist(), a["tokens"].to_pylist(), strict=True)), limit)
        return pa.table({"query_id": a["query_id"].take(pa.array(i)), "id": b["id"].take(pa.array(at[d])), "s": pa.array(s)})

    schema = T.StructType([queries.schema["query_id"], index.schema["id"], T.StructField("s", T.DoubleType())])
    scored = asked.groupBy("_d", "_q").cogroup(hits.groupBy("_d", "_q")).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.round(-F.col("s"), 6), "id")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("query_id", "id", F.round(-F.col("s"), 6).alias("rank"), "position")


def normalized(rank: Column, over: list[Column] | None = None) -> Column:
    """Ranks to 1 (best) .. 0 (worst) in each partition; 1 where all are equal."""
    w = Window.partitionBy(*(over or [F.lit(0)]))
    low, high = F.min(rank).over(w), F.max(rank).over(w)
    return F.when(rank.isNotNull(), F.when(low == high, 1.0).otherwise((high - rank) / (high - low)))


def snippet(text: Column, words: list[str], size: int = 10, stemmed: bool = False) -> Column:
    """The size tokens of the text with the most different words of the query, these in brackets, ... where text is left
    out; the text's beginning if none is there. Meant for the few rows that are shown."""
    wanted = {stem(w) if stemmed else w for w in words}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return ""
            spans = [m.span() for m in re.finditer(r"[^\W_]+", t)]
            if not spans:
                return ""
            keys = [t[a:b].lower() for a, b in spans]
            hit = [(stem(k) if stemmed else k) in wanted for k in keys]
            best = max(range(max(1, len(spans) - size + 1)), key=lambda i: (len({k for k, h in zip(keys[i : i + size], hit[i : i + size], strict=True) if h}), sum(hit[i : i + size]), -i))
            chosen = list(range(best, min(len(spans), best + size)))
            a, b = (spans[chosen[0]][0] if best else 0), spans[chosen[-1]][1]
            out, at = "", a
            for i in chosen:
                if hit[i]:
                    out += t[at : spans[i][0]] + "[" + t[spans[i][0] : spans[i][1]] + "]"
                    at = spans[i][1]
            out += t[at:b]
            return ("..." if best else "") + out + ("..." if b < len(t.rstrip()) else "")

        return texts.map(one)

    return run(text)


# Queries -----------------------------------------------------------------------------------------------------------

QUERY = "calendar warehouse"
_DOCS = canonical.artifacts


def bm25_scan(spark, sf_dir: str) -> DataFrame:
    """The same as bm25_topk, without a stored index."""
    return search(_DOCS(spark, sf_dir), QUERY).select("id", "path", F.round("rank", 6).alias("rank"))


def fts_rank_normalized(spark, sf_dir: str) -> DataFrame:
    return search(_DOCS(spark, sf_dir), QUERY).select("id", F.round(normalized(F.col("rank")), 6).alias("fts"))


def stemmed_search(spark, sf_dir: str) -> DataFrame:
    return search(_DOCS(spark, sf_dir), "calendars warehouses", stemmed=True).select("id", "path", F.round("rank", 6).alias("rank"))


def snippets(spark, sf_dir: str) -> DataFrame:
    found = search(_DOCS(spark, sf_dir), QUERY)
    return found.select("id", snippet(F.col("extracted_text"), QUERY.split()).alias("snippet"))


_T = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
INDEX_SQL = f"""
WITH {canonical.ARTIFACTS_SQL},
tok AS (SELECT id, path, missing, {" || ".join(_T.format(c) for c in COLUMNS)} AS ts FROM art),
dl AS (SELECT id, path, missing, len(ts) AS dl FROM tok),
post AS (SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(ts) AS token FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(dl) AS total FROM dl)"""
_SCORE = "CASE WHEN ln((n - df + 5e-1) / (df + 5e-1)) > 0 THEN ln((n - df + 5e-1) / (df + 5e-1)) ELSE 1e-6 END * (tf * 22e-1) / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))"
_TOP = f"""{INDEX_SQL},
df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
hits AS (SELECT id, path, -sum({_SCORE}) AS rank FROM post JOIN df USING (token) JOIN dl USING (id), st WHERE token IN ({", ".join(f"'{t}'" for t in QUERY.split())}) AND NOT coalesce(missing, false) GROUP BY ALL HAVING count(*) = {len(QUERY.split())}),
top AS (SELECT * FROM hits ORDER BY rank, path LIMIT 20)"""
#: The forms of the query's words that Porter's rules take to one stem.
_STEMMED = _TOP.replace("AS ts FROM art)", "AS ts0 FROM art)").replace("tok AS (SELECT", "tok AS (SELECT *, list_transform(ts0, lambda t: CASE WHEN regexp_full_match(t, 'calendar(s|ed|ing)?') THEN 'calendar' WHEN regexp_full_match(t, 'warehous(e|es|ed|ing)?') THEN 'warehouse' ELSE t END) AS ts FROM (SELECT", 1).replace("AS ts0 FROM art)", "AS ts0 FROM art))", 1)
_SHOWN = r"""
, s AS (SELECT id, extracted_text AS t, regexp_extract_all(extracted_text, '[\p{L}\p{N}]+') AS ts, regexp_split_to_array(extracted_text, '[\p{L}\p{N}]+') AS gaps FROM art WHERE id IN (SELECT id FROM top)),
wins AS (SELECT *, unnest(range(0, greatest(1, len(ts) - 9))) AS i FROM s WHERE len(ts) > 0),
rated AS (SELECT *, list_filter(list_transform(ts[i + 1:i + 10], lambda w: lower(w)), lambda w: w IN (TERMS)) AS hits FROM wins),
best AS (SELECT id, t, ts, gaps, arg_min(i, (-len(list_distinct(hits)), -len(hits), i)) AS i FROM rated GROUP BY ALL),
shots AS (SELECT id, CASE WHEN i > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(i + 1, least(len(ts), i + 10) + 1), lambda k: CASE WHEN k = i + 1 AND i > 0 THEN '' ELSE gaps[k] END || CASE WHEN lower(ts[k]) IN (TERMS) THEN '[' || ts[k] || ']' ELSE ts[k] END), '')
  || CASE WHEN i + 10 < len(ts) OR trim(gaps[len(ts) + 1], E' \t\n\r\x0b\x0c') <> '' THEN '...' ELSE '' END AS snippet FROM best)""".replace("TERMS", ", ".join(f"'{w}'" for w in QUERY.split()))
QUERIES = {f.__name__: f for f in (bm25_scan, fts_rank_normalized, stemmed_search, snippets)}
SQL = {
    **dict.fromkeys(("bm25_topk", "bm25_scan"), _TOP + " SELECT id, path, round(rank, 6) AS rank FROM top"),
    "stemmed_search": _STEMMED + " SELECT id, path, round(rank, 6) AS rank FROM top",
    "snippets": _TOP + _SHOWN + " SELECT top.id, coalesce(snippet, '') AS snippet FROM top LEFT JOIN shots USING (id)",
    "fts_rank_normalized": _TOP + " SELECT id, round(CASE WHEN min(rank) OVER () = max(rank) OVER () THEN 1e0 ELSE (max(rank) OVER () - rank) / (max(rank) OVER () - min(rank) OVER ()) END, 6) AS fts FROM top",
    "token_document_frequency": INDEX_SQL + " SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY token",
    "corpus_stats": INDEX_SQL + " SELECT n AS n_docs, CAST(total AS BIGINT) AS n_tokens, round(avgdl, 6) AS avgdl FROM st",
    "bm25_and_match": INDEX_SQL
    + rf""",
q AS (SELECT DISTINCT query_id, len(list_distinct(ts)) AS n_terms, unnest(list_distinct(ts)) AS token FROM (SELECT query_id, {_T.format("query_text")} AS ts FROM search_queries)),
df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
s AS (SELECT query_id, id, n_terms, count(*) AS m, sum({_SCORE}) AS s FROM q JOIN post USING (token) JOIN df USING (token) JOIN dl USING (id), st GROUP BY ALL HAVING count(*) = n_terms)
SELECT * FROM (SELECT query_id, id, round(-s, 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(-s, 6), id) AS position FROM s) WHERE position <= 20""",
}
