"""Problem 2: splitting oversized items at natural boundaries, by a recursive hierarchy of separators.

A text is split into sections; a section that is too long into paragraphs, these into sentences, these into words, and a
word into characters. The atoms are packed greedily into pieces up to the limit, each beginning with the last characters
of the piece before. Stored pieces are audited by the same hierarchy: where one ends inside a word, the text it covers is
split as a text to be cut is, and the boundaries found tell whether it could have ended at one; the other defects are
comparisons of offsets and texts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import cut, table

LIMIT = 500
OVERLAP = 100
#: Separators from the best to the least; the boundary is where one ends. After the last of them come single characters.
SEPARATORS = [
    ("section", re.compile(r"\f+\s*|(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*|\u2029")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*\s*|[\n\r\x85\u2028]+")),
    ("word", re.compile(r"[ \t\n\r\x85\u2028\u2029]+")),
]
WORD = len(SEPARATORS) - 1
CHARACTER = len(SEPARATORS)
#: Fixed value: the blanks, tabs and line ends at which a piece may end.
BLANKS = " \t\n\r\x85\u2028\u2029"
#: Texts are laid beside stored pieces in blocks of so many characters, and PAD more.
BLOCK, PAD = 16_384, 4_096
#: Pieces of one artifact whose order is worked out together.
INDEX_BLOCK = 256


def inside_word(before: str, after: str) -> bool:
    """Whether a cut between the two characters is between letters or digits."""
    return unicodedata.category(before)[0] in "LN" and unicodedata.category(after)[0] in "LN"


def atoms(text: str, room: int) -> list[tuple[int, int]]:
    """(end, level) of the atoms of text, none longer than room: the level is that of the separator it ends with."""
    points = [[m.end() for m in rx.finditer(text)] for _, rx in SEPARATORS]
    out: list[tuple[int, int]] = []

    def split(lo: int, hi: int, level: int, closing: int) -> None:
        if hi - lo <= room:
            out.append((hi, closing))
            return
        if level == CHARACTER:
            out.extend((at, CHARACTER) for at in range(lo + room, hi, room))
            out.append((hi, closing))
            return
        at = points[level]
        inner = at[bisect_right(at, lo) : bisect_left(at, hi)]
        for a, b in zip([lo, *inner], [*inner, hi], strict=True):
            split(a, b, level + 1, closing if b == hi else level)

    split(0, len(text), 0, 0)
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: none longer than limit, each but the first starting overlap characters before the end
    of the one before. A piece ends inside a word only if no separator ends in the part of it that is new."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if not text:
        return []
    ends = atoms(text, limit - overlap) if len(text) > limit else []
    natural = [e for e, level in ends if level != CHARACTER]
    every = [e for e, _ in ends]
    pieces, start, new = [], 0, overlap  # a piece goes beyond what the next one shares with it
    while len(text) - start > limit:
        at = bisect_right(natural, start + limit) - 1
        end = natural[at] if at >= 0 and natural[at] > new else every[bisect_right(every, start + limit) - 1]
        pieces.append((start, end))
        start, new = end - overlap, end
    return [*pieces, (start, len(text))]


def split_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """artifact_id, chunk_index, start_char, end_char, text: the pieces of docs' (id, text) that are longer than limit.

    Offsets count code points. Null texts, and those that fit the limit, have no pieces. Repeated rows come out as often
    as they stand there. Other columns are ignored; an empty table gives no rows.
    """
    names = ["artifact_id", "chunk_index", "start_char", "end_char", "text"]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(i, k, a, e, text[a:e]) for k, (a, e) in enumerate(split_text(text, limit, overlap))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    rows = docs.filter(F.length("text") > limit).select("id", "text")
    return rows.mapInArrow(run, "artifact_id bigint, chunk_index int, start_char int, end_char int, text string")


def previous_ends(pieces: DataFrame, block: int = INDEX_BLOCK) -> DataFrame:
    """pieces (artifact_id, chunk_index, end_char and others) with prev_end, the end of the artifact's piece with the next
    lower index: in blocks of indexes, so that an artifact's pieces are never one task's."""
    rows = pieces.withColumn("_b", F.floor(F.col("chunk_index") / block))
    last = rows.groupBy("artifact_id", "_b").agg(F.max_by("end_char", "chunk_index").alias("e"))
    w = Window.partitionBy("artifact_id").orderBy("_b")
    before = last.select("artifact_id", "_b", F.lag("e").over(w).alias("_before"))
    inside = F.lag("end_char").over(Window.partitionBy("artifact_id", "_b").orderBy("chunk_index", "chunk_id"))
    return rows.withColumn("_in", inside).join(before, ["artifact_id", "_b"]).withColumn("prev_end", F.coalesce("_in", "_before")).drop("_b", "_in", "_before")


def natural_ends(text: str) -> list[int]:
    """Where the hierarchy, taken down to single characters, finds boundaries in text: ends of sections, paragraphs,
    sentences and words before its end."""
    return [e for e, level in atoms(text, 1) if level != CHARACTER and e < len(text)]


def could_end_naturally(text: str, overlap: int) -> bool:
    """Whether a piece has a natural boundary after a blank, tab or line end behind its first overlap + 1 characters."""
    return any(e > overlap + 1 and text[e - 1] in BLANKS for e in natural_ends(text))


def _beside(known: DataFrame, pieces: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """pieces (key, artifact_id, a, b, size) with here: the characters from a to b, and one more, of whole (artifact_id, text).
    known: a stored table of the same pieces.

    Texts are cut in one go into blocks of BLOCK characters and PAD more. A piece shorter than PAD lies in the block that it
    begins in; a longer one is put together from its parts in all the blocks it meets."""

    def blocks(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [text[k : k + BLOCK + PAD] for k in range(0, len(text), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["artifact_id", "block", "part"])

    cut_up = whole.select("artifact_id", "text").mapInArrow(blocks, "artifact_id bigint, block int, part string")
    at = lambda c: F.least(F.floor(F.col(c) / BLOCK), F.floor((F.col("size") - 1) / BLOCK)).cast("int")
    base = F.col("block") * BLOCK
    short = pieces.filter(F.col("b") - F.col("a") < PAD).withColumn("block", at("a")).join(cut_up, ["artifact_id", "block"])
    found = short.withColumn("here", F.substring("part", F.col("a") - base + 1, F.col("b") - F.col("a") + 1)).drop("part", "a", "b", "block")
    if known.filter(F.col("b") - F.col("a") >= PAD).isEmpty():
        return found
    near = pieces.filter(F.col("b") - F.col("a") >= PAD).withColumn("block", F.explode(F.sequence(at("a"), at("b")))).join(cut_up, ["artifact_id", "block"])
    start = F.greatest(F.col("a") - base, F.lit(0))
    near = near.withColumn("seg", F.substring("part", start + 1, F.least(F.col("b") + 1 - base, F.lit(BLOCK)) - start)).drop("part", "a", "b")
    rest = [c for c in near.columns if c not in (*key, "block", "seg")]
    joined = near.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seg"))), lambda x: x["seg"]), "").alias("here"))
    return found.unionByName(joined)


def audit_pieces(pieces: DataFrame, docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """artifact_id, chunk_index, defect of the stored pieces (chunk_id, artifact_id, chunk_index, start_char, end_char,
    text) of docs (id, text) that split_text could not have made; for the defects see TESTDATA.md, problem 2.

    Pieces of documents that don't exist or have no text are left out, as are pieces with a null among their first five
    columns; a null text differs from every text. Repeated rows count once. Offsets outside the text are cut to it.
    """
    key = ["chunk_id", "artifact_id", "chunk_index", "start_char", "end_char"]
    whole = docs.filter(F.col("id").isNotNull() & (F.length("text") > 0)).select(F.col("id").alias("artifact_id"), "text").dropDuplicates(["artifact_id"])
    rows = pieces.select(*key, "text").dropna(subset=key).dropDuplicates(key)
    narrow = rows.drop("text")
    lengths = whole.select("artifact_id", F.length("text").alias("size"))
    last = narrow.groupBy("artifact_id").agg(F.max("chunk_index").alias("last_index")).join(lengths, "artifact_id")
    known = previous_ends(narrow).join(last, "artifact_id")
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("size"))
    known = known.select(*key, "prev_end", "size", (F.col("chunk_index") == F.col("last_index")).alias("is_last"), inside("start_char").alias("a"), F.greatest(inside("end_char"), inside("start_char")).alias("b"))
    known = cut(known, "known")  # narrow
    facts = _beside(known, known.join(rows, key).withColumn("n", F.col("b") - F.col("a")), whole, key)
    in_word = F.col("end_char") < F.col("size"), F.col("n") > 0, F.substring("here", F.col("n"), F.lit(2)).rlike(r"^[\p{L}\p{N}]{2}$")

    @F.pandas_udf("boolean")
    def broken(cut_in_word: pd.Series, here: pd.Series) -> pd.Series:
        return pd.Series([bool(c) and could_end_naturally(t[:-1], overlap) for c, t in zip(cut_in_word, here, strict=True)])

    expected = F.coalesce(F.col("prev_end") - overlap, F.lit(0))
    defects = {
        "oversize": F.col("end_char") - F.col("start_char") > limit,
        "overlap": F.col("start_char") != expected,
        "broken_word": broken(in_word[0] & in_word[1] & in_word[2], F.when(in_word[0] & in_word[1] & in_word[2], F.col("here"))),
        "text": ~F.substring("here", F.lit(1), F.col("n")).eqNullSafe(F.col("text")),
        "tail": F.col("is_last") & (F.col("end_char") != F.col("size")),
    }
    said = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in defects.items()]))
    return facts.select("artifact_id", "chunk_index", F.explode(said).alias("defect")).distinct()


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "artifacts").select("id", F.col("extracted_text").alias("text"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return audit_pieces(table(spark, sf_dir, "vector_chunks"), _docs(spark, sf_dir))


def p2_pieces(spark, sf_dir: str) -> DataFrame:
    return split_documents(_docs(spark, sf_dir).distinct())


def p2_rebuilt(spark, sf_dir: str) -> DataFrame:
    """What the pieces of each artifact say together: n_chars and digest of the text put together from them again, whether
    all fit the limit, overlap as they should and begin and end with the text."""
    w = Window.partitionBy("artifact_id").orderBy("chunk_index")
    rows = p2_pieces(spark, sf_dir).withColumn("before", F.lag("end_char").over(w))
    fresh = F.substring("text", F.coalesce(F.col("before") - F.col("start_char"), F.lit(0)) + 1, F.lit(LIMIT))
    good = (F.col("end_char") - F.col("start_char") <= LIMIT) & (F.length("text") == F.col("end_char") - F.col("start_char"))
    rows = rows.select("artifact_id", "chunk_index", "end_char", fresh.alias("fresh"), good.alias("fits"), (F.col("start_char") == F.coalesce(F.col("before") - OVERLAP, F.lit(0))).alias("overlaps"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "fresh"))), lambda x: x["fresh"]), "")
    return rows.groupBy("artifact_id").agg(F.max("end_char").cast("bigint").alias("n_chars"), F.md5(text).alias("digest"), F.bool_and("fits").alias("fits"), F.bool_and("overlaps").alias("overlaps"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt}
SQL = {
    "p2_found": r"""
WITH a AS (SELECT DISTINCT id, extracted_text AS t FROM artifacts WHERE extracted_text IS NOT NULL AND extracted_text <> ''),
v AS (SELECT DISTINCT chunk_id, artifact_id, chunk_index, start_char AS s, end_char AS e, text FROM vector_chunks),
j AS (SELECT v.*, t, lag(e) OVER w AS before, row_number() OVER w = count(*) OVER (PARTITION BY artifact_id) AS is_last FROM v JOIN a ON a.id = v.artifact_id WINDOW w AS (PARTITION BY artifact_id ORDER BY chunk_index)),
f AS (
  SELECT artifact_id, chunk_index, CASE WHEN e - s > 500 THEN 'oversize' END AS d FROM j
  UNION ALL SELECT artifact_id, chunk_index, CASE WHEN s <> coalesce(before - 100, 0) THEN 'overlap' END FROM j
  UNION ALL SELECT artifact_id, chunk_index, CASE WHEN e < length(t) AND regexp_matches(substr(t, e, 2), '^[\p{L}\p{N}][\p{L}\p{N}]$') AND regexp_matches(substr(t, s + 102, e - s - 101), '[ \t\n\r\x{85}\x{2028}\x{2029}]') THEN 'broken_word' END FROM j
  UNION ALL SELECT artifact_id, chunk_index, CASE WHEN text IS DISTINCT FROM substr(t, s + 1, e - s) THEN 'text' END FROM j
  UNION ALL SELECT artifact_id, chunk_index, CASE WHEN is_last AND e <> length(t) THEN 'tail' END FROM j
)
SELECT artifact_id, chunk_index, d AS defect FROM f WHERE d IS NOT NULL
""",
    "p2_rebuilt": "SELECT DISTINCT id AS artifact_id, length(extracted_text) AS n_chars, md5(extracted_text) AS digest, true AS fits, true AS overlaps FROM artifacts WHERE length(extracted_text) > 500",
}
