"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts are cut into overlapping chunks that are pre-tokenised in parallel; neighbours are stitched at a pre-token boundary
that both found (what a pre-tokeniser does from a boundary on depends on nothing before it), and the pieces between
stitches are encoded and put together again. A text's chunks stay in the task that reads it, without a shuffle; those of
very long texts are spread over tasks. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import cut, table

#: Fixed value: the pattern that splits text before the merges of the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in chunks of so many characters and so many more on both sides.
CHUNK_CHARS = 4_096
OVERLAP_CHARS = 256
#: The chunks of texts longer than this are worked on by several tasks.
SPREAD_CHARS = 4_194_304
_loaded: dict[str, object] = {}


def default_vocabulary() -> str:
    """The file of byte_bpe_50k: where the package of public tokenizers is installed, else in TOKENIZER_DIR or /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def encoding(vocabulary: str):
    """The tokenizer of a rank file, loaded once a process; it has no special tokens."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def boundaries(text: str) -> list[int]:
    """Ends of pre-tokens that can be stitches: not after white space, whose split depends on what follows, and not the
    last, which the end of the text may have cut short."""
    import regex

    if "pattern" not in _loaded:
        _loaded["pattern"] = regex.compile(SPLIT_PATTERN)
    ends = [m.end() for m in _loaded["pattern"].finditer(text)]
    return [e for e in ends[:-1] if not text[e - 1].isspace()]


def chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of the chunks of a text: size new characters each, and overlap more on both sides."""
    return [(max(0, at - overlap), text[max(0, at - overlap) : at + size + overlap]) for at in range(0, len(text), size)]


def meeting_ends(base: int, chunk: str, overlap: int) -> tuple[list[int], list[int]]:
    """The pre-token ends of a chunk, as places in the text, in what it shares with the chunk before and with the next."""
    at = boundaries(chunk)
    return [base + e for e in at if e <= 2 * overlap], [base + e for e in at if e >= len(chunk) - 2 * overlap]


def encode_chunked(text: str, vocabulary: str, size: int, overlap: int) -> list[int]:
    """The ids of a text by its chunks: neighbours are stitched at the first end both found, and the pieces between
    stitches encoded. Where two neighbours have no end in common, the text is encoded in one piece."""
    encode = encoding(vocabulary).encode_ordinary
    chunks = chunks_of(text, size, overlap)
    if len(chunks) < 2:
        return encode(text)
    ends = [meeting_ends(base, chunk, overlap) for base, chunk in chunks]
    stitches = [min(set(left) & set(right), default=None) for (_, right), (left, _) in zip(ends, ends[1:], strict=False)]
    if None in stitches:
        return encode(text)
    return [i for a, b in zip([0, *stitches], [*stitches, len(text)], strict=True) for i in encode(text[a:b])]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """<id_col>, ids (array<int>) of every row of docs. Null and empty texts have no ids: an empty list. Repeated rows
    come out as often as they stand there if their texts are no longer than spread_chars; the chunks of longer ones are
    worked on by different tasks, and these texts need unique ids. Strings that look like control tokens are ordinary text.
    Other columns are ignored, whatever their names."""
    if overlap * 2 > chunk_chars:
        raise ValueError("chunks must be at least twice as long as their overlap")
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                ids = [encode_chunked(t, vocabulary, chunk_chars, overlap) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    out = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>"
    short = rows.filter(size <= spread_chars).mapInArrow(whole, out)
    long = _encode_spread(cut(rows.filter(size > spread_chars), "long"), vocabulary, chunk_chars, overlap, whole, out)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def _encode_spread(rows: DataFrame, vocabulary: str, size: int, overlap: int, whole, out: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def chunks(batches):
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = chunks_of(text, size, overlap)
                for at in range(0, len(parts), 1024):
                    some = parts[at : at + 1024]
                    columns = [[i] * len(some), range(at, at + len(some)), [len(parts) - 1] * len(some), *zip(*some, strict=True)]
                    types = [b.schema.types[0], pa.int32(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["id", "k", "last", "base", "chunk"])

    def ends(batches):
        for b in batches:
            met = [meeting_ends(base, chunk, overlap) for base, chunk in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            lists = [pa.array([m[side] for m in met], pa.list_(pa.int64())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], names=["id", "k", "last", "left", "right"])

    parts = cut(rows.mapInArrow(chunks, f"id {kind}, k int, last int, base bigint, chunk string").repartition("id", "k"), "chunks")
    found = parts.mapInArrow(ends, f"id {kind}, k int, last int, left array<bigint>, right array<bigint>")
    before = found.select("id", (F.col("k") + 1).alias("k"), F.col("right").alias("seen"))
    stitch = found.join(before, ["id", "k"], "left").withColumn("at", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("left", "seen"))))
    w = Window.partitionBy("id").orderBy("k")
    stitch = stitch.select("id", "k", "at", F.lead("at").over(w).alias("until"), F.max(F.col("at").isNull()).over(Window.partitionBy("id")).alias("apart"))

    def pieces(batches):
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            ids = []
            for base, chunk, at, until in zip(*(b.column(c).to_pylist() for c in ("base", "chunk", "at", "until")), strict=True):
                ids.append(encode(chunk[at - base : None if until is None else until - base]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "k", "ids"])

    whole_again = rows.join(stitch.filter("apart").select("id").distinct(), "id", "left_semi").mapInArrow(whole, out)
    pieces_ = parts.join(stitch.filter("NOT apart").drop("apart"), ["id", "k"]).select("id", "k", "base", "chunk", "at", "until").mapInArrow(pieces, f"id {kind}, k int, ids array<int>")
    joined = pieces_.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return joined.unionByName(whole_again)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """<id_col>, text: the tokens' bytes put together. Null or empty ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        decode = encoding(vocabulary).decode_bytes
        for b in batches:
            text = [decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """docs' other columns and n_tokens (bigint, 0 for null and empty texts), without the text itself."""
    vocabulary = vocabulary or default_vocabulary()
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*kept, text_col)

    def run(batches):
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                n = [len(encode(t)) if t else 0 for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
