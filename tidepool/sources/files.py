"""Folders of files as a source: scan, text extraction by kind, and the events a scan tells of."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import extension
from tidepool.session import micros

#: File kinds that are read, and their MIME types.
MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}
PICTURES = [".png", ".jpg", ".jpeg"]


def mime_of(path: Column | str) -> Column:
    """The MIME type of a path by its extension; application/octet-stream for other kinds."""
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(known[extension(path)], F.lit("application/octet-stream"))


class OcrEngine:
    """What reads text from a picture's bytes: (text, error). This one reads nothing."""

    def read(self, content: bytes) -> tuple[str, str | None]:
        return "", None


class TesseractOcr(OcrEngine):
    """Pictures read by the tesseract library, where it is installed."""

    def read(self, content: bytes) -> tuple[str, str | None]:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(content))), None


def default_ocr() -> OcrEngine:
    """TesseractOcr where its libraries are installed, else an engine that reads nothing."""
    have = all(importlib.util.find_spec(n) for n in ("pytesseract", "PIL"))
    return TesseractOcr() if have else OcrEngine()


def read_text(content: bytes) -> tuple[str, str | None]:
    """UTF-8, else Latin-1."""
    try:
        return content.decode("utf-8"), None
    except UnicodeDecodeError:
        return content.decode("latin-1"), None


def read_docx(content: bytes) -> tuple[str, str | None]:
    """Paragraphs, a line each."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return "", f"{type(e).__name__}: {e}"
    name = lambda e: e.tag.rpartition("}")[2]
    lines = ["".join(t.text or "" for t in p.iter() if name(t) == "t") for p in root.iter() if name(p) == "p"]
    return "\n".join(lines), None


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|(?<![A-Za-z])(?:Tj|TJ|T\*|Td|TD|ET)(?![A-Za-z])|['\"]", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    """A literal or hexadecimal string of a content stream."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PDF_ESCAPES.get(m[1], m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _pdf_pages(content: bytes) -> list[str]:
    """The text of each page of a file whose pages are plain objects: strings shown, a line for each move to a new one."""
    objects = {m[1]: m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        said = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = ""
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", said[1]) if said else []:
            part = objects.get(ref, b"")
            stream = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", part, re.S)
            if stream:
                raw = zlib.decompressobj().decompress(stream[1]) if b"/FlateDecode" in part else stream[1]
                for m in _PDF_TOKEN.finditer(raw):
                    token = m[0]
                    text += _pdf_string(token) if token[:1] in b"(<" else "\n" if token in (b"T*", b"Td", b"TD", b"ET", b"'", b'"') else ""
        pages.append("\n".join(line for line in (x.strip() for x in text.split("\n")) if line))
    return pages


def read_pdf(content: bytes) -> tuple[str, str | None]:
    """Pages joined by line ends: by a PDF library where one is installed, else what plain content streams show."""
    try:
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            if not content.startswith(b"%PDF"):
                return "", "no PDF file"
            pages = _pdf_pages(content)
            return "\n".join(pages), None if pages else "no page that can be read without a PDF library"
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages), None
    except Exception as e:  # whatever is wrong with a file is that file's error
        return "", f"{type(e).__name__}: {e}"


def extract(ext: str, content: bytes, ocr: OcrEngine) -> tuple[str, str | None]:
    """(text, error) of a file's content; other kinds have an empty text."""
    if ext in (".txt", ".md", ".markdown"):
        return read_text(content)
    if ext == ".docx":
        return read_docx(content)
    if ext == ".pdf":
        return read_pdf(content)
    if ext in PICTURES:
        try:
            return ocr.read(content)
        except Exception as e:  # a file that can't be read doesn't end the scan
            return "", f"{type(e).__name__}: {e}"
    return "", None


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_name, mime_type, size, modified_at, content of the files of known kinds below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.to_timestamp_ntz(F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("modified_at"), "content")
    rows = rows.withColumn("ext", extension("path")).filter(F.col("ext").isin(list(MIME)))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), mime[F.col("ext")].alias("mime_type"), "size", "modified_at", "ext", "content")


def extract_texts(files: DataFrame, ocr: OcrEngine | None = None) -> DataFrame:
    """files without content, with content_hash (SHA-256), extracted_text and extract_error."""
    engine = ocr or default_ocr()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [extract(e, bytes(c), engine) for e, c in zip(pdf["ext"], pdf["content"], strict=True)]
            yield pdf.drop(columns=["content", "ext"]).assign(extracted_text=[t for t, _ in read], extract_error=[e for _, e in read])

    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    kept = [c for c in hashed.columns if c not in ("content", "ext")]
    schema = ", ".join(f"`{c}` {hashed.schema[c].dataType.simpleString()}" for c in kept)
    return hashed.select(*kept, "ext", "content").mapInPandas(run, f"{schema}, extracted_text string, extract_error string")


def folder_events(scan: DataFrame, catalogue: DataFrame, log: DataFrame, folder: str, now_us: int, event_time: str = "scan") -> DataFrame:
    """Events that a scan (path, mime_type, size, modified_at) tells against the catalogue as it was before (id, path, size,
    modified_at, missing) and the log so far (event_type, artifact_id): created or discovered, modified, deleted.

    Files known since before the log get their creation event once; deletions are told once. event_time "mtime" takes the
    files' own times. Ids are hashes of what happened, so the same scan tells the same events.
    """
    inside = catalogue.filter(F.col("path").startswith(folder.rstrip("/") + "/"))
    old = inside.select(F.col("path").alias("_path"), "id", F.col("size").alias("_size"), F.col("modified_at").alias("_at"), F.coalesce("missing", F.lit(False)).alias("_missing"))
    both = scan.select("path", "mime_type", "size", "modified_at").join(old, F.col("path") == F.col("_path"), "full")
    made = log.filter(F.col("event_type").isin("FILE_CREATED", "SCREENSHOT_DISCOVERED") & F.col("artifact_id").isNotNull()).select(F.col("artifact_id").alias("id"), F.lit(True).alias("_made")).distinct()
    gone = log.filter((F.col("event_type") == "FILE_DELETED") & F.col("artifact_id").isNotNull()).select(F.col("artifact_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    rows = both.join(made, "id", "left").join(gone, "id", "left")
    created = F.when(extension("path").isin(PICTURES), "SCREENSHOT_DISCOVERED").otherwise("FILE_CREATED")
    changed = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_at").eqNullSafe(F.col("_at")))
    kind = (
        F.when(F.col("path").isNotNull() & F.col("_path").isNull(), created)
        .when(F.col("path").isNotNull() & changed, "FILE_MODIFIED")
        .when(F.col("path").isNotNull() & F.col("_made").isNull(), created)
        .when(F.col("path").isNull() & ~F.col("_missing") & F.col("_gone").isNull(), "FILE_DELETED")
    )
    at = F.coalesce(micros(F.col("modified_at")), F.lit(now_us)) if event_time == "mtime" else F.lit(now_us)
    where = F.coalesce("path", "_path")
    payload = F.to_json(F.struct(where.alias("path"), "mime_type", "size", F.col("modified_at").cast("string").alias("modified_at")))
    rows = rows.withColumn("event_type", kind).filter("event_type IS NOT NULL").withColumn("us", at)
    ident = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", "event_type", where, F.col("us").cast("string"), F.col("size").cast("string")), 256), 1, 32))
    return rows.select(
        ident.alias("id"), "event_type", "us", F.lit("filesystem").alias("source"), F.lit("filesystem").alias("source_kind"), F.col("id").alias("artifact_id"), where.alias("path"), F.lit(None).cast("string").alias("app"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(1.0).alias("event_confidence"), F.lit(now_us).cast("bigint").alias("recorded_us"), payload.alias("payload"),
    )


#: Event types a simulated feed may have.
EVENT_TYPES = ["FILE_CREATED", "FILE_MODIFIED", "FILE_DELETED", "FILE_OPENED", "FILE_DOWNLOADED", "SCREENSHOT_DISCOVERED", "APPLICATION_ACTIVE"]


def simulated_events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Events from dicts (id, type, timestamp, artifact_id, payload, event_confidence); unknown types, confidences outside
    0..1 and times that are no ISO text raise ValueError. Ids that are missing are random (uuid4)."""
    import json
    import uuid
    from datetime import UTC, datetime

    out = []
    for r in rows:
        if r.get("type") not in EVENT_TYPES:
            raise ValueError(f"no such event type: {r.get('type')}")
        confidence = float(r.get("event_confidence", 1.0))
        if not 0 <= confidence <= 1:
            raise ValueError("event_confidence must be from 0 to 1")
        at = datetime.fromisoformat(r["timestamp"])
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        us = round(at.timestamp() * 1_000_000)
        payload = r.get("payload") or {}
        ident = r.get("id") or str(uuid.uuid4())
        out.append((ident, r["type"], us, r.get("source", "simulated"), "simulated", r.get("artifact_id"), payload.get("path"), payload.get("app") or payload.get("application"), payload.get("tags"), confidence, us, json.dumps(payload)))
    schema = "id string, event_type string, us bigint, source string, source_kind string, artifact_id bigint, path string, app string, tags array<string>, event_confidence double, recorded_us bigint, payload string"
    return spark.createDataFrame(out, schema)


class EventSource(ABC):
    """Something that events come from, as a table of them."""

    name = "events"

    @abstractmethod
    def events(self, spark: SparkSession) -> DataFrame:
        """id, event_type, us, source, source_kind, artifact_id, path, app, tags, event_confidence, recorded_us, payload."""


class SimulatedSource(EventSource):
    """Events given as dicts."""

    name = "simulated"

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def events(self, spark: SparkSession) -> DataFrame:
        return simulated_events(spark, self.rows)


class FolderSource(EventSource):
    """What a scan of a folder tells against a catalogue and a log."""

    name = "filesystem"

    def __init__(self, folder: str, catalogue: DataFrame, log: DataFrame, now_us: int):
        self.folder, self.catalogue, self.log, self.now_us = folder, catalogue, log, now_us

    def events(self, spark: SparkSession) -> DataFrame:
        return folder_events(scan_folder(spark, self.folder).drop("content", "ext"), self.catalogue, self.log, self.folder, self.now_us)


def events_of(spark: SparkSession, sources: list[EventSource]) -> DataFrame:
    """The events of several sources, one an id."""
    rows = sources[0].events(spark)
    for s in sources[1:]:
        rows = rows.unionByName(s.events(spark), allowMissingColumns=True)
    return rows.dropDuplicates(["id"])


def recall_cases(text: str) -> list[dict]:
    """Cases of an evaluation file: the subset of YAML they are written in (a list of mappings of plain or quoted values)."""
    cases: list[dict] = []
    for line in text.splitlines():
        m = re.match(r"\s*(-\s+)?([A-Za-z_]+):\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#") or m[2] == "cases":
            continue
        if m[1]:
            cases.append({})
        if cases:
            value = m[3]
            cases[-1][m[2]] = value[1:-1].replace('\\"', '"').replace("\\\\", "\\") if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return cases
