"""Corpus files in, index tables and reports out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import status_report, summary_text

# fixed values: the extensions of a corpus, and their kinds
TEXT = [".md", ".markdown", ".txt"]
EXTENSIONS = [*TEXT, ".docx", ".doc", ".pdf"]
MIME = {".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
LEAST_PDF_CHARS = 50


def _glob(name_contains: str | None = None) -> str:
    """A pattern over names that the file source tries before it opens a file: the extensions in any case, and what a stem must hold."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:])
    stem = "*"
    # a part of a name that may reach into the extension isn't looked for here
    if name_contains and "." not in name_contains and not any(name_contains.lower() in e for e in EXTENSIONS):
        stem = "*" + re.sub(r"([*?\[\]{}\\,])", r"\\\1", name_contains) + "*"
    return stem + ".{" + ",".join(map(either, EXTENSIONS)) + "}"


def listed_files(reader, path: str, name_contains: str | None = None):
    """The binary files under path of a batch or stream reader; those of other extensions are never opened."""
    return reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(name_contains)).load(path)


def read_corpus(spark: SparkSession, path: str, name_contains: str | None = None) -> DataFrame:
    """Files under path by extension: rel_path, name, extension, size_bytes, content, in no order. Hidden folders and caches are left out.

    Names are filtered in the listing, so that only files that are kept are read.
    """
    files = listed_files(spark.read, path, name_contains)
    return with_names(files, path_root(path), name_contains).select("rel_path", "name", "extension", "size_bytes", "content")


#: Paths that one read takes.
BLOCK = 10_000


def _literal(paths: list[str]) -> list[str]:
    """Paths as patterns that match themselves alone."""
    return [re.sub(r"([*?\[\]{}\\,])", r"\\\1", p) for p in paths]


def files_at(spark: SparkSession, paths: list[str], root: Column) -> DataFrame:
    """The binary files at paths, as the source gave them, with their names."""
    some = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(paths[a : a + BLOCK])) for a in range(0, len(paths), BLOCK)]
    return with_names(reduce(DataFrame.unionByName, some), root)


def lines_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, n, line): the lines of the text files at paths, in the order of start and n. A file is read in parts, and never held whole."""
    some = [spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(_literal(paths[a : a + BLOCK])).select("_metadata.file_path", "_metadata.file_block_start", "value") for a in range(0, len(paths), BLOCK)]
    path = F.when(F.contains("file_path", F.lit("%")), F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))).otherwise(F.col("file_path"))
    return reduce(DataFrame.unionAll, some).select(path.alias("path"), F.col("file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def path_root(path: str) -> Column:
    return F.lit(path.rstrip("/").split("://")[-1].lstrip("/") + "/")


def with_names(files: DataFrame, root: Column, name_contains: str | None = None) -> DataFrame:
    """Binary files with rel_path, name, extension and size_bytes; hidden ones and other kinds are left out."""
    full = F.url_decode(F.replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), F.lit("+"), F.lit("%2B")))
    rel = F.substring(full, F.instr(full, root) + F.char_length(root), F.char_length(full))
    out = files.withColumn("rel_path", rel).withColumn("name", F.element_at(F.split("rel_path", "/"), -1))
    out = out.withColumn("extension", F.lower(F.regexp_extract("name", r"(?<=.)(\.[^.]+)$", 1)))
    hidden = F.exists(F.split("rel_path", "/"), lambda p: p.startswith(".") | (p == "__pycache__"))
    out = out.where(F.col("extension").isin(EXTENSIONS) & ~hidden)
    if name_contains:
        out = out.where(F.contains("name", F.lit(name_contains)))
    return out.withColumnsRenamed({"length": "size_bytes", "modificationTime": "modified"})


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(node) -> str:
    return "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" for t in node.iter() if t.tag in (_W + "t", _W + "tab", _W + "br"))


def _body(stream, clean: Callable[[str], str]) -> Iterator[str]:
    """Paragraphs and tables of a body, header or footer in their order; a table's rows are lines of cells.

    The XML is read piece by piece: a paragraph or a row is dropped once its text was taken, so that memory holds the texts and one of these.
    """
    path: list = []
    rows: list[str] = []
    outer = {_W + n for n in ("body", "hdr", "ftr")}
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(node)
            continue
        path.pop()
        up = path[-1].tag if path else None
        if node.tag == _W + "tr" and up == _W + "tbl" and len(path) > 1 and path[-2].tag in outer:
            cells = [" ".join(filter(None, (clean(_paragraph(p)) for p in cell.iter(_W + "p")))) for cell in node.findall(_W + "tc")]
            rows += [" | ".join(cells)] if any(cells) else []
        elif up in outer and node.tag == _W + "p":
            if text := clean(_paragraph(node)):
                yield text
        elif up in outer and node.tag == _W + "tbl":
            if rows:
                yield "\n".join(rows)
            rows = []
        elif up not in outer:
            continue
        del path[-1][:]


def docx_text(content: bytes, clean: Callable[[str], str] = str.strip) -> str:
    """Headers and footers once each, then the body; parts are parted by blank lines. Each paragraph goes through `clean`, and is left out if nothing remains."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts: list[str] = []
        for kind, mark in (("header", "[HEADER] "), ("footer", "[FOOTER] ")):
            for name in sorted(n for n in z.namelist() if n.startswith(f"word/{kind}") and n.endswith(".xml")):
                with z.open(name) as stream:
                    text = " ".join(_body(stream, clean))
                if text and mark + text not in parts:
                    parts.append(mark + text)
        with z.open("word/document.xml") as stream:
            return "\n\n".join([*parts, *_body(stream, clean)])


#: Bytes of files that are read at a time.
AT_ONCE = 8 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a binary or text column holds `most` bytes at most, but one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


LOADED = "text string, status string, mime_type string, error_message string, extractor string"


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files with text, status (ok, empty, error, needs_ocr, needs_doc_conversion), mime_type, error_message and extractor.

    Text kinds are decoded by a column expression. Word files are read by a batched helper, and so are kinds that `extractors` (by extension)
    add; without one a .pdf needs OCR and a .doc needs conversion. An error becomes a status, want of memory fails the task.
    """
    own = {".docx": docx_text} | (extractors or {})
    plain = files.where(F.col("extension").isin(TEXT))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    blank = ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    mime = F.coalesce(*[F.when(F.col("extension") == e, F.lit(m)) for e, m in MIME.items()], F.lit("application/octet-stream"))
    names = [c for c in files.columns if c != "content"]
    status = F.when(blank, "empty").otherwise("ok")
    done = plain.select(*names, text.alias("text"), status.alias("status"), mime.alias("mime_type"), F.lit(None).cast("string").alias("error_message"), F.lit("text").alias("extractor"))

    def run(batches):
        for batch in by_bytes(batches, "content"):
            rows = []
            for ext, content in zip(batch.column("extension").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows.append(_load(ext, content, own))
            cols = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + cols, names=[*names, "text", "status", "mime_type", "error_message", "extractor"])

    other = files.where(~F.col("extension").isin(TEXT))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content") + ", " + LOADED
    return done.unionByName(other.select(*names, "content").mapInArrow(run, schema))


def _load(ext: str, content: bytes, extractors: dict[str, Callable[[bytes], str]]) -> tuple:
    mime = MIME.get(ext, "application/octet-stream")
    if ext not in EXTENSIONS:
        return "", "error", mime, f"unsupported extension {ext}", None
    if ext == ".docx" and not zipfile.is_zipfile(io.BytesIO(content)):
        return "", "needs_doc_conversion", mime, "not a zip archive", None
    if ext not in extractors:
        return ("", "needs_ocr", mime, "no text layer", None) if ext == ".pdf" else ("", "needs_doc_conversion", mime, "no converter", None)
    try:
        text = extractors[ext](content)
    except MemoryError:
        raise  # the next attempt may have it
    except Exception as e:  # noqa: BLE001  a file that can't be read is an outcome, not a failed job
        return "", "error", mime, str(e)[:500], ext[1:]
    if ext == ".pdf" and len(text.strip()) < LEAST_PDF_CHARS:
        return text, "needs_ocr", mime, "too little text", ext[1:]
    return text, "ok" if text.strip() else "empty", mime, None, ext[1:]


def write_index(df: DataFrame, path: str, by: str = "category") -> None:
    """Replaces the partitions that df has rows of and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_status_report(documents: DataFrame, path: str) -> None:
    """A JSON line for each file under path/files, and the counts as text under path/summary."""
    documents.select("document_id", "title", "category", "status", "error_message").write.mode("overwrite").json(f"{path}/files")
    summary_text(status_report(documents)).write.mode("overwrite").text(f"{path}/summary")
