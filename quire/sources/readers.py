"""Readers: files, texts, pages, vocabularies; binary formats by pluggable decoders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.layout import file_type

WORD_SCHEMA = (
    "path string, page int, text string, x0 double, top double, x1 double, bottom double, page_width double, page_height double, "
    "font string, font_size double, is_bold boolean, confidence double"
)
#: What CSV files may be encoded in, tried in this order; the last reads anything.
ENCODINGS = ("utf-8", "utf-16", "iso-8859-1")


def list_files(spark: SparkSession, folder: str, extensions: list[str] = ("pdf", "docx", "txt"), recursive: bool = True, limit: int | None = None, content: bool = False) -> DataFrame:
    """(path, length, modificationTime, file_type[, content]) of each file once, by path, at most ``limit`` of them."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e.lower(), e.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    columns = ["path", "length", "modificationTime", *(["content"] if content else [])]
    out = found.select(*columns).withColumn("file_type", file_type(F.col("path")))  # a listing names each file once, so no bytes are shuffled
    return out if limit is None else out.orderBy("path").limit(limit)


def is_pdf(content: Column) -> Column:
    """Whether the bytes begin as a PDF file does."""
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(variant, canon, prio, confidence_threshold) of a JSON file ``{"sections": {name: {"variants": [...], "confidence_threshold": x}}}``."""
    schema = "sections map<string,struct<variants:array<string>,confidence_threshold:double>>"
    held = spark.read.schema(schema).option("multiLine", True).json(path)
    each = held.select(F.posexplode(F.map_entries("sections")).alias("i", "e"))
    return each.select(F.col("i"), F.col("e.key").alias("canon"), F.col("e.value.confidence_threshold").alias("confidence_threshold"), F.posexplode("e.value.variants").alias("j", "variant")).select(
        "variant", "canon", (F.col("i") * 1000 + F.col("j")).cast("int").alias("prio"), "confidence_threshold"
    )


def read_learned(spark: SparkSession, path: str) -> DataFrame:
    """(canon, variant) of JSON lines with ``canonical`` or ``section``, ``header`` or ``text``; malformed lines go."""
    schema = "canonical string, section string, header string, text string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.coalesce("canonical", "section").alias("canon"), F.coalesce("header", "text").alias("variant")).where("canon is not null and variant is not null")


def read_csv(spark: SparkSession, path: str, encodings=ENCODINGS) -> DataFrame:
    """A CSV file with a header in the first of the encodings that it can be decoded in, judged by its bytes on an executor."""

    def decodable(batches):
        import pandas as pd

        for b in batches:
            def fits(raw: bytes) -> str:
                for e in encodings:
                    if e == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                        continue  # without its mark it would take any even number of bytes
                    try:
                        raw.decode(e)
                        return e
                    except UnicodeError:
                        continue
                return "iso-8859-1"
            yield pd.DataFrame({"encoding": [fits(bytes(x)) for x in b["content"]]})

    named = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decodable, "encoding string").first()
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", named["encoding"] if named else "utf-8").csv(path)


def pages_to_lines(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(doc_id, line_no, text, tag) of h1 to h6, p and li elements, by one regular expression."""
    found = F.expr(rf"regexp_extract_all({html}, r'(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)(?=</?(?:h[1-6]|p|li|div|article|footer|ul)\b)', 0)")
    rows = pages.select(F.col(page_id).alias("doc_id"), F.posexplode(found).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "))
    return rows.select("doc_id", "line_no", text.alias("text"), F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("tag")).where("text <> ''")


def decode(
    files: DataFrame, decoder: Callable[[str, bytes], Iterator[tuple]], schema: str = WORD_SCHEMA, fallback: Callable[[str, bytes], Iterator[tuple]] | None = None, status: bool = False
) -> DataFrame:
    """Rows of a decoder for each file (path, content). Where it fails or gives nothing, those of ``fallback``.

    Readers for PDF and images come as such decoders; none is bundled. The first
    column of ``schema`` is the path. With ``status`` there is a last column
    decode_status: ok, fallback, empty (both gave nothing) or what went wrong; files
    without rows then have one of nulls, so none is lost in silence.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def attempt(reader, path: str, content: bytes) -> tuple[list[tuple], str | None]:
        try:
            return list(reader(path, content)), None
        except Exception as e:  # noqa: BLE001 - a decoder may fail in any way on a broken file
            return [], f"{type(e).__name__}: {e}"

    def work(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                found, error = attempt(decoder, path, bytes(content))
                said = "ok"
                if not found and fallback:
                    found, worse = attempt(fallback, path, bytes(content))
                    said, error = "fallback", error if worse is None else f"{error or 'empty'}; {worse}"
                if status:
                    found = [(*r, said) for r in found] or [(path, *[None] * (len(names) - 1), error or "empty")]
                rows += found
            yield pd.DataFrame(rows, columns=[*names, "decode_status"] if status else names)

    return files.select("path", "content").mapInPandas(work, schema + ", decode_status string" if status else schema)


LINE_SCHEMA = "path string, line_no int, text string, style string, bold_ratio double, font_size double, top double"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(path: str, content: bytes) -> Iterator[tuple]:
    """A decoder for ``decode`` with LINE_SCHEMA: paragraphs of a .docx file; blank ones only move the next down, list items get a bullet."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    top, number = 0.0, 0
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style = style.get(f"{_W}val") if style is not None else ""
        listed = p.find(f"{_W}pPr/{_W}numPr") is not None or "list" in style.lower()
        runs, text = list(p.iter(f"{_W}r")), ""
        letters = bold = 0
        sizes = []
        for r in runs:
            own = "".join(t.text or "" if t.tag == f"{_W}t" else " " for t in r if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
            text += own
            letters += len(own)
            mark = r.find(f"{_W}rPr/{_W}b")
            bold += len(own) * (mark is not None and mark.get(f"{_W}val") not in ("0", "false"))
            if (size := r.find(f"{_W}rPr/{_W}sz")) is not None:
                sizes.append(int(size.get(f"{_W}val")) / 2)
        text = " ".join(text.split())
        if not text:
            top += 8
            continue
        yield path, number, ("• " if listed else "") + text, style, bold / letters if letters else 0.0, sum(sizes) / len(sizes) if sizes else 11.0, top
        top += 14
        number += 1
