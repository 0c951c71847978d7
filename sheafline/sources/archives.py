"""Readers of archives, office packages, images and pages: a file is a row, what is inside becomes rows.

Each reader works file by file inside tasks, with limits; a file that cannot be read gives one row with its error.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_PART, MAX_CELLS = 20_000, 64 << 20, 50_000


def _rows(df: DataFrame, columns: tuple[str, str], read: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """name column, the columns of schema and error, for what read yields of each file."""
    name, content = columns
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for frame in frames:
            for key, raw in zip(frame[name], frame[content], strict=True):
                try:
                    found = [(key, *row, None) for row in read(bytes(raw))]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, struct.error, NotImplementedError, RuntimeError) as e:
                    found = [(key, *[None] * len(fields), f"{type(e).__name__}: {e}"[:200])]
                if found:
                    yield pd.DataFrame(found, columns=[name, *fields, "error"]).astype(object)

    return df.select(name, content).filter(F.col(content).isNotNull()).mapInPandas(run, f"{name} string, {schema}, error string")


def _open(raw: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(raw))
    if len(archive.infolist()) > MAX_ENTRIES:
        raise ValueError("too many entries")
    return archive


def zip_entries(df: DataFrame) -> DataFrame:
    """archive, entry, name, size, compressed_size, method, encrypted, error of each entry, without inflating any."""

    def read(raw):
        for at, i in enumerate(_open(raw).infolist()):
            if not i.is_dir():
                yield at, i.orig_filename, i.file_size, i.compress_size, i.compress_type, bool(i.flag_bits & 1)

    return _rows(df, ("archive", "content"), read, "entry int, name string, size long, compressed_size long, method int, encrypted boolean")


def zip_contents(df: DataFrame, prefix: int | None = None, max_entry: int = 256 << 20) -> DataFrame:
    """archive, name, content, error: contents, or their first bytes, of entries within the limit."""

    def read(raw):
        archive = _open(raw)
        for i in archive.infolist():
            if not i.is_dir() and not i.flag_bits & 1 and i.file_size <= max_entry:
                with archive.open(i) as f:
                    yield i.orig_filename, f.read(max_entry if prefix is None else prefix)

    return _rows(df, ("archive", "content"), read, "name string, content_bytes binary").withColumnRenamed("content_bytes", "content")


def _xml(archive: zipfile.ZipFile, part: str):
    with archive.open(part) as f:
        raw = f.read(MAX_PART + 1)
    if len(raw) > MAX_PART:
        raise ValueError(f"{part} is too large")
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.IGNORECASE):
        raise ValueError(f"{part} declares a document type")
    return ElementTree.fromstring(raw)


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _all(node, name: str):
    return (x for x in node.iter() if _local(x) == name)


def _text(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in _all(node, name))


def xlsx_cells(df: DataFrame) -> DataFrame:
    """path, sheet_no, sheet, row, col, kind, raw_str, raw_num, raw_bool, formula, error of each cell, as far as the cap for a workbook."""

    def read(raw):
        archive = _open(raw)
        names = set(archive.namelist())
        book = _xml(archive, "xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in _all(_xml(archive, "xl/_rels/workbook.xml.rels"), "Relationship") if r.get("TargetMode") != "External"}
        strings = [_text(s) for s in _all(_xml(archive, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        left = MAX_CELLS
        for number, sheet in enumerate(_all(book, "sheet"), 1):
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            for c in _all(_xml(archive, part), "c"):
                if left == 0:
                    return
                left -= 1
                letters, row = re.fullmatch(r"([A-Z]{1,3})(\d+)", c.get("r", "")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                value = next((v.text for v in c if _local(v) == "v"), None)
                formula = next((v.text for v in c if _local(v) == "f"), None)
                kind, s, n, b = {"s": "string", "str": "string", "inlineStr": "string", "b": "boolean", "e": "error"}.get(c.get("t"), "number"), None, None, None
                if c.get("t") == "s":
                    s = strings[int(value)]
                elif c.get("t") == "inlineStr":
                    s = _text(c)
                elif kind == "boolean":
                    b = value == "1"
                elif kind == "number":
                    n = None if value is None else float(value)
                else:
                    s = value
                yield number, sheet.get("name"), int(row), col, kind, s, n, b, formula

    return _rows(df, ("path", "content"), read, "sheet_no int, sheet string, row int, col int, kind string, raw_str string, raw_num double, raw_bool boolean, formula string")


def docx_blocks(df: DataFrame) -> DataFrame:
    """path, block, kind, text, error: headings, paragraphs and table rows in order."""

    def read(raw):
        body = next(_all(_xml(_open(raw), "word/document.xml"), "body"))
        at = 0
        for node in body:
            if _local(node) == "p":
                style = next((v for s in _all(node, "pStyle") for v in s.attrib.values()), "")
                heading = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
                if words := _text(node):
                    at += 1
                    yield at, f"heading-{heading[1]}" if heading else "paragraph", words
            elif _local(node) == "tbl":
                for row in _all(node, "tr"):
                    at += 1
                    yield at, "table-row", " | ".join(_text(c) for c in _all(row, "tc"))

    return _rows(df, ("path", "content"), read, "block int, kind string, text string")


def pptx_slides(df: DataFrame) -> DataFrame:
    """path, slide, text, notes, error in the order of the presentation."""

    def read(raw):
        archive = _open(raw)
        names = set(archive.namelist())
        rels = {r.get("Id"): r.get("Target") for r in _all(_xml(archive, "ppt/_rels/presentation.xml.rels"), "Relationship")}
        for at, s in enumerate(_all(_xml(archive, "ppt/presentation.xml"), "sldId"), 1):
            part = "ppt/" + rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))].removeprefix("/ppt/")
            links = part.replace("slides/", "slides/_rels/") + ".rels"
            notes = [r.get("Target") for r in _all(_xml(archive, links), "Relationship") if (r.get("Type") or "").endswith("/notesSlide")] if links in names else []
            words = "\n".join(x for p in _all(_xml(archive, part), "p") if (x := _text(p)))
            yield at, words, "\n".join(_text(p) for n in notes for p in _all(_xml(archive, "ppt/" + n.removeprefix("../")), "p")) or None

    return _rows(df, ("path", "content"), read, "slide int, text string, notes string")


class _Text(HTMLParser):
    BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer pre blockquote".split())
    HIDDEN = frozenset("script style noscript template svg iframe object head".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def visible_text(html: str) -> str:
    """Text without active content; blocks are separated by lines."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(pages: DataFrame) -> DataFrame:
    """page_id and visible text of each page."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else visible_text(t))

    return pages.select("page_id", clean("html").alias("text"))


def active_counts(pages: DataFrame) -> DataFrame:
    """page_id and the numbers of scripts, styles, frames and event attributes."""
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return pages.select("page_id", count("(?i)<script").alias("scripts"), count("(?i)<style").alias("styles"), count("(?i)<iframe").alias("frames"), count("(?i)[ ]on[a-z]+=").alias("events"))
