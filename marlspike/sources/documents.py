"""Text and tables of files (csv, tsv, text, markup, docx, xlsx, pptx, odt, ods) from `binaryFile` rows.

Office files are zip archives of XML, which the standard library reads; PDF and old binary formats are
recognised and reported as unsupported. Files are read in one narrow pass, a file never leaves its task.

Defined cases: an empty file gives empty text; an unknown format and a damaged file give a row with a
warning, never an error; a null content gives a warning; rows beyond `max_rows` of a table are counted
in a warning.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, kind string, bytes bigint, text string, tables string, warnings array<string>"
ZIP_KINDS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
PLAIN = ("txt", "md", "log", "json", "xml", "yaml", "yml", "rst")


def sniff(content: bytes, path: str) -> str:
    """Kind by the first bytes, then by the members of an archive, then by the extension."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "xls" if extension == "xls" else "doc"
    if content[:4] == b"PK\x03\x04":
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return "zip"
        for member, kind in ZIP_KINDS.items():
            if member in names:
                return kind
        return extension if extension in ("odt", "ods") and "content.xml" in names else "zip"
    if extension in ("csv", "tsv"):
        return extension
    if extension in ("html", "htm") or content[:200].lstrip()[:1] == b"<" and b"<html" in content[:2000].lower():
        return "html"
    return "txt" if extension in PLAIN or not extension else extension


def decode_best(content: bytes) -> str:
    for codec in ("utf-8-sig", "gbk"):
        try:
            return content.decode(codec)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element: ElementTree.Element, name: str) -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e) == name)


def _docx(archive: zipfile.ZipFile) -> tuple[str, list]:
    body = ElementTree.fromstring(archive.read("word/document.xml"))
    tables = [[[_texts(c, "t") for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"] for t in body.iter() if _local(t) == "tbl"]
    inside = {p for t in body.iter() if _local(t) == "tbl" for p in t.iter() if _local(p) == "p"}
    return "\n".join(x for p in body.iter() if _local(p) == "p" and p not in inside and (x := _texts(p, "t"))), [{"sheet": "", "rows": t} for t in tables]


def _xlsx(archive: zipfile.ZipFile) -> tuple[str, list]:
    names = archive.namelist()
    shared = [_texts(s, "t") for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name", "") for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(s) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    tables = []
    for number, name in enumerate(sheets):
        rows = []
        for row in ElementTree.fromstring(archive.read(name)).iter():
            if _local(row) == "row":
                cells = []
                for c in row:
                    value = _texts(c, "v") or _texts(c, "t")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                rows.append(cells)
        tables.append({"sheet": titles[number] if number < len(titles) else name, "rows": rows})
    return "\n".join("\t".join(r) for t in tables for r in t["rows"]), tables


def _pptx(archive: zipfile.ZipFile) -> tuple[str, list]:
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return "\n".join(x for n in slides for p in ElementTree.fromstring(archive.read(n)).iter() if _local(p) == "p" and (x := _texts(p, "t"))), []


def _open_document(archive: zipfile.ZipFile) -> tuple[str, list]:
    body = ElementTree.fromstring(archive.read("content.xml"))
    tables = [{"sheet": next((v for k, v in t.attrib.items() if k.endswith("}name")), ""), "rows": [["".join(c.itertext()) for c in r if _local(c) == "table-cell"] for r in t.iter() if _local(r) == "table-row"]} for t in body.iter() if _local(t) == "table"]
    return "\n".join("".join(p.itertext()) for p in body.iter() if _local(p) in ("p", "h")), tables


def _markup(text: str) -> tuple[str, list]:
    clean = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", text)
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split())
    tables = [{"sheet": "", "rows": [[plain(c) for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", t)]} for t in re.findall(r"(?is)<table\b[^>]*>(.*?)</table>", clean)]
    return "\n".join(x for line in re.split(r"(?i)</(?:p|div|h\d|li|tr)>|<br\s*/?>|\n", clean) if (x := plain(line))), tables


def extract(content: bytes | None, path: str, max_rows: int = 2000) -> tuple[str, str, list, list[str]]:
    """(kind, text, tables, warnings) of one file."""
    if content is None:
        return "unknown", "", [], ["no content"]
    kind, warnings = sniff(content, path), []
    try:
        if kind in ("csv", "tsv"):
            text = decode_best(content)
            text, tables = text, [{"sheet": "", "rows": [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t" if kind == "tsv" else ",")]}]
        elif kind == "html":
            text, tables = _markup(decode_best(content))
        elif kind == "txt" or kind in PLAIN:
            text, tables = decode_best(content), []
        elif kind in ("docx", "xlsx", "pptx", "odt", "ods"):
            reader = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}.get(kind, _open_document)
            text, tables = reader(zipfile.ZipFile(io.BytesIO(content)))
        else:
            return kind, "", [], [f"unsupported format: {kind}"]
    except Exception as e:  # a damaged file is a row with a warning
        return kind, "", [], [f"{type(e).__name__}: {e}"[:200]]
    for t in tables:
        if len(t["rows"]) > max_rows:
            warnings.append(f"{len(t['rows']) - max_rows} rows beyond {max_rows} left out")
            t["rows"] = t["rows"][:max_rows]
    return kind, text, tables, warnings


def extract_documents(files: DataFrame, max_rows: int = 2000) -> DataFrame:
    """SCHEMA rows of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                kind, text, tables, warnings = extract(content, path, max_rows)
                out.append((path, kind, len(content or b""), text, json.dumps(tables, ensure_ascii=False), warnings))
            yield pd.DataFrame(out, columns=["path", "kind", "bytes", "text", "tables", "warnings"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_documents(spark: SparkSession, path: str, max_rows: int = 2000) -> DataFrame:
    return extract_documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_rows)
