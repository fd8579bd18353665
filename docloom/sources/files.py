"""Files of mixed formats as text sections.

Spark lists and reads the files (``binaryFile``); a format's reader is a short function on
one file's bytes. A file that cannot be read gives a row with an error and never fails the job.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.tables import IMAGES, READERS

SCHEMA = "path string, filename string, sha256 string, section int, page_number int, text string, metadata string, error string"

#: Page number, text and, where there is any, metadata.
Section = tuple[int | None, str] | tuple[int | None, str, dict[str, str]]


def decode(raw: bytes) -> str:
    """UTF-8 with or without mark, else GB18030, else UTF-8 with replacement characters."""
    for code in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.parts = 0, []
        self.titled, self.title = False, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")
        self.titled = tag == "title"

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style", "noscript")))
        self.titled = self.titled and tag != "title"

    def handle_data(self, data):
        if self.titled:
            self.title.append(data.strip())
        elif not self.skip and data.strip():
            self.parts.append(data.strip())


def _html(raw: bytes) -> list[Section]:
    parser = _Text()
    parser.feed(decode(raw))
    title = " ".join(filter(None, parser.title))
    return [(None, "\n".join(parser.parts), {"title": title} if title else {})]


def _csv(raw: bytes) -> list[Section]:
    return [(None, "\n".join(" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(decode(raw)))))]


def _json(raw: bytes) -> list[Section]:
    return [(None, json.dumps(json.loads(decode(raw)), ensure_ascii=False, indent=2))]


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _runs(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def _docx(raw: bytes) -> list[Section]:
    """Paragraphs, then the tables with a heading each."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))[0]
    lines = [t for e in body if _tag(e) == "p" and (t := _runs(e).strip())]
    for i, table in enumerate((e for e in body if _tag(e) == "tbl"), 1):
        lines.append(f"表格 {i}")
        for row in (e for e in table if _tag(e) == "tr"):
            lines.append(" | ".join(_runs(c).strip() for c in row if _tag(c) == "tc"))
    return [(None, "\n".join(lines))]


def _pptx(raw: bytes) -> list[Section]:
    """One section per slide."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [(i, "\n".join(t for e in ElementTree.fromstring(z.read(n)).iter() if _tag(e) == "p" and (t := _runs(e).strip()))) for i, n in slides]


def _xlsx(raw: bytes) -> list[Section]:
    """One section per sheet; rows without a value are dropped."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [_runs(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        lines = []
        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                value = next((v.text or "" for v in c if _tag(v) == "v"), _runs(c))
                cells[column or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" and value else value
            if any(v.strip() for v in cells.values()):
                lines.append(" | ".join(cells.get(i, "") for i in range(1, max(cells) + 1)))
        out.append((None, "\n".join(lines)))
    return out


def _text(raw: bytes) -> list[Section]:
    return [(None, decode(raw))]


_BY_READER = {"text": _text, "csv": _csv, "json": _json, "html": _html, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def sections(filename: str, raw: bytes, page_reader=None) -> list[Section]:
    """The non-blank sections of a file; PDF and images need a ``page_reader`` (bytes -> sections)."""
    ext = filename.rpartition(".")[2].lower()
    kind = "image" if ext in IMAGES else READERS.get(ext)
    if kind is None:
        raise ValueError(f"unsupported file type: {ext}")
    if kind not in _BY_READER and page_reader is None:
        raise ValueError(f"no reader for {ext} was given")
    return [s for s in (_BY_READER.get(kind) or page_reader)(raw) if s[1].strip()]


def read_sections(spark: SparkSession, path: str, max_bytes: int = 50 << 20, page_reader=None) -> DataFrame:
    """path, filename, sha256, section (from 0), page_number, text, metadata (JSON), error of every file below ``path``.

    Files over ``max_bytes`` have one row with an error and no hash; only their size is looked at, the
    scan leaves their content unread. An unreadable file has one row with an error of 1000
    characters at most; one without text has none.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    data = found.where(F.col("length") <= max_bytes).select("path", F.sha2("content", 256).alias("sha256"), "content")
    name, none = F.regexp_extract("path", "([^/]*)$", 1), F.lit(None)
    large = found.where(F.col("length") > max_bytes).select(
        "path", name.alias("filename"), none.cast("string").alias("sha256"), none.cast("int").alias("section"), none.cast("int").alias("page_number"),
        none.cast("string").alias("text"), none.cast("string").alias("metadata"), F.lit("ValueError: file too large").alias("error"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, digest, raw in batch.itertuples(index=False):
                name = where.rpartition("/")[2]
                try:
                    for i, (page, text, *more) in enumerate(sections(name, raw, page_reader)):
                        rows.append((where, name, digest, i, page, text, json.dumps(more[0] if more else {}, ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
                    rows.append((where, name, digest, None, None, None, None, f"{type(e).__name__}: {e}"[:1000]))
            if rows:
                out = pd.DataFrame(rows, columns=["path", "filename", "sha256", "section", "page_number", "text", "metadata", "error"])
                yield out.astype({"section": "Int32", "page_number": "Int32"})

    return data.mapInPandas(run, SCHEMA).unionByName(large)


def recognised(targets: DataFrame, recognise) -> DataFrame:
    """Page images with their text: ``recognise`` (bytes -> text) runs for each target by itself.

    targets: path, page_number, content, fallback. A failure or an empty answer leaves the
    fallback text and a warning, and touches no other target.
    """

    @F.pandas_udf("struct<text:string,warning:string>")
    def read(content: pd.Series) -> pd.DataFrame:
        out = []
        for raw in content:
            try:
                text = recognise(raw)
                out.append((text, None) if text and text.strip() else (None, "empty answer"))
            except Exception as e:  # noqa: BLE001
                out.append((None, str(e)[:1000] or type(e).__name__))
        return pd.DataFrame(out, columns=["text", "warning"])

    rows = targets.withColumn("_r", read("content"))
    return rows.select("path", "page_number", F.coalesce("_r.text", "fallback").alias("text"), "_r.warning")
