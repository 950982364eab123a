"""Documents from files: text, HTML and office formats, parsed in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParsingError
from ..workers import map_arrow

TEXT, HTML, OFFICE = ("txt", "text", "log", "md", "csv"), ("html", "htm", "xhtml"), ("docx", "xlsx", "pptx")
_DROPPED = {"script", "style", "nav", "footer", "header"}
_BLOCK = set("address article aside blockquote br dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_META = {"description": "description", "keywords": "keywords", "author": "author", "og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "twitter:title": "twitter_title", "twitter:description": "twitter_description"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.h1s, self.meta = [], [], [], {}
        self.links = self.images = 0
        self.language = ""
        self.skipped, self.in_title, self.in_h1, self.in_head = 0, False, False, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROPPED:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag == "html":
            self.language = a.get("lang") or ""
        elif tag == "title":
            self.in_title = not self.title
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "h1":
            self.in_h1 = True
            self.h1s.append([])
        elif tag == "meta":
            name = _META.get(a.get("name") or a.get("property") or "")
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        elif tag == "a" and a.get("href") is not None:
            self.links += 1
        elif tag == "img" and a.get("src") is not None:
            self.images += 1
        if tag in _BLOCK:
            self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "h1":
            self.in_h1 = False
        elif tag == "head":
            self.in_head = False
        if tag in _BLOCK:
            self.text.append(" ")

    def handle_data(self, data):
        if self.skipped:
            return
        if self.in_title:
            self.title.append(data)
        elif not self.in_head:
            self.text.append(data)
            if self.in_h1:
                self.h1s[-1].append(data)


def _squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def parse_html(html: str | None) -> dict:
    """Body text without scripts, styles, navigation, headers and footers, and what the page says of itself."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = _squeezed(page.text)
    return {
        "text": text, "title": _squeezed(page.title) or None, "h1": [_squeezed(h) for h in page.h1s], "links": page.links, "images": page.images, "language": page.language or None,
        "characters": len(text), "words": len(text.split()), "meta": page.meta,
    }


_HTML_FIELDS = pa.schema([("text", pa.string()), ("title", pa.string()), ("h1", pa.list_(pa.string())), ("links", pa.int32()), ("images", pa.int32()), ("language", pa.string()), ("characters", pa.int32()), ("words", pa.int32()), ("meta", pa.map_(pa.string(), pa.string()))])


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, title, h1, links, images, language, characters, words, meta) of every page; null HTML is an empty page."""
    own = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{html_col}`").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_html(h) for h in b.column(1).to_pylist()]
            cols = [pa.array([list(r[f.name].items()) if f.name == "meta" else r[f.name] for r in rows], f.type) for f in _HTML_FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, *_HTML_FIELDS.names])

    return map_arrow(own, run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, text string, title string, h1 array<string>, links int, images int, language string, characters int, words int, meta map<string,string>")


# -- office formats: zip archives of XML --


def _texts(xml: bytes, tag: str) -> list[str]:
    return [e.text or "" for e in ElementTree.fromstring(xml).iter() if e.tag.rsplit("}", 1)[-1] == tag]


def _paragraphs(xml: bytes) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if t.tag.rsplit("}", 1)[-1] == "t") for p in ElementTree.fromstring(xml).iter() if p.tag.rsplit("}", 1)[-1] == "p"]


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def parse_office(data: bytes, kind: str) -> str:
    """Paragraphs of docx; sheets of xlsx, cells by tab; slides of pptx."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if kind == "docx":
                return "\n".join(_paragraphs(z.read("word/document.xml")))
            if kind == "pptx":
                slides = _numbered(names, r"ppt/slides/slide(\d+)\.xml")
                return "\n".join(f"Slide {k}:\n" + "\n".join(p for p in _paragraphs(z.read(n)) if p) for k, n in enumerate(slides, 1))
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(_texts(ElementTree.tostring(si), "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si") or si.tag == "si"]
            titles = re.findall(r'<(?:\w+:)?sheet [^>]*?name="([^"]*)"', z.read("xl/workbook.xml").decode("utf-8", "replace"))
            out = []
            for k, n in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
                out.append(f"Sheet: {titles[k] if k < len(titles) else k + 1}")
                for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.rsplit("}", 1)[-1] == "row"):
                    cells = []
                    for c in row:
                        v = next((x.text or "" for x in c.iter() if x.tag.rsplit("}", 1)[-1] in ("v", "t")), "")
                        cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                    out.append("\t".join(cells))
            return "\n".join(out)
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ParsingError(f"not a {kind} file: {e}") from e


def office_properties(data: bytes) -> dict[str, str]:
    """Title, author and the like, from the archive's core properties; empty where there are none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return {}
    return {e.tag.rsplit("}", 1)[-1]: e.text for e in root if e.text}


def parse_pdf(data: bytes) -> tuple[str, dict[str, str]]:
    """Text of a PDF, number of pages and what it says about itself, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ParsingError("reading PDF needs the pypdf package") from e
    reader = PdfReader(io.BytesIO(data))
    about = {str(k).lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items() if v}
    return "\n".join(p.extract_text() or "" for p in reader.pages), {"pages": str(len(reader.pages)), **about}


def text_figures(text: str) -> dict[str, str]:
    """Characters, words and lines; 0 lines for the empty text."""
    return {"characters": str(len(text)), "words": str(len(text.split())), "lines": str(text.count("\n") + 1 if text else 0)}


def parse_file(name: str, data: bytes) -> tuple[str, dict[str, str]]:
    """Text of a file, by its extension, and what the parser knows about it."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in TEXT:
        text, about = data.decode("utf-8", "replace"), {}
    elif kind in HTML:
        page = parse_html(data.decode("utf-8", "replace"))
        text = page["text"]
        about = {**page["meta"], **{n: str(page[n]) for n in ("title", "links", "images", "language") if page[n] is not None}}
    elif kind in OFFICE:
        text, about = parse_office(data, kind), office_properties(data)
    elif kind == "pdf":
        text, about = parse_pdf(data)
    else:
        raise ParsingError(f"no parser for .{kind}")
    return text, {**about, **text_figures(text), "type": kind}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, bytes, text, metadata, error) of all files under ``path``; metadata is a map of strings. A file that can't be parsed
    has its error, no text and no metadata; the others go on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, abouts, errors = [], [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                try:
                    text, about = parse_file(name, data)
                    texts.append(text), abouts.append(list(about.items())), errors.append(None)
                except ParsingError as e:
                    texts.append(None), abouts.append(None), errors.append(str(e))
            kinds = pa.string(), pa.map_(pa.string(), pa.string()), pa.string()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip((texts, abouts, errors), kinds)]], ["path", "bytes", "text", "metadata", "error"])

    parsed = map_arrow(files, run, "path string, bytes bigint, text string, metadata map<string,string>, error string")
    return parsed.select(F.md5("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "bytes", "text", "metadata", "error")
