"""Documents from HTML and EPUB."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCKS = ("p", "div", "h1", "h2", "h3")


class Elements(HTMLParser):
    """Blocks and images in document order; a nested block's text is part of its outer blocks' too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[int] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        if tag == "img":
            self.found.append(["img", [], dict(attrs).get("src") or ""])
        elif tag in BLOCKS:
            if tag == "p":  # a paragraph ends the one before
                self.open = [i for i in self.open if self.found[i][0] != "p"]
            self.open.append(len(self.found))
            self.found.append([tag, [], ""])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        for i in reversed(self.open):
            if self.found[i][0] == tag:
                self.open.remove(i)
                break

    def handle_data(self, data):
        if not self.mute:
            for i in self.open:
                self.found[i][1].append(data)


def elements(html: str) -> list[tuple[int, str, str, str]]:
    """(place, tag, text, src) of blocks with text and images with a source."""
    parser = Elements()
    parser.feed(html or "")
    rows = [(tag, " ".join("".join(t).split()), src) for tag, t, src in parser.found]
    return [(i, *r) for i, r in enumerate(r for r in rows if r[1] or r[2])]


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, tag, text, src) of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = [key, "place", "tag", "text", "src"], []
        for b in batches:
            for k, h in zip(b[key], b[html]):
                rows += [(k, *e) for e in elements(h)]
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, place long, tag string, text string, src string")


def image_path(src: Column, known: Column) -> Column:
    """The web path of the first known image (array of package_path, web_path) that ends with the source or is its end; else /diagrams/<file name>."""
    fits = F.filter(known, lambda m: F.endswith(src, m["package_path"]) | F.endswith(m["package_path"], src))
    return F.when(F.size(fits) > 0, fits[0]["web_path"]).otherwise(F.concat(F.lit("/diagrams/"), F.element_at(F.split(src, "/"), -1)))


BROKEN = (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError)


def _package(z: zipfile.ZipFile) -> tuple[ElementTree.Element, str]:
    """The package document and its folder."""
    root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    return ElementTree.fromstring(z.read(root)), posixpath.dirname(root)


def chapters(book: bytes, path: str = "") -> list[tuple[int, str, str, str]]:
    """(chapter, title, author, html) of an EPUB in the order of its spine. Defaults: the path's stem and Unknown."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        package, at = _package(z)
        title = package.findtext(".//{*}title") or posixpath.splitext(posixpath.basename(path))[0] or "Unknown"
        author = package.findtext(".//{*}creator") or "Unknown"
        files = {i.get("id"): i.get("href") for i in package.iterfind(".//{*}item")}
        spine = [files[i.get("idref")] for i in package.iterfind(".//{*}itemref") if i.get("idref") in files]
        return [(n, title, author, z.read(posixpath.join(at, f)).decode("utf-8", "replace")) for n, f in enumerate(spine)]


def images(book: bytes) -> list[tuple[str, bytes]]:
    """(path in the package, content) of an EPUB's images."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        package, at = _package(z)
        listed = [i.get("href") for i in package.iterfind(".//{*}item") if (i.get("media-type") or "").startswith("image/")]
        return [(f, z.read(posixpath.join(at, f))) for f in listed]


def epub_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of the EPUB files of ``path``, but for those named ``._*``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", recursive).load(path)
    return files.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("._"))).select("path", "content")


def read_epub(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(book, chapter, title, author, html) of the EPUB files of ``path``; a broken file gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    rows = chapters(content, name)
                except BROKEN:
                    continue
                yield pd.DataFrame([(name, *r) for r in rows], columns=["book", "chapter", "title", "author", "html"])

    return epub_files(spark, path, recursive).mapInPandas(run, "book string, chapter long, title string, author string, html string")
