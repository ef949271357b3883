"""Text of HTML and of Word documents, with the standard library."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _TextNodes(HTMLParser):
    """All text nodes but those of scripts, styles and templates; no comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden = ""
        self.joined = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.joined = False
        if tag in ("script", "style", "template") and not self.hidden:
            self.hidden = tag

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        if tag == self.hidden:
            self.hidden = ""

    def handle_comment(self, data: str) -> None:
        self.joined = False

    def handle_decl(self, decl: str) -> None:
        self.joined = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.joined:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.joined = True


def html_to_text(html: str | None) -> str | None:
    """Text nodes joined by line ends, not stripped."""
    if html is None:
        return None
    p = _TextNodes()
    p.feed(html)
    p.close()
    return "\n".join(p.nodes)


def html_text(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(html_to_text)

    return convert(html)


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_to_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, of headers, then of the body, then cells of tables, then of footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(z.namelist())
        part = lambda n: ElementTree.fromstring(z.read(n))
        direct = lambda root: [t for p in root.findall(_W + "p") if (t := _paragraph(p)).strip()]
        headers = [t for n in names if n.startswith("word/header") for t in direct(part(n))]
        footers = [t for n in names if n.startswith("word/footer") for t in direct(part(n))]
        body = part("word/document.xml").find(_W + "body")
        cells = []
        for table in body.findall(_W + "tbl"):
            for cell in table.iter(_W + "tc"):
                text = "\n".join(_paragraph(p) for p in cell.findall(_W + "p")).strip()
                if text:
                    cells.append(text)
        return "\n".join([*headers, *direct(body), *cells, *footers])
