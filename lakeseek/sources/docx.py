"""Word files (DOCX) to text: paragraphs, white space collapsed, joined by a blank line, as HTML pages are.

A file is a zip whose root relations name the main part; that part is read as a stream, so memory holds the text and not the
document's tree. Only shown text counts: tabs, breaks and hyphens become characters; deleted and moved-away runs, field
codes and the fallback copy of alternative content are left out. A paragraph inside another one (a text box) comes before it.

What isn't accepted comes back with a fault instead of text: ``not a word file`` (no zip, no main part, broken or encrypted data),
``too large unpacked`` (over MAX_UNPACKED bytes, so that a small zip can't fill an executor), ``declares entities`` (a document
type, hence possible entity expansion), ``no text``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAX_UNPACKED = 256 * 1024 * 1024
PIECE = 1 << 16
# Namespaces of the format, transitional and strict.
WORD = {"http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main"}
COMPATIBILITY = "http://schemas.openxmlformats.org/markup-compatibility/2006"
CHARACTERS = {"tab": " ", "br": " ", "cr": " ", "noBreakHyphen": "-"}


NOT_IN_XML = re.compile("[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")


class Refused(Exception):
    """The file gives no text; the message is the fault."""


def _stream(archive: zipfile.ZipFile, name: str, handlers: dict) -> None:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def doctype(*_):
        raise Refused("declares entities")

    parser.StartDoctypeDeclHandler = doctype
    for kind, handler in handlers.items():
        setattr(parser, kind, handler)
    size = 0
    with archive.open(name) as part:
        while piece := part.read(PIECE):
            size += len(piece)
            if size > MAX_UNPACKED:
                raise Refused("too large unpacked")
            parser.Parse(piece, False)
    parser.Parse(b"", True)


def _main_part(archive: zipfile.ZipFile) -> str:
    found = []

    def start(name, attributes):
        if name.endswith(" Relationship") and attributes.get("Type", "").endswith("/officeDocument"):
            found.append(attributes.get("Target", "").lstrip("/"))

    if "_rels/.rels" in archive.namelist():
        _stream(archive, "_rels/.rels", {"StartElementHandler": start})
    return found[0] if found else "word/document.xml"


def paragraphs(content: bytes) -> list[str]:
    """The paragraphs with text, in order."""
    done, open_ones, skipped, shown = [], [], 0, 0

    def start(name, attributes):
        nonlocal skipped, shown
        space, _, local = name.rpartition(" ")
        if (space == COMPATIBILITY and local == "Fallback") or (space in WORD and local == "moveFrom"):
            skipped += 1
        elif space in WORD and not skipped:
            if local == "p":
                open_ones.append([])
            elif local == "t":
                shown += 1
            elif local in CHARACTERS and open_ones:
                open_ones[-1].append(CHARACTERS[local])

    def end(name):
        nonlocal skipped, shown
        space, _, local = name.rpartition(" ")
        if (space == COMPATIBILITY and local == "Fallback") or (space in WORD and local == "moveFrom"):
            skipped -= 1
        elif space in WORD and not skipped:
            if local == "t":
                shown -= 1
            elif local == "p":
                text = " ".join("".join(open_ones.pop()).split())
                if text:
                    done.append(text)

    def data(text):
        if shown and not skipped and open_ones:
            open_ones[-1].append(text)

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            _stream(archive, _main_part(archive), {"StartElementHandler": start, "EndElementHandler": end, "CharacterDataHandler": data})
    except (zipfile.BadZipFile, KeyError, RuntimeError, NotImplementedError, OSError, EOFError, ValueError, zlib.error, expat.ExpatError) as fault:
        raise Refused("not a word file") from fault
    return done


def text_of(content: bytes | None) -> tuple[str | None, str | None]:
    """Text and fault, one of them None; both are None for no content."""
    if content is None:
        return None, None
    try:
        found = paragraphs(bytes(content))
    except Refused as fault:
        return None, str(fault)
    return ("\n\n".join(found), None) if found else (None, "no text")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("fault", T.StringType())]))
def docx_to_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_of(c) for c in content], columns=["text", "fault"])


def packed(parts: list[str]) -> bytes:
    """A Word file with one paragraph per string; characters that XML can't hold become blanks."""
    shown = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(NOT_IN_XML.sub(" ", part))}</w:t></w:r></w:p>' for part in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{min(WORD, key=len)}"><w:body>{shown}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def text_to_docx(text: pd.Series) -> pd.Series:
    """Word files of texts, a paragraph per line; null stays null."""
    return text.map(lambda x: None if x is None else packed(x.split("\n")))
