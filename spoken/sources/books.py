"""FictionBook documents as blocks of speech: one row for each text, emphasis, footnote reference and pause, in reading order.

What an element becomes is told by its name (``ROLES``). A document is one row and read in one piece; documents are read in parallel.
Note texts are a table of their own and joined to the references, which do not repeat them.
"""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settings import DEFAULTS, Settings

NS, XLINK = "http://www.gribuser.ru/xml/fictionbook/2.0", "http://www.w3.org/1999/xlink"
# --- fixed values: roles of the format's elements; seconds of an empty line -------------------------------------------------------------
ROLES = {"subtitle": "heading", "emphasis": "emphasis", "epigraph": "quote", "section": "section", "empty-line": "rest"}
ROLES |= dict.fromkeys("p title cite strong annotation text-author poem stanza v table tr td th".split(), "running")
REST = 0.5
FOREIGN = "tts_en"
BLOCKS = "doc_id string, chapter_idx int, block_idx int, type string, content string, note_id string, title string, duration double"
NOTES = "doc_id string, note_id string, pos int, note_text string"


def _nfc(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "")


def _name(e: ET.Element) -> str:
    """Local name of the format's own elements and of language tags in any namespace; others have none."""
    space, _, local = e.tag.rpartition("}")
    return local if space[1:] == NS or local == FOREIGN else ""


def _is_note(e: ET.Element) -> bool:
    return _name(e) == "a" and e.get("type") == "note"


def _foreign(e: ET.Element) -> list[str]:
    inner = flat_text(e).strip()
    return [f"<{FOREIGN}>{inner}</{FOREIGN}>"] if inner else []


def flat_text(e: ET.Element) -> str:
    """All text below an element, trimmed pieces joined by blanks. Note references go, with what follows them up to the next element."""
    parts = [_nfc(e.text).strip()]
    for c in e:
        if not _is_note(c):
            parts += [*(_foreign(c) if _name(c) == FOREIGN else [flat_text(c)]), _nfc(c.tail).strip()]
    return " ".join(p for p in parts if p.strip())


def _runs(e: ET.Element, known: set[str]) -> Iterator[dict]:
    """Blocks of mixed content: texts as they stand, and references to notes that exist."""
    if _nfc(e.text).strip():
        yield {"type": "text", "content": _nfc(e.text)}
    for c in e:
        if _name(c) == FOREIGN:
            yield from ({"type": "text", "content": x} for x in _foreign(c))
        elif _is_note(c):
            target = c.get(f"{{{XLINK}}}href", "").removeprefix("#")
            if target in known:
                yield {"type": "footnote", "note_id": target, "title": flat_text(c).strip()}
        elif _name(c) == "a":
            if flat_text(c).strip():
                yield {"type": "text", "content": flat_text(c)}
        else:
            yield from _runs(c, known)
        if _nfc(c.tail).strip():
            yield {"type": "text", "content": _nfc(c.tail)}


class _Chapter(list):
    """Blocks of a chapter under way; headings need to know whether anything stands before them."""

    def __init__(self, known: set[str], pause: float):
        super().__init__()
        self.known, self.pause = known, pause

    def rest(self, seconds: float) -> None:
        self.append({"type": "pause", "duration": seconds})

    def heading(self, blocks: list[dict]) -> None:
        """A pause before, unless the chapter begins with it, and half of it after."""
        if self:
            self.rest(self.pause)
        self.extend(blocks)
        if blocks:
            self.rest(self.pause * 0.5)

    def add(self, e: ET.Element) -> None:
        name = _name(e)
        role, text = ROLES.get(name), flat_text(e).strip() if name in ("subtitle", "emphasis", "epigraph") else ""
        if name == FOREIGN:
            self.extend({"type": "text", "content": x} for x in _foreign(e))
            if _nfc(e.tail).strip():
                self.append({"type": "text", "content": _nfc(e.tail)})
        elif role == "heading":
            self.heading([{"type": "text", "content": text}] if text else [])
        elif role in ("emphasis", "quote"):
            if text:
                self.append({"type": "emphasis" if role == "emphasis" else "text", "content": text})
        elif role == "running":
            self.extend(_runs(e, self.known))
        elif role == "rest":
            if self and self[-1]["type"] == "text":
                self.rest(REST)
        elif role == "section":
            title = e.find(f"{{{NS}}}title")
            if title is not None:
                if self:
                    self.rest(self.pause)
                self.add(title)
                self.rest(self.pause * 0.5)
            for c in e:
                if c is not title:
                    self.add(c)


def _bodies(root: ET.Element, notes: bool) -> list[ET.Element]:
    return [b for b in root.findall(f"{{{NS}}}body") if (b.get("name") == "notes") == notes]


def notes_of(root: ET.Element) -> list[tuple[str, str]]:
    """(id, text) of the notes with a text, in order; titles are left out."""
    out = []
    for body in _bodies(root, True):
        for section in body.findall(f"{{{NS}}}section"):
            text = " ".join(t for t in (flat_text(e) for e in section if _name(e) != "title") if t.strip())
            if section.get("id") and text.strip():
                out.append((section.get("id"), text))
    return out


def chapters_of(content: bytes, settings: Settings = DEFAULTS) -> list[list[dict]]:
    """Chapters with their blocks: author, title and annotation of the book, then what stands before the sections of a body, then each
    section; a body without sections is one chapter."""
    root = ET.fromstring(content)
    known = {i for i, _ in notes_of(root)}
    new = lambda: _Chapter(known, settings.pause_between_subsections)
    out: list[list[dict]] = []
    info = root.find(f"{{{NS}}}description/{{{NS}}}title-info")
    if info is not None:
        for name in ("author", "book-title"):
            text = flat_text(e).strip() if (e := info.find(f"{{{NS}}}{name}")) is not None else ""
            if text:
                out.append([{"type": "text", "content": _nfc(text if text.endswith((".", "!", "?", "…")) else text + ".")}])
        if (annotation := info.find(f"{{{NS}}}annotation")) is not None:
            chapter = new()
            chapter.append({"type": "text", "content": settings.annotation_prefix})
            for e in annotation:
                chapter.add(e)
            chapter.append({"type": "text", "content": settings.annotation_suffix})
            out.append(chapter)
    for body in _bodies(root, False):
        sections = body.findall(f"{{{NS}}}section")
        before = list(body)[: list(body).index(sections[0])] if sections else list(body)
        for group in [before, *([s] for s in sections)]:
            chapter = new()
            for e in group:
                chapter.add(e)
            if chapter:
                out.append(chapter)
    return out


def _parsed(files: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for doc, content in zip(batch["path"], batch["content"]):
                try:
                    found = rows(bytes(content)) if content is not None else []
                except (ET.ParseError, RecursionError):
                    found = []
                yield pd.DataFrame([(doc, *r) for r in found], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def book_blocks(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, chapter_idx, block_idx, type, content, note_id, title, duration) of ``files(path, content)``; block_idx counts through a
    chapter. A null file, or one that is no XML, has no blocks; references to notes that do not exist are none."""

    def rows(content: bytes) -> list[tuple]:
        return [(c, i, *(b.get(k) for k in ("type", "content", "note_id", "title", "duration"))) for c, chapter in enumerate(chapters_of(content, settings)) for i, b in enumerate(chapter)]

    return _parsed(files, rows, BLOCKS)


def book_notes(files: DataFrame) -> DataFrame:
    """(doc_id, note_id, pos, note_text) of ``files(path, content)``; of repeated ids, the last pos counts."""
    return _parsed(files, lambda content: [(i, pos, text) for pos, (i, text) in enumerate(notes_of(ET.fromstring(content)))], NOTES)


def normalized_books(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, content): the files with the texts of ``nodes(doc_id, node_idx, text)``, normalized ``text_nodes``, in their places. Language
    tags in texts become elements. A file that is no XML stays as it is."""
    from .fb2 import places_of

    def write(file: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for path, content in zip(file["path"], file["content"]):
            try:
                root = ET.fromstring(bytes(content))
            except ET.ParseError:
                out.append((path, bytes(content)))
                continue
            texts = dict(zip(own["node_idx"], own["text"]))
            for i, (element, kind) in enumerate(places_of(root)):
                if texts.get(i) is not None:
                    setattr(element, kind, texts[i])
            ET.register_namespace("", NS)
            xml = ET.tostring(root, encoding="unicode").replace(f"&lt;{FOREIGN}&gt;", f"<{FOREIGN}>").replace(f"&lt;/{FOREIGN}&gt;", f"</{FOREIGN}>")
            out.append((path, ('<?xml version="1.0" encoding="utf-8"?>\n' + xml).encode()))
        return pd.DataFrame(out, columns=["path", "content"])

    keyed = nodes.select(F.col("doc_id").alias("path"), "node_idx", "text")
    return files.select("path", "content").groupBy("path").cogroup(keyed.groupBy("path")).applyInPandas(write, "path string, content binary")
