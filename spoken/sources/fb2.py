"""FictionBook documents: ordered text nodes of each file, in parallel over files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _places(root: ET.Element) -> Iterator[tuple[ET.Element, str, str]]:
    """(element, text or tail, path) of every text that is not blank, in document order: descriptions first, then bodies; text before
    children, tail after."""

    def walk(top: ET.Element, base: str) -> Iterator[tuple[ET.Element, str, str]]:
        todo = [(top, f"{base}/{_local(top)}", False)]
        while todo:
            e, path, leave = todo.pop()
            kind = "tail" if leave else "text"
            if (getattr(e, kind) or "").strip() and not (leave and e is top):
                yield e, kind, path
            if not leave:
                todo.append((e, path, True))
                todo.extend((c, f"{path}/{_local(c)}", False) for c in reversed(e))

    for e in root.iter():
        if _local(e) == "description":
            yield from walk(e, "/FictionBook")
    for e in root.iter():
        if _local(e) == "body":
            yield from walk(e, "/FictionBook/body[notes]" if e.get("name") == "notes" else "/FictionBook/body")


def places_of(root: ET.Element) -> list[tuple[ET.Element, str]]:
    """Where the texts of ``nodes_of`` stand, in the same order."""
    return [(e, kind) for e, kind, _ in _places(root)]


def nodes_of(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, path, text) in document order."""
    return [(kind, path, getattr(e, kind)) for e, kind, path in _places(ET.fromstring(content))]


def text_nodes(files: DataFrame) -> DataFrame:
    """(doc_id, node_idx, kind, path, text) of ``files(path, content)``; a file that is no XML has no nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    found = nodes_of(bytes(content))
                except ET.ParseError:
                    found = []
                rows += [(name, i, *node) for i, node in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "node_idx", "kind", "path", "text"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, node_idx int, kind string, path string, text string")


def read_fb2(spark: SparkSession, path: str) -> DataFrame:
    return text_nodes(spark.read.format("binaryFile").option("pathGlobFilter", "*.fb2").load(path))
