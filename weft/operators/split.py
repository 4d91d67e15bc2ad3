"""Splitting of documents into chunks: by characters, and by Markdown headings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 500, 50
Piece = tuple[str, list[str], str, int]  # content, section path, heading, heading level


def char_windows(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows of a trimmed text, offsets in characters.

    A rest that fits into the size and a fifth more is taken whole. Otherwise a window ends at the
    last blank line within that reach, else at the last space within the size, else at the size.
    The next one starts overlap characters before, but at least one after the last start.
    """
    text = text.strip()
    size = size if size > 0 else MAX_CHARS
    overlap = size // 2 if overlap >= size else max(0, overlap)
    out, start = [], 0
    while start < len(text):
        reach = start + size + size // 5
        if len(text) <= reach:
            out.append(text[start:].strip())
            break
        blank = text.rfind("\n\n", start, reach)
        space = text.rfind(" ", start + 1, start + size)
        end = blank if blank >= 0 else space if space > 0 else start + size
        out.append(text[start:end].strip())
        start = max(end + 2 * (blank >= 0) - overlap, start + 1)
    return [piece for piece in out if piece]


def headings(text: str) -> list[tuple[list[str], str, int, str]]:
    """(path, heading, level, body) of each section that a line of # marks and a space begins; code fences don't matter."""
    sections: list[tuple[list[str], str, int, list[str]]] = []
    path: list[str] = []
    for line in text.split("\n"):
        mark = line.strip()
        level = len(mark) - len(mark.lstrip("#"))
        if level and mark[level : level + 1] == " " and mark[level:].strip():
            title = mark[level:].strip()
            path = [*path[: level - 1], title]
            sections.append((path, title, level, []))
        elif sections:
            sections[-1][3].append(line)
        elif line.strip():
            sections.append(([], "", 0, [line]))
    return [(p, h, level, "\n".join(body).strip()) for p, h, level, body in sections]


def markdown_pieces(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of each section that has text; the windows of the whole text if it has no heading."""
    found = headings(text)
    if not any(level for _, _, level, _ in found):
        return [(w, [], "", 0) for w in char_windows(text, size, overlap)]
    pieces = [(w, path, heading, level) for path, heading, level, body in found for w in char_windows(body, size, overlap)]
    return pieces or [(w, [], "", 0) for w in char_windows(text, size, overlap)]


def split_documents(documents: DataFrame, key: str, text: str, markdown: bool = False, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, key, chunk_index, chunk_total, content, section_path, heading, heading_level).

    chunk_id is the key, a colon and the index. Null and blank texts have no chunk.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["_key"], frame["_text"]):
                pieces = markdown_pieces(t, size, overlap) if markdown else [(w, [], "", 0) for w in char_windows(t, size, overlap)]
                rows += [(f"{k}:{i}", k, i, len(pieces), c, p, h, n) for i, (c, p, h, n) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["chunk_id", "_key", "chunk_index", "chunk_total", "content", "section_path", "heading", "heading_level"])

    slim = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = f"chunk_id string, _key {kind}, chunk_index int, chunk_total int, content string, section_path array<string>, heading string, heading_level int"
    return slim.mapInPandas(run, schema).withColumnRenamed("_key", key)
