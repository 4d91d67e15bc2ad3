"""Problem 3: cut oversized texts at natural limits, with an overlap.

A dynamic programme over the boundary positions of a text minimises the penalties of the cuts and
of the places where pieces begin, and the imbalance of the pieces' sizes, under a largest size and a wanted overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a cut before a position, by the kind of limit there.
PENALTY = {"section": 0.0, "paragraph": 0.04, "line": 0.1, "sentence": 0.2, "word": 0.6, "none": 2.0}
KINDS = tuple(PENALTY)
#: Part of a limit's cost for a piece that begins there rather than ends.
START = 0.25
#: Signs that belong to the character before them.
_JOINING = "\u200d\ufe0e\ufe0f\u20e3"
#: White space that is taken off the ends of a text before it is measured.
TRIMMED = " \t\r\n"

_SECTION = re.compile(r"^(?:#{1,6}[ \t]|={1,6}[^=\n]|<h[1-6]\b|\\(?:sub)*section\b)", re.M | re.I)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\r\n?|\n")
_SENTENCE = re.compile(r"[.!?]['\")\]]*\s+|[。！？][”’）]*\s*")
_WORD = re.compile(r"\s+")


def boundaries(text: str, max_len: int, overlap: int, sections: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may be made, ascending, and the index in KINDS of the limit at each.

    Word limits are offered only inside stretches without a stronger limit that are longer than a
    quarter of the room a piece has besides its overlap, and cuts anywhere only inside stretches
    without word limits of that length; so a piece can always be made. sections are headings: a
    line that holds just one of them begins a section, as do lines that look like headings.
    """
    found: dict[int, int] = {}

    def offer(kind: str, positions: Iterator[int]) -> None:
        rank = KINDS.index(kind)
        for p in positions:
            if 0 < p < len(text):
                found[p] = min(rank, found.get(p, rank))

    offer("section", (m.start() for m in _SECTION.finditer(text)))
    for heading in {s.strip() for s in sections if s and s.strip()}:
        offer("section", (m.start() for m in re.finditer(rf"^[^\w\n]*{re.escape(heading)}[^\w\n]*$", text, re.M)))
    offer("paragraph", (m.end() for m in _PARAGRAPH.finditer(text)))
    offer("line", (m.end() for m in _LINE.finditer(text)))
    offer("sentence", (m.end() for m in _SENTENCE.finditer(text)))
    step = max(1, (max_len - overlap) // 4)

    def gaps() -> list[tuple[int, int]]:
        marks = [0, *sorted(found), len(text)]
        return [(a, b) for a, b in zip(marks, marks[1:]) if b - a > step]

    for a, b in gaps():
        offer("word", (m.end() for m in _WORD.finditer(text, a, b)))
    for a, b in gaps():
        offer("none", (_whole(text, p) for p in range(a + step, b, step)))
    at = np.array(sorted(found), dtype=np.int64)
    return at, np.array([found[p] for p in at.tolist()], dtype=np.int64)


def _whole(text: str, p: int, step: int = -1) -> int:
    """p, or the nearest place from there on that parts no character from its marks and no joined sequence."""
    for _ in range(16):
        if not 0 < p < len(text) or not (unicodedata.combining(text[p]) or text[p] in _JOINING or "\U0001f3fb" <= text[p] <= "\U0001f3ff" or text[p - 1] == "\u200d"):
            break
        p += step
    return max(p, 1)


def _starts(text: str, at: np.ndarray, kind: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the piece after each cut begins, and the kind of limit there.

    Of the limits in the overlap characters before the cut the strongest kind counts, and of that
    the first; without any, the next beginning of a word, else overlap characters before the cut.
    """
    if not overlap:
        return at.copy(), kind.copy()
    word, none = KINDS.index("word"), KINDS.index("none")
    out, kinds = np.empty_like(at), np.empty_like(kind)
    lows = np.searchsorted(at, at - overlap)
    for i, c in enumerate(at.tolist()):
        near = kind[lows[i] : i]
        if len(near) and near.min() < word:
            j = lows[i] + int(np.argmin(near))
            out[i], kinds[i] = at[j], kind[j]
            continue
        low = max(0, c - overlap)
        if low == 0 or text[low - 1].isspace() and not text[low].isspace():
            out[i], kinds[i] = low, word if low else 0
            continue
        m = _WORD.search(text, low, c)
        if m and m.end() < c:
            out[i], kinds[i] = m.end(), word
        else:
            out[i], kinds[i] = min(_whole(text, low, 1), c), none
    return out, kinds


def split_spans(text: str, max_len: int = 1200, overlap: int = 120, sections: Sequence[str] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind of limit at the end) of each piece, in code points of the text.

    The text is first trimmed of spaces, tabs and line breaks; positions count from its untrimmed
    start. A text within max_len is one piece, an empty one none. Every character of the trimmed
    text is in a piece, no piece is longer than max_len, and consecutive pieces share overlap
    characters or fewer, down to the strongest limit there: a section, paragraph, line or sentence
    if one begins there, else a word.
    """
    if not 0 <= overlap < max_len:
        raise ValueError("overlap must be 0 or more and less than max_len")
    body = text.strip(TRIMMED)
    if not body:
        return []
    shift = len(text) - len(text.lstrip(TRIMMED))
    if len(body) <= max_len:
        return [(shift, shift + len(body), "end")]
    at, kind = boundaries(body, max_len, overlap, sections)
    found = _cheapest(body, at, kind, *_starts(body, at, kind, overlap), max_len, overlap)
    if found is None:  # strong limits so close that pieces can't begin there: begin them at words
        found = _cheapest(body, at, kind, *_starts(body, at, np.full_like(kind, KINDS.index("none")), overlap), max_len, overlap)
    if found is None:  # nor there: cut anywhere
        grid = np.arange(max_len, len(body), max_len - overlap)
        found = [(max(0, e - max_len), e, "none") for e in grid.tolist()] + [(int(grid[-1]) - overlap, len(body), "end")]
    return [(shift + x, shift + y, limit) for x, y, limit in found]


def _cheapest(body: str, at: np.ndarray, kind: np.ndarray, begins: np.ndarray, begun: np.ndarray, max_len: int, overlap: int) -> list[tuple[int, int, str]] | None:
    """The pieces of the least cost, by a programme over the cuts; None if there are none within max_len."""
    n = len(body)
    costs = np.array(list(PENALTY.values()))
    cuts = np.append(at, n)
    price = np.append(costs[kind] + START * costs[begun], 0.0)
    starts = np.append(0, begins)  # starts[j]: of the piece after the (j-1)th cut
    pieces = max(2, -(-(n - overlap) // (max_len - overlap)))
    target = (n + (pieces - 1) * overlap) / pieces
    best = np.full(len(cuts) + 1, np.inf)
    back = np.zeros(len(cuts) + 1, dtype=np.int64)
    best[0] = 0.0
    first, before = 0, np.append(0, at)
    for j, c in enumerate(cuts.tolist(), 1):
        while c - before[first] > max_len:
            first += 1
        size = c - starts[first:j]
        fits = size <= max_len
        if j < len(cuts):
            fits &= starts[first:j] < starts[j]  # each piece begins and ends after the one before it
        cost = np.where(fits, best[first:j] + ((size - target) / target) ** 2, np.inf)
        if not len(cost):
            continue
        k = int(np.argmin(cost))
        best[j] = cost[k] + price[j - 1]
        back[j] = first + k
    if not np.isfinite(best[-1]):
        return None
    spans, j = [], len(cuts)
    while j:
        i = int(back[j])
        spans.append((int(starts[i]), int(cuts[j - 1]), "end" if j == len(cuts) else KINDS[int(kind[j - 1])]))
        j = i
    return spans[::-1]


def split_texts(rows: DataFrame, key: str, text: str, max_len: int = 1200, overlap: int = 120, sections: str | None = None) -> DataFrame:
    """(key, piece, start, end, limit, content): the pieces of each text, numbered from 0.

    Texts within max_len are one piece and never leave the JVM; longer ones go to Python by
    batches. A null, empty or blank text has no piece; rows with a null key keep it. Repeated rows
    are split each for itself. start and end count code points of the untrimmed text; content is the text
    between them.
    """
    paths = F.col(sections) if sections else F.array().cast("array<string>")
    slim = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), paths.alias("_paths"))
    trimmed = slim.withColumn("_body", F.expr(r"trim(BOTH ' \t\r\n' FROM _text)"))
    trimmed = trimmed.where(F.length("_body") > 0)
    out = "_key " + rows.schema[key].dataType.simpleString() + ", piece int, start int, end int, limit string, content string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for k, t, path in zip(frame["_key"], frame["_text"], frame["_paths"]):
                heads = [] if path is None else [x for x in path if x]
                found += [(k, i, a, b, limit, t[a:b]) for i, (a, b, limit) in enumerate(split_spans(t, max_len, overlap, heads))]
            yield pd.DataFrame(found, columns=["_key", "piece", "start", "end", "limit", "content"])

    long = trimmed.where(F.length("_body") > max_len).select("_key", "_text", "_paths").mapInPandas(cut, out)
    lead = (F.length("_text") - F.length(F.expr(r"trim(LEADING ' \t\r\n' FROM _text)"))).cast("int")
    short = trimmed.where(F.length("_body") <= max_len).select(
        "_key", F.lit(0).alias("piece"), lead.alias("start"), (lead + F.length("_body")).cast("int").alias("end"), F.lit("end").alias("limit"), F.col("_body").alias("content")
    )
    return short.unionByName(long).withColumnRenamed("_key", key)
