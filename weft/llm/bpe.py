"""Problem 8: token ids of whole texts by a public byte-level BPE vocabulary.

The words that a batch of texts brings for the first time are laid end to end; an index maps each
pair of neighbouring symbols to all its positions. Pairs are merged in ascending rank, each rank at
all its positions at once, and only the lists of the neighbours are updated. The cost follows the
different words, not the length of the texts.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# The white space of Unicode, and the published pattern that splits text before the merges.
_SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: A space that follows white space; texts without one can be cut before every space.
_RUN = regex.compile(rf"[{_SPACE}\x1c-\x1f] ")
_CUT = regex.compile(rf"(?<=[^{_SPACE}\x1c-\x1f])(?= )")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BPE:
    """Encoder of one vocabulary; keeps what it has encoded, up to ``keep`` pieces of text."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000) -> None:
        self.ranks, self.keep = ranks, keep
        self.token = {rank: token for token, rank in ranks.items()}
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}

    def _rank(self, pair: tuple[int, int]) -> int:
        """The rank of two symbols' union, -1 where the vocabulary lacks it."""
        rank = self.pair_rank.get(pair)
        if rank is None:
            rank = self.pair_rank[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return rank

    def merge(self, words: list[str]) -> None:
        """Encode words that aren't known yet, all at once."""
        symbols: list[int] = []
        ends = [0]
        for word in words:
            symbols += [self.first[b] for b in word.encode("utf-8", "replace")]
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(ends, ends[1:]):
            if b > a:
                after[b - 1] = before[a] = -1
        index: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(n):
            if after[i] >= 0:
                index[symbols[i], symbols[after[i]]].append(i)
        active = [(rank, pair) for pair in index if (rank := self._rank(pair)) >= 0]
        heapq.heapify(active)
        while active:
            rank, pair = heapq.heappop(active)
            left, right = pair
            positions = index.pop(pair, None)
            if not positions:
                continue
            positions.sort()
            fresh: set[tuple[int, int]] = set()
            for i in positions:
                j = after[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    index[rank, symbols[k]].append(i)
                    fresh.add((rank, symbols[k]))
                if (h := before[i]) >= 0:
                    index[symbols[h], rank].append(h)
                    fresh.add((symbols[h], rank))
            for new in fresh:
                if (r := self._rank(new)) >= 0:
                    heapq.heappush(active, (r, new))
        for word, a, b in zip(words, ends, ends[1:]):
            self.words[word] = [s for s in symbols[a:b] if s >= 0]

    def cut(self, text: str) -> list[str]:
        """Pieces whose tokens don't depend on each other: no token reaches from a letter into a following space."""
        if _RUN.search(text):
            return _CUT.split(text)
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]

    def encode(self, texts: Iterable[str | None]) -> list[list[list[int]]]:
        """For each text the id lists of its pieces, in order; none for a null or empty text."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        if len(self.words) > self.keep:
            self.words.clear()
        if len(self.pair_rank) > 4 * self.keep:
            self.pair_rank.clear()
        new = {p for pieces in cuts for p in pieces if p not in self.pieces}
        split = {p: self.pattern.findall(p) for p in new}
        self.merge([w for w in set(chain.from_iterable(split.values())) if w not in self.words])
        for p, words in split.items():
            self.pieces[p] = list(chain.from_iterable(map(self.words.__getitem__, words)))
        return [list(map(self.pieces.__getitem__, pieces)) for pieces in cuts]


_LOADED: dict[str, BPE] = {}


def encoder(path: str) -> BPE:
    """The encoder of a vocabulary file; one per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BPE(load_ranks(path))
    return _LOADED[path]


def encode_texts(rows: DataFrame, key: str, text: str, path: str | None = None, lengths_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens): the token ids of every row's text.

    A null or empty text gets an empty list (0). Strings that look like special tokens are ordinary
    text. Every row is encoded, repeated and null keys included; other columns are ignored. path:
    the rank file, which must exist on every executor.
    """
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                coded = bpe.encode(batch.column(1).to_pylist())
                sizes = np.fromiter((sum(map(len, pieces)) for pieces in coded), np.int64, len(coded))
                if lengths_only:
                    values: pa.Array = pa.array(sizes)
                else:
                    ids = np.fromiter(chain.from_iterable(chain.from_iterable(coded)), np.int32, int(sizes.sum()))
                    values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), values], ["_key", "_out"])

    name = "n_tokens" if lengths_only else "ids"
    out = slim.mapInArrow(run, f"_key {kind}, _out {'bigint' if lengths_only else 'array<int>'}")
    return out.select(F.col("_key").alias(key), F.col("_out").alias(name))
