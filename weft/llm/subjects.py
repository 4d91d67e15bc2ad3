"""Problem 10: the subject areas of every document, by a latent Dirichlet topic model.

The model is fitted to the whole corpus by variational Bayes: each pass infers the topic counts of
all documents in parallel and adds their term statistics up by partition. Terms of labelled examples
give the topics' prior, and spare topics take the words that belong to no subject. A topic counts for
the subject that its top terms speak for, seen in the labelled examples; a document has each subject
that makes up a fifth or more of its subject matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut


@dataclass(frozen=True)
class Settings:
    """terms: most terms of the vocabulary, those in most documents; least_documents: below which a
    term is no term; spare: topics for words of no subject; passes over the corpus; steps per document;
    alpha, spare_alpha, eta: Dirichlet priors; least_share of the subject matter; least_words: of
    subject matter, below which a text is about nothing; top: terms a topic is judged by."""

    terms: int = 50_000
    least_documents: int = 3
    spare: int = 2
    passes: int = 3
    steps: int = 12
    alpha: float = 0.05
    spare_alpha: float = 1.0
    eta: float = 0.01
    least_share: float = 0.18
    least_words: float = 3.0
    top: int = 60


#: A topic's share of a word below which it doesn't count for the topic's statistics.
LEAST = 1e-3

#: Documents whose terms are listed together when they are read.
READ = 4096

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]+")
# Every branch begins with a letter as it stands, so the search leaps to those letters; case is left open after them.
_NOISE = re.compile(r"<(?i:(script|style)\b.*?</\1\s*>)|<[^<>]{1,300}>|h(?i:ttps?://\S+)|H(?i:ttps?://\S+)|&\w+;|\\(?i:[a-zA-Z]+)", re.S)
_ASCII = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + b" " * 128


def words(text: str) -> list[str]:
    """Lower-case words; runs of Chinese characters give their pairs of neighbours. Tags and addresses are left out."""
    if "<" in text or "\\" in text or "://" in text:
        text = _NOISE.sub(" ", text)
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    found = _WORD.findall(text)
    if not _HAN.search(text):
        return found
    out: list[str] = []
    for w in found:
        if w[0] < "㐀":
            out.append(w)
        else:
            for run in _HAN.findall(w):
                out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    return out


@dataclass
class Topics:
    """Term weights of each topic, and the subject of each; -1 for none."""

    weights: np.ndarray
    alpha: np.ndarray
    subject: np.ndarray

    def logs(self) -> np.ndarray:
        return np.exp(_digamma(self.weights) - _digamma(self.weights.sum(axis=1, keepdims=True)))


def _digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, to about seven digits."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        shift -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def infer(beta: np.ndarray, alpha: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected words of each topic in each document, and each (document, term)'s shares of topics.

    ends[i] is where the terms of document i end; every document has at least one.
    """
    starts = np.append(0, ends[:-1])
    doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    word = beta.T[terms].astype(np.float32)
    counts = counts.astype(np.float32)
    size = np.add.reduceat(counts, starts)
    held = np.repeat((size / len(alpha))[:, None], len(alpha), axis=1)
    last = np.empty_like(held)
    # each document stops by itself, so that its shares don't depend on what it is read with
    running, at, first, some, many = np.arange(len(ends)), doc, starts, word, counts
    on = np.ones(len(ends), dtype=bool)
    for step in range(steps):
        theta = np.exp(_digamma(held[running] + alpha)).astype(np.float32)
        last[running[on]] = theta[on]
        odds = many / np.maximum(np.einsum("ij,ij->i", some, theta[at]), 1e-30)
        new = theta * np.add.reduceat(some * odds[:, None], first, axis=0)
        moved = np.abs(new - held[running]).sum(axis=1) / size[running]
        held[running[on]] = new[on]
        if step > 3:
            on = on & (moved >= 0.002)  # less than one word in 500 still changes its topic
            if not on.any():
                break
            if on.sum() < 0.8 * len(on):  # those that stopped go when they are many
                kept = on[at]
                lengths = np.bincount(at[kept], minlength=len(on))[on]
                running, some, many = running[on], some[kept], many[kept]
                at, first, on = np.repeat(np.arange(len(running)), lengths), np.append(0, np.cumsum(lengths)[:-1]), np.ones(len(running), dtype=bool)
    share = word * last[doc]
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return held, share


def _batches(table: pa.RecordBatch, size: int = 1024) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, ends, terms and counts of a few documents at a time; documents without terms are left out."""
    for at in range(0, table.num_rows, size):
        part = table.slice(at, size)
        terms, counts = part.column(1), part.column(2)
        sizes = np.diff(terms.offsets.to_numpy())
        some = sizes > 0
        if some.any():
            flat = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64)
            yield part.column(0).filter(pa.array(some)), np.cumsum(sizes[some]), *flat


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(key, subject, share): the subjects of every text that has any.

    labels has key and subject: examples, whose subjects are matched without regard to case and
    blanks; others are ignored, and so are labels of unknown documents. A null, empty or blank text
    has no row, nor has one with too few words of any subject. Repeated rows count each for itself
    and come out once; rows with a null key are left out. Without usable labels there are no rows.
    """
    s = settings or Settings()
    kind = documents.schema[key].dataType.simpleString()
    names = list(subjects)
    slim = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull() & F.col("_text").isNotNull())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are taken apart once: some documents' words with the number of those that have each, then a row for each of them."""
        for whole in batches:
            for at in range(0, whole.num_rows, READ):
                batch = whole.slice(at, READ)
                listed: defaultdict[str, int] = defaultdict()
                listed.default_factory = listed.__len__
                terms, counts, sizes = [], [], []
                for t in batch.column(1).to_pylist():
                    got = Counter(words(t))
                    terms += map(listed.__getitem__, got)
                    counts += got.values()
                    sizes.append(len(got))
                places, n = np.array(terms, dtype=np.int32), len(listed)
                one, rows = pa.array([0, n], pa.int32()), pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                have = pa.ListArray.from_arrays(one, pa.array(np.bincount(places, minlength=n).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.nulls(1, have.type), have, pa.ListArray.from_arrays(one, pa.array(list(listed), pa.string()))], columns)
                lists = [pa.ListArray.from_arrays(rows, pa.array(x)) for x in (places, np.array(counts, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.nulls(len(sizes), pa.list_(pa.string()))], columns)

    columns = ["_key", "_terms", "_counts", "_words"]
    coded = cut(slim.mapInArrow(read, f"_key {kind}, _terms array<int>, _counts array<int>, _words array<string>"))
    lists = coded.where(F.col("_words").isNotNull()).select(F.explode(F.arrays_zip("_words", "_counts")).alias("_e"))
    found = lists.groupBy(F.col("_e._words").alias("term")).agg(F.sum("_e._counts").alias("n")).where(F.col("n") >= s.least_documents)
    listed = found.orderBy(F.desc("n"), F.asc("term")).limit(s.terms).collect()  # at most s.terms rows
    place = {r.term: i for i, r in enumerate(listed)}
    out = f"_key {kind}, subject string, share double"
    if not place or not names:
        return slim.select("_key", F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false").withColumnRenamed("_key", key)
    shared = documents.sparkSession.sparkContext.broadcast(place)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' terms by their places in the vocabulary; their rows stand behind those of their words."""
        places = np.empty(0, np.int32)
        for batch in batches:
            heads = np.flatnonzero(batch.column(3).is_valid())
            for a, b in zip([-1, *heads.tolist()], [*heads.tolist(), batch.num_rows]):
                if a >= 0:
                    places = np.array([shared.value.get(w, -1) for w in batch.column(3)[a].as_py()], np.int32)
                part = batch.slice(a + 1, b - a - 1)
                if not part.num_rows:
                    continue
                ends = part.column(1).offsets.to_numpy()
                terms = places[part.column(1).flatten().to_numpy()]
                some = terms >= 0
                rows = pa.array(np.append(0, np.cumsum(some))[ends - ends[0]].astype(np.int32))
                lists = [pa.ListArray.from_arrays(rows, pa.array(x[some])) for x in (terms, part.column(2).flatten().to_numpy())]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], columns[:3])

    # each task of a pass sends a matrix, so there are few of them: two for each core
    few = coded.coalesce(2 * documents.sparkSession.sparkContext.defaultParallelism)

    # Terms of the labelled examples, by subject: one small matrix per partition.
    wanted = F.lower(F.trim(F.col("subject")))
    examples = labels.select(F.col(key).alias("_key"), wanted.alias("_subject")).where(F.col("_subject").isin([n.lower() for n in names])).distinct()
    position = {n.lower(): i for i, n in enumerate(names)}
    v, k = len(place), len(names) + s.spare

    def sums(matrix: np.ndarray) -> pa.RecordBatch:
        rows, columns = np.nonzero(matrix)
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(matrix[rows, columns].astype(np.float64))], ["t", "w", "n"])

    def gather(parts: DataFrame, rows: int) -> np.ndarray:
        """Sum of the partitions' matrices; its size is bounded by topics and vocabulary."""
        total = np.zeros((rows, v))
        got = parts.groupBy("t", "w").agg(F.sum("n").alias("n")).toArrow()
        total[got["t"].to_numpy(), got["w"].to_numpy()] = got["n"].to_numpy()
        return np.round(total, 6)  # what is left of the order of summing

    def by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((len(names), v))
        for batch in batches:
            for subject, terms, counts in zip(batch.column(2).to_pylist(), batch.column(0), batch.column(1)):
                np.add.at(matrix[position[subject]], np.asarray(terms.values, dtype=np.int64), np.minimum(np.asarray(counts.values), 3))
        yield sums(matrix)

    labelled = gather(coded.mapInArrow(known, f"_key {kind}, _terms array<int>, _counts array<int>").join(examples, "_key").select("_terms", "_counts", "_subject").mapInArrow(by_label, "t int, w int, n double"), len(names))
    if not labelled.sum():
        return slim.select("_key", F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false").withColumnRenamed("_key", key)
    topics = start(labelled, np.array([r.n for r in listed], dtype=np.float64), s)

    for _ in range(s.passes):
        beta, alpha = topics.logs(), topics.alpha

        def learn(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta, alpha: np.ndarray = alpha) -> Iterator[pa.RecordBatch]:
            matrix = np.zeros((k, v))
            for batch in known(batches):
                for _, ends, terms, counts in _batches(batch):
                    _, share = infer(beta, alpha, ends, terms, counts, s.steps)
                    share[share < LEAST] = 0  # by word and document, so partitions don't matter; keeps the sums sparse
                    for t in range(k):
                        matrix[t] += np.bincount(terms, share[:, t] * counts, minlength=v)
            yield sums(matrix)

        learned = gather(few.mapInArrow(learn, "t int, w int, n double"), k)
        learned[len(names) :] *= _common(labelled)  # spare topics mustn't take the words of a subject
        topics = Topics(prior(labelled, s) + learned, alpha, topics.subject)
    topics.subject = judge(topics.weights, labelled, s)
    beta, alpha, subject = topics.logs(), topics.alpha, topics.subject

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in known(batches):
            for keys, ends, terms, counts in _batches(batch):
                held, _ = infer(beta, alpha, ends, terms, counts, 2 * s.steps)
                matter = np.stack([held[:, subject == i].sum(axis=1) for i in range(len(names))], axis=1)
                whole = matter.sum(axis=1, keepdims=True)
                share = matter / np.maximum(whole, 1e-9)
                rows, columns = np.nonzero((share >= s.least_share) & (whole >= s.least_words))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array([names[c] for c in columns], pa.string()), pa.array(share[rows, columns].astype(np.float64))], ["_key", "subject", "share"])

    return coded.mapInArrow(tell, out).groupBy("_key", "subject").agg(F.max("share").alias("share")).withColumnRenamed("_key", key)


def _lift(labelled: np.ndarray) -> np.ndarray:
    """The share of each term's labelled uses that a subject has beyond its part of all labelled words."""
    part = (labelled.sum(axis=1) + 1) / (labelled.sum() + len(labelled))
    given = (labelled + 2 * part[:, None]) / (labelled.sum(axis=0) + 2)
    return np.maximum(0.0, given - 2 * part[:, None]) / (1 - part[:, None])


def _common(labelled: np.ndarray) -> np.ndarray:
    """How little each term stands out for any subject, from 0 to 1."""
    return (1 - _lift(labelled).max(axis=0)) ** 2


def prior(labelled: np.ndarray, s: Settings) -> np.ndarray:
    """What is known of each topic's terms beforehand: the labelled uses of the terms that stand out for a subject."""
    seeds = labelled * _lift(labelled)
    return np.concatenate([seeds, np.zeros((s.spare, labelled.shape[1]))]) + s.eta


def start(labelled: np.ndarray, documents: np.ndarray, s: Settings) -> Topics:
    """Topics to begin with: the prior, and for the spare ones the terms in proportion to how little they stand out."""
    weights = prior(labelled, s)
    plain = documents * _common(labelled)
    for i in range(s.spare):
        weights[len(labelled) + i] += plain * (1 + 0.1 * ((np.arange(len(plain)) + i) % 2))
    alpha = np.array([s.alpha] * len(labelled) + [s.spare_alpha] * s.spare)
    return Topics(weights, alpha, np.append(np.arange(len(labelled)), [-1] * s.spare))


def judge(weights: np.ndarray, labelled: np.ndarray, s: Settings) -> np.ndarray:
    """The subject of each topic by its top terms, weighed by how they stand out in labelled examples; -1 if none do."""
    part = weights / weights.sum(axis=1, keepdims=True)
    special = part * np.log(part / part.mean(axis=0))
    lift = _lift(labelled)
    out = []
    for row in special:
        top = np.argsort(-row, kind="stable")[: s.top]
        votes = lift[:, top] @ (np.maximum(row[top], 0) / max(1e-12, np.maximum(row[top], 0).sum()))
        # a subject must stand out in most of the topic's weight, and more than all others together
        clear = votes.max() > 0.05 and votes.max() > 0.5 * votes.sum()
        out.append(int(np.argmax(votes)) if clear else -1)
    return np.array(out)
