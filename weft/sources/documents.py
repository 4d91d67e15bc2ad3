"""Sources of documents and labelled examples, and the sinks that write results as JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id string, title string, content string, source_id string, version string, checksum string, embedding_version string, metadata map<string,string>"
EXAMPLE = "query string, namespace string, gold_doc_ids array<string>, gold_chunk_ids array<string>, gold_answers array<string>, required_phrases array<string>, notes string, top_k int"


def static(spark: SparkSession, documents: Iterable[Mapping[str, object]]) -> DataFrame:
    """A fixed list of documents as a table."""
    names = [part.split()[0] for part in DOCUMENT.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in documents], DOCUMENT)


def from_function(spark: SparkSession, read: Callable[[], Iterable[Mapping[str, object]]]) -> DataFrame:
    """The documents that a function returns."""
    return static(spark, read())


def labelled_examples(spark: SparkSession, path: str, default_k: int = 5) -> DataFrame:
    """Examples of a JSON lines file; blank lines and those that begin with // or # are skipped.

    All get the first positive top_k of the file, else the default. A line that is no JSON object fails the read.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_n"), F.trim("value").alias("_l")).where("_l <> '' and not startswith(_l, '//') and not startswith(_l, '#')")
    rows = lines.select("_n", F.from_json("_l", EXAMPLE, {"mode": "FAILFAST"}).alias("e")).select("_n", "e.*")
    first = rows.where("top_k > 0").agg(F.min_by("top_k", "_n").alias("_k"))
    return rows.crossJoin(F.broadcast(first)).withColumn("top_k", F.coalesce("_k", F.lit(default_k))).drop("_n", "_k")  # one row on the right


def dataset_name(path: str) -> str:
    return Path(path).stem


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as a JSON line; nulls are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def append_feedback(path: str, query: str, answer: str, chunk_ids: Iterable[str], **more: object) -> None:
    """One example as a JSON line at the end of a file that only its owner may read."""
    row = {"query": query, "gold_answers": [answer], "gold_chunk_ids": list(chunk_ids), **more}
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
    with os.fdopen(handle, "a", encoding="utf-8") as out:
        out.write(json.dumps(row, ensure_ascii=False) + "\n")


def encode_benchmark(header: Mapping[str, object], examples: Iterable[Mapping[str, object]]) -> str:
    """A header line and one line per example; NaN is written as null."""
    clean = lambda v: None if isinstance(v, float) and v != v else v
    lines = [{"type": "header", **header}, *({"type": "example", **e} for e in examples)]
    return "".join(json.dumps({k: clean(v) for k, v in row.items()}, ensure_ascii=False) + "\n" for row in lines)


def decode_benchmark(text: str, header_keys: set[str], example_keys: set[str]) -> tuple[dict[str, object], list[dict[str, object]]]:
    """What encode_benchmark wrote; unknown keys, a missing header and text after a blank line are errors."""
    lines = text.split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    if any(not line.strip() for line in lines):
        raise ValueError("text after a blank line")
    rows = [json.loads(line) for line in lines]
    if not rows or rows[0].pop("type", None) != "header":
        raise ValueError("no header line")
    for i, row in enumerate(rows):
        if i and row.pop("type", None) != "example":
            raise ValueError(f"line {i + 1} is no example")
        if unknown := set(row) - (example_keys if i else header_keys):
            raise ValueError(f"unknown keys {sorted(unknown)}")
    return rows[0], rows[1:]


def encode_record(record: Mapping[str, object]) -> str:
    """A run's result or diagnostics as one JSON object; NaN is written as null."""

    def clean(value: object) -> object:
        if isinstance(value, float) and value != value:
            return None
        if isinstance(value, Mapping):
            return {k: clean(v) for k, v in value.items()}
        return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value

    return json.dumps(clean(record), ensure_ascii=False)


def decode_record(text: str, shape: Mapping[str, object]) -> dict[str, object]:
    """What encode_record wrote. shape has the known keys: None for a value, a shape for an object, [shape] for a list of them.

    Unknown keys at any depth, and anything but one JSON object, are errors.
    """

    def checked(value: object, known: object, where: str) -> object:
        if isinstance(known, list) and isinstance(value, list):
            return [checked(v, known[0], where) for v in value]
        if isinstance(known, Mapping) and value is not None:
            if not isinstance(value, dict):
                raise ValueError(f"{where or 'the text'} is no object")
            if unknown := set(value) - set(known):
                raise ValueError(f"unknown keys {sorted(unknown)} in {where or 'the object'}")
            return {k: checked(v, known[k], f"{where}.{k}".lstrip(".")) for k, v in value.items()}
        return value

    out = checked(json.loads(text), shape, "")
    if not isinstance(out, dict):
        raise ValueError("the text is no object")
    return out


def write_triad(path: str, examples: DataFrame, summary: Mapping[str, object]) -> None:
    """Each example as a JSON line in files of the folder, the summary as a line of its own in a last file."""
    write_lines(examples, path)
    spark = examples.sparkSession
    spark.createDataFrame([(json.dumps({"summary": dict(summary)}, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(path)


def http_scores(url: str, query: str, passages: list[str], model: str = "", key: str = "", timeout: float = 30.0) -> list[float]:
    """Relevance scores of passages from a rerank endpoint, in their order."""
    import urllib.request

    body = json.dumps({"model": model, "query": query, "documents": passages}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        results = json.load(reply)["results"]
    out = [0.0] * len(passages)
    for r in results:
        out[r["index"]] = float(r["relevance_score"])
    return out


def http_model(url: str, model: str = "", key: str = "", timeout: float = 30.0, ask: Callable[..., list[float]] = http_scores) -> Callable[[list[tuple[str, str]]], list[float]]:
    """A rerank endpoint as a model of (query, passage) pairs: one request for each different query of a batch."""

    def scores(pairs: list[tuple[str, str]]) -> list[float]:
        out = [0.0] * len(pairs)
        by: dict[str, list[int]] = {}
        for i, (query, _) in enumerate(pairs):
            by.setdefault(query, []).append(i)
        for query, places in by.items():
            for i, s in zip(places, ask(url, query, [pairs[i][1] or "" for i in places], model, key, timeout), strict=True):
                out[i] = s
        return out

    return scores
