"""Reports of runs as Markdown and plain text. Their inputs are metrics and counts, so they are small whatever the corpus."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

# The metrics of a benchmark, in the order of its report.
METRICS = ("Examples", "ExactMatch", "F1Token", "RequiredPhraseRecall", "ReflectionRoundsMean", "GraderAdoptionRate", "FollowupQueriesUsedMean", "ActiveRetrievalFireRate", "MeanGroundedness", "MeanAnswerRelevance")


def _undefined(value: float | None) -> bool:
    return value is None or isinstance(value, float) and math.isnan(value)


def _number(value: float | None, shape: str = ".3f", missing: str = "n/a") -> str:
    return missing if _undefined(value) else format(value, shape)


def _table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows)]


def benchmark_markdown(name: str, metrics: Mapping[str, float | None], adopted: Sequence[int] = ()) -> str:
    """A benchmark's metrics, undefined ones as n/a, and how often each round was adopted."""
    values = [(m, str(int(metrics.get(m) or 0)) if m == "Examples" else _number(metrics.get(m))) for m in METRICS]
    lines = [f"# Benchmark: {name}", "", "## Metrics", "", *_table(["Metric", "Value"], values)]
    if adopted:
        lines += ["", "## AdoptedRound Distribution", "", *_table(["Bucket", "Count"], [(str(i), str(n)) for i, n in enumerate(adopted)])]
    return "\n".join(lines) + "\n"


def drift_summary(dataset: str, deltas: Sequence[Mapping[str, object]], new: Sequence[str] = (), dropped: Sequence[str] = ()) -> str:
    """One line per metric (metric, prev, curr, delta, direction), and how many examples are new and dropped."""
    lines = [f'DriftReport for dataset "{dataset}":']
    for d in deltas:
        lines.append(f"  {d['metric'] + ':':<24} {_number(d['prev'], '7.3f', 'NaN')} -> {_number(d['curr'], '7.3f', 'NaN')}  delta={_number(d['delta'], '+.3f', '  NaN')}  {d['direction']}")
    return "\n".join([*lines, f"  New examples: {len(new)}", f"  Dropped:      {len(dropped)}"]) + "\n"


def drift_markdown(deltas: Sequence[Mapping[str, object]], new: Sequence[str] = (), dropped: Sequence[str] = (), histograms: Mapping[str, Sequence[tuple[int, int]]] | None = None) -> str:
    """The same as a table, the examples by name, and each histogram (earlier, later counts by bucket) with its L1 distance."""
    lines = _table(["Metric", "Prev", "Curr", "Δ", "Direction"], [(str(d["metric"]), _number(d["prev"]), _number(d["curr"]), _number(d["delta"], "+.3f"), str(d["direction"])) for d in deltas])
    for title, names in (("New", new), ("Dropped", dropped)):
        if names:
            lines += ["", f"**{title} examples:**", *(f"* {n}" for n in names)]
    shown = {k: v for k, v in (histograms or {}).items() if v}
    if shown:
        lines += ["", "### Histograms"]
    for name, counts in shown.items():
        lines += ["", f"#### {name}", *_table(["Bucket", "Prev", "Curr", "Δ"], [(str(i), str(a), str(b), f"{b - a:+d}") for i, (a, b) in enumerate(counts)]), f"L1={sum(abs(b - a) for a, b in counts):.3f}"]
    return "\n".join(lines) + "\n"


def triad_summary(dataset: str, retrieval: Mapping[str, float | None], generation: Mapping[str, float | None], k: int) -> str:
    """Retrieval metrics and the judge's means in three lines."""
    shown = lambda values, names: " ".join(f"{label}={_number(values.get(key) or 0.0)}" for label, key in names)
    return (
        f'RAG Triad — dataset "{dataset}" ({int(retrieval.get("queries") or 0)} examples, TopK {k})\n'
        f"  retrieval:  {shown(retrieval, (('precision@k', 'precision'), ('recall@k', 'recall'), ('mrr', 'mrr'), ('grounding@k', 'grounding')))}\n"
        f"  generation: {shown(generation, (('groundedness', 'groundedness'), ('answer_relevance', 'answer_relevance')))}\n"
    )
