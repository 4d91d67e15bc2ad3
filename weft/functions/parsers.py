"""Readers of model replies. Columns where tables are read, plain functions for the answer loops."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5


def grader_score(reply: Column) -> Column:
    """The number of the first line ``score=<number>``, held to 0..1; 0.5 where it can't be read."""
    value = F.trim(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?im)^[ \t\r]*score[ \t]*=([^\r\n]*)", 1)).try_cast("double")
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))), F.lit(NEUTRAL))


def judgement(reply: Column) -> Column:
    """struct(groundedness, answer_relevance, rationale) of the outermost braces, numbers held to 0..1; null if that is no JSON object."""
    body = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    read = F.from_json(body, "groundedness double, answer_relevance double, rationale string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    held = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    good = F.struct(held(read["groundedness"]).alias("groundedness"), held(read["answer_relevance"]).alias("answer_relevance"), F.coalesce(read["rationale"], F.lit("")).alias("rationale"))
    return F.when(body.isNotNull() & read["_bad"].isNull(), good)


def extraction_lines(reply: Column) -> Column:
    """The reply's lines, each split at bars into trimmed parts."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: x != "")
    return F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda p: F.trim(p)))


def _lines(reply: str, fences: bool = True) -> list[str]:
    found = (line.strip() for line in (reply or "").split("\n"))
    return [line for line in found if line and not (fences and line.startswith("```"))]


def _marked(reply: str, mark: str) -> tuple[str | None, str]:
    """What follows the first line with this mark, and the other lines joined by spaces."""
    value, rest = None, []
    for line in _lines(reply):
        if value is None and line.lower().startswith(mark):
            value = line[len(mark) :].strip()
        else:
            rest.append(line)
    return value, " ".join(rest)


def map_score(reply: str) -> tuple[int, str]:
    """Score 0 to 100 and text of a partial answer."""
    value, text = _marked(reply, "score:")
    digits = re.match(r"\d+", value or "")
    return min(100, int(digits[0])) if digits else 0, text


def community_report(reply: str) -> tuple[str, str]:
    value, text = _marked(reply, "title:")
    return value or "", text


def follow_up_names(reply: str) -> tuple[str, list[str]]:
    """Partial answer and the different names after ``Follow-up:``, "none" left out."""
    value, text = _marked(reply, "follow-up:")
    names: dict[str, str] = {}
    for part in (value or "").split(","):
        if part.strip() and part.strip().lower() != "none":
            names.setdefault(part.strip().lower(), part.strip())
    return text, list(names.values())


def planned_queries(reply: str, most: int) -> list[str]:
    """Up to most lines without bullets or numbers."""
    out = []
    for line in _lines(reply, fences=False):
        bare = line[2:].strip() if re.match(r"[-*] ", line) else re.sub(r"^\d+[.)]\s*(?=\S)", "", line)
        if bare and len(out) < most:
            out.append(bare)
    return out


def sub_queries(reply: str, most: int = 5) -> list[str]:
    bare = [line.lstrip("-*0123456789.) \t").strip() for line in _lines(reply, fences=False)]
    return list(dict.fromkeys(x for x in bare if x))[:most]


def decision(reply: str) -> tuple[str, str, str]:
    """(decision, reason, rewrite); ValueError if there is none or it is unknown."""
    found = dict(reversed([(k.strip().lower(), v.strip()) for k, eq, v in (line.partition("=") for line in reversed(_lines(reply, fences=False))) if eq]))
    choice = found.get("decision", "").lower()
    if choice not in ("stop", "continue", "rewrite_and_continue"):
        raise ValueError(f"no valid decision in {reply!r}")
    return choice, found.get("reason", ""), found.get("rewrite", "")
