"""Seams to models: batched calls, retries, cached replies, token budgets. A model is a function from prompts to replies."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import estimated_tokens
from weft.session import cut

Model = Callable[[list[str]], list[str]]


class BudgetExceeded(RuntimeError):
    """More tokens were used than allowed; partial holds what was finished before."""

    def __init__(self, used: int, budget: int, partial: DataFrame | None = None) -> None:
        super().__init__(f"{used} tokens used, {budget} allowed")
        self.used, self.budget, self.partial = used, budget, partial


@dataclass
class Usage:
    """Calls and tokens by stage; a budget is checked after each stage, so it may be passed by one stage's tokens."""

    budget: int = 0
    calls: int = 0
    tokens: int = 0
    stages: list[tuple[str, int, int]] = field(default_factory=list)
    observe: Callable[[str, int, int], None] | None = None

    def add(self, stage: str, calls: int, tokens: int, partial: DataFrame | None = None) -> None:
        self.calls += calls
        self.tokens += tokens
        self.stages.append((stage, calls, tokens))
        if self.observe:
            self.observe(stage, calls, tokens)
        if 0 < self.budget < self.tokens:
            raise BudgetExceeded(self.tokens, self.budget, partial)


def echo(prompts: list[str]) -> list[str]:
    """A stand-in model for tests: the last line of the prompt."""
    return [p.rstrip().rsplit("\n", 1)[-1] for p in prompts]


def generate(rows: DataFrame, prompt: str, model: Model, out: str, stage: str = "generate", usage: Usage | None = None, skip_failures: bool = False) -> DataFrame:
    """rows with the model's reply to each prompt; with skip_failures, null for prompts whose call fails.

    Each distinct prompt is asked once, in batches, and the replies are written before anything reads
    them, so that a plan that runs again never calls the model again. A reply of another length is an error.
    """
    asked = rows.select(F.col(prompt).alias("_p")).where("_p is not null").distinct()

    def call(prompts: list[str]) -> list[str | None]:
        if not skip_failures:
            return list(model(prompts))
        try:
            return list(model(prompts))
        except Exception:
            # a batch fails as a whole: ask one by one, so that only those that fail are left out
            return [None] if len(prompts) == 1 else [r for p in prompts for r in call([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = call(frame["_p"].tolist())
            if len(replies) != len(frame):
                raise ValueError(f"the model returned {len(replies)} replies to {len(frame)} prompts")
            yield pd.DataFrame({"_p": frame["_p"], "_r": replies})

    replies = cut(asked.mapInPandas(run, "_p string, _r string"))
    if usage is not None:
        n, tokens = replies.agg(F.count("*"), F.coalesce(F.sum(estimated_tokens(F.col("_p")) + estimated_tokens(F.col("_r"))), F.lit(0))).first()
        usage.add(stage, n, tokens, rows)
    return rows.join(replies.select(F.col("_p").alias(prompt), F.col("_r").alias(out)), prompt, "left")


def cached(rows: DataFrame, key: str, cache: DataFrame, out: str, call: Callable[[DataFrame], DataFrame], most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows with out, the cache with the new values): only rows whose key the cache lacks are passed to call.

    Values that call leaves null (it failed) aren't kept. The cache (key, out, and used, the number of
    the call that last used a value) holds at most ``most`` values; those unused for longest go first.
    """
    used = F.col("used") if "used" in cache.columns else F.lit(0)
    held = cache.select(key, out, used.cast("long").alias("used"))
    now = (held.agg(F.coalesce(F.max("used"), F.lit(0))).first()[0] or 0) + 1
    asked = rows.select(key).distinct()
    fresh = cut(call(rows.join(held.select(key), key, "left_anti").dropDuplicates([key])).select(key, out))
    touched = held.join(asked.withColumn("_t", F.lit(True)), key, "left").select(key, out, F.when(F.col("_t"), F.lit(now)).otherwise(F.col("used")).alias("used"))
    grown = touched.unionByName(fresh.where(F.col(out).isNotNull()).select(key, out, F.lit(now).cast("long").alias("used")))
    kept = cut(grown.orderBy(F.desc("used"), F.asc(key)).limit(most))
    return rows.join(held.select(key, out).unionByName(fresh), key, "left"), kept


def retrying(call: Callable[[], object], attempts: int = 3, base: float = 0.1, cap: float = 30.0, transient: Callable[[Exception], bool] = lambda _: True, jitter: bool = False, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; a transient failure is tried again after base seconds, doubled each time up to cap."""
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n == attempts - 1 or not transient(error):
                raise
            wait = min(cap, base * 2**n)
            sleep(wait / 2 + random.uniform(0, wait / 2) if jitter else wait)
    raise ValueError("attempts must be 1 or more")


def transient_http(error: Exception) -> bool:
    """Whether an HTTP failure may pass: a status of 5xx, 408 or 429, or a broken connection."""
    status = getattr(error, "code", None) or getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) if status is None else status >= 500 or status in (408, 429)


def rate_limited(error: Exception) -> bool:
    return (getattr(error, "code", None) or getattr(error, "status", None)) == 429 or "rate limit" in str(error).lower()
