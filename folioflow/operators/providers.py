"""The seam for external models: deterministic before and after, pluggable between."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class QuotaExhausted(Exception):
    """No further call will succeed: the job ends."""


def backoff(attempt: int, most: int = 60) -> int:
    """Seconds to wait after a failed attempt."""
    return min(2**attempt, most)


def is_rate_limit(message: str) -> bool:
    return any(x in message.lower() for x in ("429", "resource_exhausted", "rate limit", "quota"))


def first_that_works(models: list[str], call: Callable[[str, str], str], prompt: str, attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(model, answer) of the first model that answers, each tried some times; exhausted quota ends all."""
    last: Exception | None = None
    for m in models:
        for n in range(1, attempts + 1):
            try:
                return m, call(m, prompt)
            except QuotaExhausted:
                raise
            except Exception as e:  # a provider may fail in any way
                last = e
                if n < attempts:
                    wait(backoff(n))
    raise RuntimeError("no model answered") from last


def offline(model: str, prompt: str) -> str:
    """The stand-in without a network: nothing to add."""
    return "[]"


def ask(df: DataFrame, prompt_col: str, models: list[str], call: Callable[[str, str], str] = offline) -> DataFrame:
    """Adds model, answer and error: a row that fails doesn't fail the job."""
    schema = f"{df._jdf.schema().toDDL()}, model string, answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for p in f[prompt_col]:
                try:
                    got.append((*first_that_works(models, call, p), None))
                except QuotaExhausted:
                    raise
                except Exception as e:
                    got.append((None, None, str(e)))
            f["model"], f["answer"], f["error"] = zip(*got, strict=True) if got else ([], [], [])
            yield f

    return df.mapInPandas(run, schema)
