"""The line annotator: an outside service behind a small interface.

A provider is built once per Python worker by a factory and answers one prompt
at a time. Spark decides how many workers call at once: one per task, so the
number of partitions bounds the request rate.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[str], str]

# Retry policy and request limits.
MAX_ATTEMPTS = 3
BACKOFF_SECONDS = 2.0
PAUSE_SECONDS = 0.5
TIMEOUT_SECONDS = 120
MAX_TOKENS = 4096
FATAL_CODES = {401, 402, 403, "insufficient_credits"}


class FatalAnnotatorError(Exception):
    """No credit or no access: going on is pointless, the job stops."""


def ask(provider: Provider, prompt: str, attempts: int = MAX_ATTEMPTS, backoff: float = BACKOFF_SECONDS,
        sleep: Callable[[float], None] = time.sleep) -> str | None:
    """One answer, with waits of ``backoff``, twice that, ... between attempts; null when all fail."""
    for attempt in range(attempts):
        try:
            answer = provider(prompt)
            if not answer or not answer.strip():
                raise ValueError("empty answer")
            return answer
        except FatalAnnotatorError:
            raise
        except Exception:
            if attempt + 1 < attempts:
                sleep(backoff * 2**attempt)
    return None


def annotator_udf(factory: Callable[[], Provider], pause: float = 0.0,
                  backoff: float = BACKOFF_SECONDS) -> Callable[[Column], Column]:
    """Column function from an array of prompts to the array of answers.

    Only the prompts travel to Python. The function is marked as not
    deterministic, so the optimizer never evaluates it twice.
    """

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for prompts in batches:
            out = []
            for row in prompts:
                got = []
                for prompt in row if row is not None else []:
                    got.append(ask(provider, prompt, backoff=backoff))
                    if pause:
                        time.sleep(pause)
                out.append(got)
            yield pd.Series(out, dtype=object)

    # Spark tells the kind of a pandas function by its annotations.
    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(answers, "array<string>").asNondeterministic()


@dataclass(frozen=True)
class ChatCompletions:
    """Factory of a provider that posts prompts to a chat-completion endpoint."""

    endpoint: str
    model: str
    api_key: str
    system_prompt: str
    open_url: Callable = urllib.request.urlopen

    def __call__(self) -> Provider:
        return self.complete

    def complete(self, prompt: str) -> str:
        body = {
            "model": self.model,
            "messages": [
                {"role": "system", "content": self.system_prompt},
                {"role": "user", "content": prompt},
            ],
            "temperature": 0,
            "max_tokens": MAX_TOKENS,
        }
        request = urllib.request.Request(
            self.endpoint,
            data=json.dumps(body).encode(),
            headers={"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"},
        )
        try:
            with self.open_url(request, timeout=TIMEOUT_SECONDS) as reply:
                data = json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code in FATAL_CODES:
                raise FatalAnnotatorError(f"HTTP {e.code}") from e
            raise
        if "error" in data:
            error = data["error"]
            if isinstance(error, dict) and error.get("code") in FATAL_CODES:
                raise FatalAnnotatorError(str(error))
            raise RuntimeError(str(error))
        return data["choices"][0]["message"]["content"]
