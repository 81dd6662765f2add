"""Calls to a language model from inside a job: once for each distinct prompt, with retries, by an injected transport."""

from __future__ import annotations

import http.client
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import request_body

# Bounds of waiting and trying.
MOST_TRIES, LONGEST_RETRY_AFTER, LONGEST_BACKOFF, LONGEST_WAIT = 8, 120.0, 90.0, 8.0


class ModelError(RuntimeError):
    """The model could not be asked, or gave no answer. The text never holds an address or a key."""


@dataclass
class Response:
    status: int
    body: str
    retry_after: str | None = None


#: payload -> response; raises OSError where no response comes.
Transport = Callable[[bytes], Response]


def http_transport(url: str, key_variable: str, timeout: float = Settings.llm_timeout_seconds) -> Transport:
    """A transport that posts to ``url`` with the key found in the environment of the worker."""

    def send(payload: bytes) -> Response:
        key = os.environ.get(key_variable, "").strip()
        if not key:
            raise ModelError("no key")
        request = urllib.request.Request(url, payload, {"Content-Type": "application/json", "x-goog-api-key": key})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return Response(r.status, r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read().decode("utf-8", "replace"), e.headers.get("Retry-After"))

    return send


def wait_before(attempt: int, tries: int, response: Response | None, base_429: float = 10.0) -> float:
    """Seconds to wait after a failed ``attempt`` (from 1): none after the last; what the server asks for, or growing waits."""
    if attempt >= tries:
        return 0.0
    if response is not None and response.status == 429:
        try:
            asked = float(response.retry_after) if response.retry_after else 0.0
        except ValueError:
            asked = 0.0
        return min(asked, LONGEST_RETRY_AFTER) if asked > 0 else min(base_429 * attempt, LONGEST_BACKOFF)
    return min(2.0 ** (attempt - 1), LONGEST_WAIT)


def ask(prompt: str | None, transport: Transport, tries: int = 5, sleep: Callable[[float], None] = time.sleep, base_429: float = 10.0) -> str:
    """The answer's text. Every HTTP error, empty answer and lost connection is tried again."""
    if not prompt or not prompt.strip():
        raise ModelError("empty prompt")
    tries = min(max(1, tries), MOST_TRIES)
    last = "no attempt"
    for attempt in range(1, tries + 1):
        response = None
        try:
            response = transport(request_body(prompt))
            if response.status < 400:
                if text := answer_text(response.body):
                    return text
                last = "empty answer"
            else:
                last = f"HTTP {response.status}: " + " ".join(response.body[:300].split())
        except (OSError, http.client.HTTPException) as e:  # the second where a body is cut off
            last = type(e).__name__
        if pause := wait_before(attempt, tries, response, base_429):
            sleep(pause)
    raise ModelError(last)


def answer_text(body: str) -> str:
    try:
        return str(json.loads(body)["candidates"][0]["content"]["parts"][0]["text"] or "").strip()
    except (ValueError, KeyError, IndexError, TypeError):
        return ""


def ask_all(prompts: DataFrame, transport: Callable[[], Transport], key: str = "doc_id", prompt: str = "prompt", settings: Settings = Settings(), parallel: int = 8) -> DataFrame:
    """``key, raw, error``: the answer to each prompt. Equal prompts are asked once; ``parallel`` partitions bound the calls at a time.

    A failure is a null ``raw`` with its ``error``; it fails no task. Null and blank prompts give an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = transport()
        for b in batches:
            for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    raw, error = ask(p, send, settings.llm_max_retries, base_429=settings.llm_429_backoff_seconds), None
                except ModelError as e:
                    raw, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.string()), pa.array([raw], pa.string()), pa.array([error], pa.string())], names=["h", "raw", "error"])

    own = prompts.select(key, F.coalesce(F.col(prompt), F.lit("")).alias("p")).withColumn("h", F.sha2("p", 256))
    answers = own.groupBy("h").agg(F.first("p").alias("p")).repartition(parallel).select("p", "h").mapInArrow(run, "h string, raw string, error string")
    return own.drop("p").join(answers, "h").select(key, "raw", "error")
