"""Helpers around calls to outside language models. The calls themselves are the caller's; none is made by default."""

from __future__ import annotations

import hmac
import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from .config import Auth, RateLimit
from .streaming.limiter import fold

RETRYABLE = ("timeout", "timed out", "connection", "rate limit", "429", "500", "502", "503", "504")


def with_retry(call: Callable[[str], str], prompt: str, retries: int = 3, delay_ms: int = 1000, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer, or after the last try the error, as a text that starts with ERROR. The delay doubles each time."""
    answer = ""
    for n in range(retries + 1):
        try:
            answer = call(prompt)
        except Exception as e:  # noqa: BLE001 - the call is the caller's
            answer = f"ERROR: {e}"
        if not answer.startswith("ERROR") or not any(x in answer.lower() for x in RETRYABLE):
            return answer
        if n < retries:
            sleep(delay_ms * 2**n / 1000)
    return answer


def fan_out(call: Callable[[str], str], prompts: list[str], width: int = 8) -> list[str]:
    """Answers in the order of the prompts, `width` calls at a time; one that fails is an empty text."""

    def one(p: str) -> str:
        try:
            return call(p)
        except Exception:  # noqa: BLE001
            return ""

    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(one, prompts))


def sse_tokens(lines: Iterable[bytes]) -> Iterator[str]:
    """The pieces of text of a server-sent-event stream of chat completions, up to [DONE]; lines may be cut anywhere."""
    rest = b""
    for part in lines:
        rest += part
        *whole, rest = rest.split(b"\n")
        for line in whole:
            line = line.strip()
            if not line.startswith(b"data:"):
                continue
            data = line[5:].strip()
            if data == b"[DONE]":
                return
            try:
                piece = json.loads(data)["choices"][0]["delta"].get("content")
            except (ValueError, KeyError, IndexError, AttributeError):
                continue
            if piece:
                yield piece


def sse_events(hits: list[dict], tokens: Iterable[str]) -> Iterator[str]:
    """The events of a streamed answer: search, one for each token, done with the whole text."""
    yield f"event: search\ndata: {json.dumps({'results': hits})}\n\n"
    text = ""
    for t in tokens:
        text += t
        yield f"event: token\ndata: {json.dumps({'token': t})}\n\n"
    yield f"event: done\ndata: {json.dumps({'answer': text})}\n\n"


def judge_or_found(call: Callable[[str], str], prompt: str) -> str:
    try:
        return call(prompt) or "FOUND"
    except Exception:  # noqa: BLE001
        return "FOUND"


class Admission:
    """Which requests are let in: those with the key, if one is asked for, and as many of a client as its bucket of tokens holds."""

    OPEN = frozenset(["/health"])

    def __init__(self, auth: Auth, rate: RateLimit):
        self.auth, self.rate = auth, rate
        self.buckets: dict[str, tuple[float, float]] = {}

    def admit(self, client: str, path: str, key: str, now: float) -> int:
        if path in self.OPEN:
            return 200
        if self.auth.enabled and not hmac.compare_digest(key.removeprefix("Bearer ").encode(), self.auth.api_key.encode()):
            return 401
        if self.rate.enabled:
            allowed, tokens, last = fold(np.array([now]), float(self.rate.requests_per_minute), *self.buckets.get(client, (None, None)))
            self.buckets[client] = (tokens, last)
            if not allowed[0]:
                return 429
        return 200
