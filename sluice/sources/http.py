"""Request policy for sources: https only, throttle, retry, and what replies mean. The transport is given."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from ..functions.text import BLOCK_MARKERS

#: Fixed values.
ATTEMPTS, BACKOFF_MS, TIMEOUT_S = 3, 500, 15.0


class SourceError(Exception):
    """terminates_run: whether the scan ends."""

    terminates_run = True


class ItemError(SourceError):
    terminates_run = False


class AccessDenied(SourceError): ...


class RateLimited(SourceError): ...


class Unavailable(SourceError): ...


class ProtocolError(SourceError): ...


class Blocked(SourceError): ...


@dataclass
class Reply:
    status: int
    content_type: str = "application/json"
    body: str = ""
    headers: dict = field(default_factory=dict)


def interval_ms(rps: float) -> int:
    return math.ceil(1000 / rps) if rps > 0 else 0


def backoff_ms(attempt: int, jitter: float = 0.0) -> int:
    """Before attempt + 1; jitter from 0 to 1."""
    return BACKOFF_MS * 2 ** (attempt - 1) + math.floor(jitter * BACKOFF_MS)


class RateLimiter:
    """Least interval between requests of a key."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.free = clock, sleep, {}

    def acquire(self, key: str, rps: float) -> None:
        now = self.clock()
        at = max(now, self.free.get(key, now))
        self.free[key] = at + interval_ms(rps) / 1000
        if at > now:
            self.sleep(at - now)


def classify(reply: Reply) -> type[SourceError] | None:
    """The error that a reply is, or None."""
    if reply.status in (401, 403):
        return AccessDenied
    if reply.status == 429:
        return RateLimited
    if reply.status >= 500:
        return Unavailable
    if not 200 <= reply.status < 300:
        return ProtocolError
    kind = reply.content_type.lower()
    if "html" in kind and any(m in reply.body[:4096].lower() for m in BLOCK_MARKERS):
        return Blocked
    return None if "json" in kind else ProtocolError


def fetch_json(url: str, transport: Callable[[str, float], Reply], key: str = "", rps: float = 0, limiter: RateLimiter | None = None, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random):
    """The JSON behind an https address; server and network errors are tried ATTEMPTS times, nothing else is."""
    if urlsplit(url).scheme != "https":
        raise ProtocolError(f"{url}: https only")
    for attempt in range(1, ATTEMPTS + 1):
        if limiter:
            limiter.acquire(key, rps)
        try:
            reply = transport(url, TIMEOUT_S)
        except OSError as e:
            problem: SourceError = Unavailable(str(e))
        else:
            error = classify(reply)
            if error is None:
                try:
                    return json.loads(reply.body)
                except ValueError as e:
                    raise ProtocolError(f"{url}: {e}") from e
            problem = error(f"{url}: {reply.status}")
            if error is not Unavailable:
                raise problem
        if attempt < ATTEMPTS:
            sleep(backoff_ms(attempt, rng()) / 1000)
    raise problem
