"""One HTTP request, and retries with growing delays; ``remote`` sends them from tasks."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from email.message import Message

RETRY_STATUS = (429, 500, 502, 503, 504)


@dataclass
class Response:
    status: int
    body: bytes
    headers: Message | dict


@dataclass
class Retry:
    attempts: int = 15
    base: float = 0.5
    most: float = 30.0
    jitter: float = 0.25
    sleep: Callable[[float], None] = time.sleep
    on_retry: Callable[[int, float], None] | None = None

    def delay(self, attempt: int, retry_after: str | None = None) -> float:
        """Seconds before attempt + 1: a whole Retry-After up to the maximum, else doubling with jitter."""
        if retry_after and retry_after.strip().isdigit() and int(retry_after) <= self.most:
            return float(retry_after)
        wait = min(self.base * 2 ** (attempt - 1), self.most)
        return wait * (1 + random.uniform(-self.jitter, self.jitter))

    def run(self, send: Callable[[], Response]) -> Response:
        """A response of another status comes back as it is; the last failure is raised."""
        for attempt in range(1, self.attempts + 1):
            after, failed = None, None
            try:
                response = send()
                if response.status not in RETRY_STATUS:
                    return response
                failed, after = OSError(f"status {response.status}"), response.headers.get("Retry-After")
            except OSError as e:
                failed = e
            if attempt == self.attempts:
                raise failed
            wait = self.delay(attempt, after)
            if self.on_retry:
                self.on_retry(attempt, wait)
            self.sleep(wait)
        raise ValueError("attempts must be 1 or more")


def get(url: str, timeout: float = 30, opener: Callable | None = None) -> Response:
    open_url = opener or urllib.request.urlopen
    try:
        with open_url(url, timeout=timeout) as r:
            return Response(r.status, r.read(), r.headers)
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read(), e.headers)
