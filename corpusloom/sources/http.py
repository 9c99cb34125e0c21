"""A polite HTTP client: a shared rate, retries with growing pauses, and a server's wish to wait."""

from __future__ import annotations

import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

AGAIN = frozenset({429, 500, 502, 503, 504})


class Limiter:
    """A gate that lets one caller through at a time, at most ``rate`` a second; a penalty shuts it for all."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0:
            raise ValueError("the rate must be positive")
        self.rate, self.clock, self.sleep, self.gate = rate, clock, sleep, threading.Lock()
        self.opens: dict[str, float] = {}

    def wait(self) -> None:
        with self.gate:  # whoever waits holds the gate, and looks again for penalties that came meanwhile
            while (left := max(self.opens.values(), default=0.0) - self.clock()) > 1e-9:
                self.sleep(left)
            self.opens["pace"] = self.clock() + 1 / self.rate

    def penalise(self, seconds: float) -> None:
        self.opens["penalty"] = max(self.opens.get("penalty", 0.0), self.clock() + seconds)


def _open(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Client:
    def __init__(self, agent: str, rate: float = 8, tries: int = 5, base: float = 1.0, timeout: float = 30, opener=_open, limiter: Limiter | None = None) -> None:
        self.headers, self.tries, self.base, self.timeout, self.opener = {"User-Agent": agent}, tries, base, timeout, opener
        self.limiter = limiter or Limiter(rate)
        self.requests = 0

    def get(self, url: str) -> str:
        """The body as text."""
        return self.fetch(url)[1].decode("utf-8", "replace")

    def fetch(self, url: str) -> tuple[str, bytes]:
        """Content type and body; errors that pass are tried again, others raise at once."""
        for attempt in range(self.tries):
            self.limiter.wait()
            self.requests += 1
            status, headers, body = self.opener(url, self.headers, self.timeout)
            told = {k.lower(): v for k, v in headers.items()}
            if status < 400:
                return told.get("content-type", ""), body
            if status not in AGAIN or attempt == self.tries - 1:
                raise OSError(f"{url}: status {status} after {attempt + 1} tries")
            wish = told.get("retry-after", "")
            pause = float(wish) if wish.isdigit() else self.base * 2**attempt * (1 + random.random() / 4)
            self.limiter.penalise(pause) if status == 429 else self.limiter.sleep(pause)
        raise OSError(url)
