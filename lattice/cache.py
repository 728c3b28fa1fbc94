"""Results kept for a while, as many as fit."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable


def key_of(path: str, options: dict) -> str:
    """Of what decides a result: not of a time limit or of kept state."""
    own = {k: v for k, v in sorted(options.items()) if k not in ("timeout", "state") and v not in (None, [], "", 0, False)}
    return hashlib.sha256(f"{path}|{json.dumps(own)}".encode()).hexdigest()[:32]


class Cache:
    """At most size values, each for seconds after it was put there. A full cache lets the one go that would end first."""

    def __init__(self, seconds: float = 300, size: int = 10, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.size, self.clock = seconds, size, clock
        self.held: dict[str, tuple[float, object]] = {}
        self.lock = threading.Lock()

    def _drop_ended(self) -> None:
        now = self.clock()
        for key in [k for k, (end, _) in self.held.items() if end < now]:
            del self.held[key]

    def get(self, key: str):
        with self.lock:
            self._drop_ended()
            return self.held[key][1] if key in self.held else None

    def put(self, key: str, value) -> None:
        with self.lock:
            self._drop_ended()
            self.held.pop(key, None)
            if len(self.held) >= self.size:
                del self.held[min(self.held, key=lambda k: self.held[k][0])]
            self.held[key] = (self.clock() + self.seconds, value)

    def forget(self, key: str | None = None) -> None:
        with self.lock:
            if key is None:
                self.held.clear()
            else:
                self.held.pop(key, None)

    def __len__(self) -> int:
        return len(self.held)
