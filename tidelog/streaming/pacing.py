"""Delivering events at the pace of their own time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from tidelog.plans.config import Clock
from tidelog.sources.bundle import BundleError


def resolve_clock(config: Clock | None, speed: float | None = None, idle_cap: float | None = None, fast: bool = False) -> Clock:
    """The arguments before the configuration; without either as fast as possible."""
    if fast and (speed is not None or idle_cap is not None):
        raise BundleError("clock", "fast takes no speed and no idle cap")
    if fast or (config is None and speed is None and idle_cap is None):
        return Clock("fast")
    base = config if config and config.mode == "realtime" else Clock("realtime")
    return Clock("realtime", speed or base.speed or 1.0, idle_cap or base.idle_cap_seconds)


def paced(events: Iterable[tuple[int, str]], clock: Clock, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> Iterator[str]:
    """Lines at their due moments. Pauses longer than the idle cap are cut to it; delays don't add up, as every moment is counted from the start."""
    due, last, start = 0.0, None, now()
    for ns, line in events:
        if clock.mode == "realtime":
            gap = 0.0 if last is None else max(0, ns - last) / 1e9 / clock.speed
            due += min(gap, clock.idle_cap_seconds) if clock.idle_cap_seconds else gap
            last = ns if last is None else max(last, ns)
            if (wait := start + due - now()) > 0:
                sleep(wait)
        yield line
