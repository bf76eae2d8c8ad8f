"""Decorators, caches and small helpers for driver code."""

from __future__ import annotations

import functools
import itertools
import logging
import random
import resource
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

_LOG = logging.getLogger("tabulon")


def retry(max_tries: int = 3, backoff: float = 1, exponential: bool = False, cap: float = 60, exceptions: tuple = (Exception,), jitter: bool = False, callback: Callable | None = None):
    """Calls again after these exceptions, waiting longer each time if exponential; the last one is raised."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            wait = backoff
            for k in itertools.count(1):
                try:
                    return f(*args, **kwargs)
                except exceptions as e:
                    if k >= max_tries:
                        raise
                    if callback:
                        callback(e, k)
                    time.sleep(min(cap, wait) * (random.random() if jitter else 1))
                    wait *= 2 if exponential else 1

        return run

    return wrap


def timed(f):
    """Logs how long a call takes."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            _LOG.info("%s took %.6f s", f.__name__, time.perf_counter() - began)

    return run


def log(f):
    """Logs calls and results."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        _LOG.info("%s called", f.__name__)
        out = f(*args, **kwargs)
        _LOG.info("%s returned %r", f.__name__, out)
        return out

    return run


def repeat(times: int):
    """Calls so often; the last result counts."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            out = None
            for _ in range(times):
                out = f(*args, **kwargs)
            return out

        return run

    return wrap


def counter(f):
    """Keeps calls, fastest and slowest in `stats`."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        out = f(*args, **kwargs)
        took = time.perf_counter() - began
        s = run.stats
        s["calls"] += 1
        s["fastest"] = took if s["fastest"] is None else min(took, s["fastest"])
        s["slowest"] = took if s["slowest"] is None else max(took, s["slowest"])
        return out

    run.stats = {"calls": 0, "fastest": None, "slowest": None}
    return run


def throttle(calls_per_second: float):
    """Waits so that calls don't come faster."""

    def wrap(f):
        lock, last = threading.Lock(), [0.0]

        @functools.wraps(f)
        def run(*args, **kwargs):
            with lock:
                time.sleep(max(0.0, last[0] + 1 / calls_per_second - time.monotonic()))
                last[0] = time.monotonic()
            return f(*args, **kwargs)

        return run

    return wrap


def monitor(f):
    """Logs time and the process's peak memory."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        out = f(*args, **kwargs)
        _LOG.info("%s: %.3f s, peak %d kB", f.__name__, time.perf_counter() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
        return out

    return run


def single_item_cache(f):
    """Keeps the result of the last arguments only."""
    held: list = []

    @functools.wraps(f)
    def run(*args, **kwargs):
        key = (args, tuple(sorted(kwargs.items())))
        if not held or held[0] != key:
            held[:] = [key, f(*args, **kwargs)]
        return held[1]

    run.cache_clear = held.clear
    return run


def lru_cache_with_expiry(max_size: int = 128, valid_for_seconds: float = 3600):
    """Keeps recent results for a while."""

    def wrap(f):
        held: OrderedDict = OrderedDict()

        @functools.wraps(f)
        def run(*args, **kwargs):
            key, now = (args, tuple(sorted(kwargs.items()))), time.monotonic()
            if key in held and now - held[key][0] <= valid_for_seconds:
                held.move_to_end(key)
                return held[key][1]
            out = f(*args, **kwargs)
            held[key] = (now, out)
            held.move_to_end(key)
            while len(held) > max_size:
                held.popitem(last=False)
            return out

        run.cache_clear = held.clear
        return run

    return wrap


def islice(rows: Iterable, size: int) -> Iterator:
    return itertools.islice(rows, size)


def random_int() -> int:
    return random.getrandbits(32)


def random_string(width: int = 16) -> str:
    return "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=width))
