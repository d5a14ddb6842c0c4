"""Limits on the work that one file may take in a Python worker: processor time, elapsed time, memory."""

from __future__ import annotations

import os
import resource
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

# Fixed values.
CPU_SECONDS, SECONDS, BYTES = 45, 600, 2 << 30
#: Kinds of files that are read under limits.
LIMITED = ("pdf", "doc", "spreadsheet")


class TookTooLong(BaseException):
    """Raised by a timer; no ``except Exception`` of a reader swallows it."""


def _stop(*_) -> None:
    raise TookTooLong


@contextmanager
def limited(cpu: float = CPU_SECONDS, wall: float = SECONDS, memory: int = BYTES) -> Iterator[None]:
    """Work within these limits: beyond a time it raises ``TookTooLong``, beyond the memory on top of what is held now ``MemoryError``.

    Timers need the main thread, where Spark's workers run their functions; elsewhere only memory is limited.
    """
    timers = ((signal.SIGPROF, signal.ITIMER_PROF, cpu), (signal.SIGALRM, signal.ITIMER_REAL, wall)) if threading.current_thread() is threading.main_thread() else ()
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    with open("/proc/self/statm") as f:
        most = int(f.read().split()[0]) * os.sysconf("SC_PAGE_SIZE") + memory
    former = [signal.signal(s, _stop) for s, *_ in timers]
    try:
        for _, timer, seconds in timers:
            signal.setitimer(timer, seconds)
        if all(x in (resource.RLIM_INFINITY,) or x > most for x in (soft, hard)):
            resource.setrlimit(resource.RLIMIT_AS, (most, hard))
        yield
    finally:
        for (_, timer, _), _ in zip(timers, former):
            signal.setitimer(timer, 0)
        for (s, *_), old in zip(timers, former):
            signal.signal(s, old)
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))
