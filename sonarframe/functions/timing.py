"""How long a call or a query takes."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery


def benchmark(f: Callable) -> Callable:
    """f with its wall time logged."""

    @functools.wraps(f)
    def timed(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            logging.getLogger(f.__module__).info("%s took %.3f s", f.__qualname__, time.perf_counter() - began)

    return timed


def batch_seconds(query: StreamingQuery) -> list[dict]:
    """Rows and seconds of the recent batches of a streaming query, in total and by phase."""
    out = []
    for p in query.recentProgress:
        phases = {k: v / 1000 for k, v in (p["durationMs"] or {}).items()}
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": phases.get("triggerExecution", 0.0), "phases": phases})
    return out
