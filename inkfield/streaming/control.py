"""Control of running work: one active query per checkpoint, stop on demand or after a time, time limits of outer programs."""

from __future__ import annotations

import os
import signal
import subprocess
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

_lock = threading.Lock()
_active: dict[str, StreamingQuery] = {}


def start_once(checkpoint: str, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query unless one of this process is active on the checkpoint; then RuntimeError is raised."""
    with _lock:
        if (old := _active.get(checkpoint)) is not None and old.isActive:
            raise RuntimeError(f"a query is active on {checkpoint}")
        _active[checkpoint] = query = start()
    return query


def run_for(query: StreamingQuery, seconds: float, stop: threading.Event | None = None, step: float = 0.2) -> bool:
    """Waits for a query to end, at most so long or until `stop` is set, and then stops it. Whether it ended by itself."""
    waited = 0.0
    while waited < seconds and not (stop is not None and stop.is_set()):
        if query.awaitTermination(min(step, seconds - waited)):
            return True
        waited += step
    query.stop()
    return False


def stop_all(spark: SparkSession) -> int:
    """Stops the session's active queries; how many there were."""
    queries = spark.streams.active
    for query in queries:
        query.stop()
    return len(queries)


def run_limited(command: list[str], seconds: float, given: bytes = b"") -> tuple[int | None, bytes]:
    """(status, output) of an outer program that gets `given` on its input. After `seconds` it and all that it started are killed,
    and the status is None. For use inside tasks, where a hanging program would hold a core."""
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, start_new_session=True) as process:
        try:
            output, _ = process.communicate(given, timeout=seconds)
            return process.returncode, output
        except subprocess.TimeoutExpired:
            os.killpg(process.pid, signal.SIGKILL)
            output, _ = process.communicate()
            return None, output
