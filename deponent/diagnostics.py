"""JSON lines about the stages that a caller runs: ids, outcome and duration, never content."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

#: Outcomes of a stage.
OUTCOMES = ("started", "completed", "completed_with_warnings", "failed")


def event_line(stage: str, correlation_id: str, outcome: str, duration_ms: int | None = None, target_id: str | None = None, failure_kind: str | None = None) -> str:
    """One event as a JSON line; there is no field that content could go to."""
    if outcome not in OUTCOMES:
        raise ValueError(f"{outcome} is no outcome")
    return json.dumps({"event": "pipeline_stage", "correlation_id": correlation_id, "stage": stage, "outcome": outcome, "occurred_at": int(1000 * time.time()), "duration_ms": duration_ms, "target_id": target_id, "failure_kind": failure_kind})


def _to_stderr(line: str) -> None:
    print(line, file=sys.stderr)


@contextmanager
def stage(name: str, correlation_id: str, target_id: str | None = None, emit: Callable[[str], None] = _to_stderr) -> Iterator[list[str]]:
    """Tell when a stage starts and how it ends; what is put into the list that it gives are warnings, of
    which only that there are any is told. An exception passes on; its kind is told, its message isn't."""
    began, warnings = time.monotonic(), []
    taken = lambda: int(1000 * (time.monotonic() - began))
    emit(event_line(name, correlation_id, "started", target_id=target_id))
    try:
        yield warnings
    except Exception as e:
        emit(event_line(name, correlation_id, "failed", taken(), target_id, type(e).__name__))
        raise
    emit(event_line(name, correlation_id, "completed_with_warnings" if warnings else "completed", taken(), target_id))
