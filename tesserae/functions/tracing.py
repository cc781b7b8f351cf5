"""Spans around model calls and pipeline runs, kept in memory or handed to an exporter."""

from __future__ import annotations

import random
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Span:
    name: str
    trace_id: str
    parent: str | None
    span_id: str
    began: float
    seconds: float = 0.0
    error: str | None = None
    attributes: dict = field(default_factory=dict)


class Tracer:
    """Takes a share ``ratio`` of traces whole. Ended spans go to ``export``; the last 1000 stay."""

    def __init__(self, ratio: float = 1.0, export: Callable[[Span], None] | None = None) -> None:
        self.ratio, self.export = ratio, export
        self.ended: deque[Span] = deque(maxlen=1000)
        self._open: list[Span | None] = []

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[Span | None]:
        up = self._open[-1] if self._open else None
        taken = up is not None if self._open else random.random() < self.ratio
        s = Span(name, up.trace_id if up else uuid.uuid4().hex, up.span_id if up else None, uuid.uuid4().hex[:16], time.time(), attributes=attributes) if taken else None
        self._open.append(s)
        try:
            yield s
        except Exception as e:
            if s:
                s.error = repr(e)
            raise
        finally:
            self._open.pop()
            if s:
                s.seconds = time.time() - s.began
                self.ended.append(s)
                if self.export:
                    self.export(s)


TRACER = Tracer(ratio=0.0)


def span(name: str, **attributes):
    return TRACER.span(name, **attributes)
