"""Wall and CPU seconds of a driver block, and a JSON sidecar of them."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass
class Timing:
    name: str
    wall: float = 0.0
    cpu: float = 0.0


@contextmanager
def timed(name: str) -> Iterator[Timing]:
    out, wall, cpu = Timing(name), time.perf_counter(), time.process_time()
    try:
        yield out
    finally:
        out.wall, out.cpu = time.perf_counter() - wall, time.process_time() - cpu


def save(timings: list[Timing], path: str | Path) -> None:
    Path(path).write_text(json.dumps([asdict(t) for t in timings], indent=1))
