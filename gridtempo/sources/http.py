"""Driver-side fetching: JSON with backoff, files once. Nothing here runs on executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from pathlib import Path

TRIES = 4


def get_json(url: str, params: dict | None = None, tries: int = TRIES, pause=time.sleep) -> dict:
    """A payload, after up to ``tries`` attempts 1, 2, 4... seconds apart."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for k in range(tries):
        try:
            with urllib.request.urlopen(full, timeout=60) as r:
                return json.load(r)
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
            if k == tries - 1:
                raise
            pause(2**k)
    raise AssertionError


def fetch(url: str, path: str | Path) -> Path:
    """The file at ``url``, unless there is already one that isn't empty. A broken download leaves nothing under its name."""
    path = Path(path)
    if path.exists() and path.stat().st_size:
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    with urllib.request.urlopen(url, timeout=300) as r, part.open("wb") as f:
        while block := r.read(1 << 20):
            f.write(block)
    part.rename(path)
    return path


def fetch_all(base: str, names: list[str], available: list[str] | None, folder: str | Path) -> list[Path]:
    """All files by name; those no longer on offer are an error before anything is fetched."""
    if available is not None and (gone := sorted(set(names) - set(available))):
        raise LookupError(f"no longer available: {', '.join(gone)}")
    return [fetch(f"{base.rstrip('/')}/{n}", Path(folder) / n) for n in names]
