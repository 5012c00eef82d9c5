"""Deferred runs: requests as files in a folder, claimed by renaming, so several workers can share it."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any


def submit(root: str, run_id: str, config: dict[str, Any], mode: str = "worker_pool") -> Path:
    """Writes a request for a run: queued/ for workers, requests/ for batches."""
    folders = {"worker_pool": ("queued", "claimed", "done"), "batch": ("requests", "completed")}
    if mode not in folders:
        raise ValueError(f"unknown mode: {mode}")
    for name in folders[mode]:
        (Path(root) / name).mkdir(parents=True, exist_ok=True)
    request = Path(root) / folders[mode][0] / f"{run_id}.json"
    request.write_text(json.dumps({"run_id": run_id, "mode": mode, "config": config}, indent=2, sort_keys=True))
    return request


def work_once(root: str, run: Callable[[dict[str, Any]], Any]) -> Any:
    """Claims the first request by name and runs it; None if none is queued. A request that fails stays claimed."""
    for request in sorted((Path(root) / "queued").glob("*.json")):
        claimed = Path(root) / "claimed" / request.name
        try:
            request.rename(claimed)
        except FileNotFoundError:  # another worker was faster
            continue
        result = run(json.loads(claimed.read_text()))
        claimed.rename(Path(root) / "done" / request.name)
        return result
    return None


def batch(request: str, run: Callable[[dict[str, Any]], Any]) -> Any:
    """Runs one batch request and moves it to completed/."""
    path = Path(request)
    result = run(json.loads(path.read_text()))
    path.rename(path.parent.parent / "completed" / path.name)
    return result


def requeue(root: str) -> int:
    """Puts claimed requests back, for a worker that was lost; returns how many."""
    claimed = sorted((Path(root) / "claimed").glob("*.json"))
    for request in claimed:
        request.rename(Path(root) / "queued" / request.name)
    return len(claimed)
