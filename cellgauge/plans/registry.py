"""A log of batch runs: one line of JSON per thing that happened, only ever appended.

What a run is follows from its lines, so nothing is read, changed and written back; runs
that write at the same time add their lines one after the other under a lock.
"""

from __future__ import annotations

import fcntl
import json
from collections.abc import Iterable
from dataclasses import asdict, is_dataclass
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any
from uuid import uuid4

RUNNING, COMPLETED, FAILED = "running", "completed", "failed"
STALE = timedelta(hours=24)


class RunLog:
    def __init__(self, path: str | Path, stale_after: timedelta = STALE):
        self.path, self.stale_after = Path(path), stale_after

    def append(self, run_id: str, event: str, **facts: Any) -> str:
        line = {"run_id": run_id, "event": event, "at": datetime.now(timezone.utc).isoformat()} | facts
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as log:
            fcntl.flock(log, fcntl.LOCK_EX)
            log.write(json.dumps(line, default=str) + "\n")
        return run_id

    def lines(self) -> list[str]:
        """The whole lines: none is read while it is being written."""
        if not self.path.exists():
            return []
        with self.path.open() as log:
            fcntl.flock(log, fcntl.LOCK_SH)
            return log.read().splitlines()

    def runs(self) -> list[dict[str, Any]]:
        """Every run in the order of starts, as its lines leave it; one that never ended counts as failed once it is stale."""
        found: dict[str, dict[str, Any]] = {}
        for text in self.lines():
            line = json.loads(text)
            event, at = line.pop("event"), line.pop("at")
            run = found.setdefault(line["run_id"], {"stages": {}, "error_message": None, "completed_at": None, "failed_at": None})
            if event == "stage":
                run["stages"][line["stage"]] = line["results"]
            else:
                run |= line | {"status": event, {RUNNING: "started_at"}.get(event, f"{event}_at"): at}
        edge = (datetime.now(timezone.utc) - self.stale_after).isoformat()
        for run in found.values():
            if run["status"] == RUNNING and run["started_at"] < edge:
                run |= {"status": FAILED, "error_message": "stale"}
        return list(found.values())

    def run(self, run_id: str) -> dict[str, Any]:
        return next(r for r in self.runs() if r["run_id"] == run_id)

    def finished(self, profile: str, batch_id: str) -> bool:
        return any(r["status"] == COMPLETED and r["profile"] == profile and r["batch_id"] == batch_id for r in self.runs())

    def begin(self, profile: str, batch_id: str) -> str:
        return self.append(str(uuid4()), RUNNING, profile=profile, batch_id=batch_id)

    def stage(self, run_id: str, name: str, results: Iterable[Any]) -> None:
        """A stage that is done; it stays on record whatever happens after it."""
        self.append(run_id, "stage", stage=name, results=plain(results))

    def end(self, run_id: str, error: Exception | None = None) -> dict[str, Any]:
        self.append(run_id, COMPLETED) if error is None else self.append(run_id, FAILED, error_message=str(error))
        return self.run(run_id)


def plain(results: Iterable[Any]) -> list[dict[str, Any]]:
    """Results of a stage as JSON can hold them."""
    return [asdict(r) if is_dataclass(r) else {"value": str(r)} for r in results]
