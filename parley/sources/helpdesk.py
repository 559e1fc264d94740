"""A helpdesk over HTTP, a stand-in that records calls, and sinks that act on DataFrames."""

from __future__ import annotations

import json
import os
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame

RETRY = {429, 500, 502, 503, 504}


class Helpdesk(Protocol):
    def apply_tags(self, thread_id: str, tags: list[str]) -> bool: ...
    def start_sla(self, thread_id: str, minutes: int) -> bool: ...
    def assign(self, thread_id: str, agent: str) -> bool: ...
    def post_note(self, thread_id: str, text: str) -> bool: ...
    def lock_draft(self, thread_id: str, owner: str) -> bool: ...
    def unlock_draft(self, thread_id: str, owner: str) -> bool: ...


def send(method: str, url: str, body: dict[str, Any], headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], str]:
    """One HTTP request: (status, headers, text)."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""


@dataclass
class HttpHelpdesk:
    """Requests with retries: 429, 5xx and network errors after backoff * 2**attempt seconds, or after a
    numeric Retry-After; 409 and 423 are answers; other 4xx raise at once."""

    base_url: str
    key: str = ""
    timeout: float = 10.0
    retries: int = 3
    backoff: float = 0.5
    transport: Callable[..., tuple[int, dict[str, str], str]] = send
    sleep: Callable[[float], None] = time.sleep

    def call(self, method: str, path: str, body: dict[str, Any]) -> int:
        last: Exception | None = None
        for attempt in range(self.retries + 1):
            wait = self.backoff * 2**attempt
            try:
                status, headers, _ = self.transport(method, f"{self.base_url}{path}", body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
            except OSError as e:
                last = e
            else:
                if status < 400 or status in (409, 423):
                    return status
                last = RuntimeError(f"{method} {path}: status {status}")
                if status not in RETRY and status < 500:
                    raise last
                after = str(headers.get("Retry-After", ""))
                wait = float(after) if after.replace(".", "", 1).isdigit() else wait
            if attempt < self.retries:
                self.sleep(wait)
        raise last or RuntimeError("no attempt was made")

    def apply_tags(self, thread_id: str, tags: list[str]) -> bool:
        return self.call("POST", f"/conversations/{thread_id}/tags", {"tags": tags}) in (200, 201, 204, 409)

    def start_sla(self, thread_id: str, minutes: int) -> bool:
        return self.call("POST", f"/conversations/{thread_id}/sla", {"minutes": minutes}) < 400

    def assign(self, thread_id: str, agent: str) -> bool:
        return self.call("POST", f"/conversations/{thread_id}/assignee", {"agent": agent}) < 400

    def post_note(self, thread_id: str, text: str) -> bool:
        return self.call("POST", f"/conversations/{thread_id}/notes", {"text": text}) < 400

    def lock_draft(self, thread_id: str, owner: str) -> bool:
        return self.call("POST", f"/conversations/{thread_id}/lock", {"owner": owner}) < 400

    def unlock_draft(self, thread_id: str, owner: str) -> bool:
        return self.call("DELETE", f"/conversations/{thread_id}/lock", {"owner": owner}) < 400


@dataclass
class RecordingHelpdesk:
    """Remembers calls; fails those whose (operation, thread) are listed."""

    fail: set[tuple[str, str]] = field(default_factory=set)
    calls: list[tuple] = field(default_factory=list)

    def _do(self, name: str, thread_id: str, *args) -> bool:
        self.calls.append((name, thread_id, *args))
        return (name, thread_id) not in self.fail

    def apply_tags(self, thread_id: str, tags: list[str]) -> bool:
        return self._do("apply_tags", thread_id, tuple(tags))

    def start_sla(self, thread_id: str, minutes: int) -> bool:
        return self._do("start_sla", thread_id, minutes)

    def assign(self, thread_id: str, agent: str) -> bool:
        return self._do("assign", thread_id, agent)

    def post_note(self, thread_id: str, text: str) -> bool:
        return self._do("post_note", thread_id, text)

    def lock_draft(self, thread_id: str, owner: str) -> bool:
        return self._do("lock_draft", thread_id, owner)

    def unlock_draft(self, thread_id: str, owner: str) -> bool:
        return self._do("unlock_draft", thread_id, owner)


def triage(rows: Iterable[dict[str, Any]], desk: Helpdesk) -> list[dict[str, Any]]:
    """Tags and deadlines of rows (thread_id, tags, sla_minutes). Each is tried whatever becomes of the other."""
    out = []
    for r in rows:
        got: dict[str, Any] = {"thread_id": r["thread_id"], "errors": []}
        for name, act in (("tagged", lambda r=r: desk.apply_tags(r["thread_id"], list(r["tags"]))), ("sla_started", lambda r=r: desk.start_sla(r["thread_id"], r["sla_minutes"]))):
            try:
                got[name] = bool(act())
            except Exception as e:
                got[name] = False
                got["errors"].append(f"{name}: {e}")
        out.append(got)
    return out


def triage_sink(decisions: DataFrame, make: Callable[[], Helpdesk]) -> DataFrame:
    """Acts on decisions (thread_id, tags, sla_minutes), a client a partition: (thread_id, tagged, sla_started, errors)."""
    import pandas as pd

    def run(frames):
        desk = make()
        for f in frames:
            rows = triage(f.to_dict("records"), desk)
            yield pd.DataFrame(rows, columns=["thread_id", "tagged", "sla_started", "errors"])

    return decisions.select("thread_id", "tags", "sla_minutes").mapInPandas(run, "thread_id string, tagged boolean, sla_started boolean, errors array<string>")


class StateFile:
    """A small JSON state, replaced as a whole; a corrupt or missing file is the empty state."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def load(self) -> dict[str, Any]:
        try:
            got = json.loads(self.path.read_text("utf-8"))
        except (OSError, ValueError):
            return {}
        return got if isinstance(got, dict) else {}

    def save(self, state: dict[str, Any]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=self.path.parent)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(name, self.path)


class DraftLocks:
    """Draft locks with an age limit. A failed unlock keeps the lock; an unreadable time is stale."""

    def __init__(self, desk: Helpdesk, state: StateFile, minutes: float = 30, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> None:
        self.desk, self.state, self.limit, self.now = desk, state, timedelta(minutes=minutes), now

    def stale(self, entry: dict[str, Any]) -> bool:
        try:
            return self.now() - datetime.fromisoformat(entry["at"]) >= self.limit
        except (KeyError, TypeError, ValueError):
            return True

    def acquire(self, thread_id: str, owner: str) -> bool:
        if not self.desk.lock_draft(thread_id, owner):
            return False
        self.state.save(self.state.load() | {thread_id: {"owner": owner, "at": self.now().isoformat()}})
        return True

    def release(self, thread_id: str, owner: str) -> bool:
        try:
            ok = self.desk.unlock_draft(thread_id, owner)
        except Exception:
            ok = False
        if ok:
            self.state.save({k: v for k, v in self.state.load().items() if k != thread_id})
        return ok

    def list_stale(self) -> list[str]:
        return sorted(k for k, v in self.state.load().items() if self.stale(v))

    def release_stale(self) -> list[str]:
        held = self.state.load()
        return [k for k in self.list_stale() if self.release(k, str(held[k].get("owner", "")))]

    def held(self, thread_id: str, owner: str):
        """A context in which the lock is held; it is released at the end whatever happens."""
        from contextlib import contextmanager

        @contextmanager
        def run():
            if not self.acquire(thread_id, owner):
                raise RuntimeError(f"{thread_id} is locked")
            try:
                yield
            finally:
                self.release(thread_id, owner)

        return run()


def assign_with_cursor(rows: list[dict[str, Any]], desk: Helpdesk, state: StateFile) -> list[dict[str, Any]]:
    """Assign tickets (thread_id, pool, agents, expert) in order. The cursor of a pool moves when a turn succeeds."""
    cursor = state.load()
    for r in rows:
        n = len(r["agents"])
        turn = (cursor.get(r["pool"], 0) + 1) % n
        r["agent"] = r.get("expert") or r["agents"][turn]
        r["ok"] = desk.assign(r["thread_id"], r["agent"])
        if r["ok"] and not r.get("expert"):
            cursor[r["pool"]] = turn
    state.save(cursor)
    return rows
