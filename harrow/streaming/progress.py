"""Progress of a run: a line on the terminal and a listener for streaming queries."""

from __future__ import annotations

import sys
import time

from pyspark.sql.streaming import StreamingQueryListener


def duration(seconds: float | None) -> str:
    if seconds is None or seconds < 0:
        return "?"
    n = int(seconds)
    return f"{n // 3600}:{n // 60 % 60:02d}:{n % 60:02d}" if n >= 3600 else f"{n // 60}:{n % 60:02d}"


def estimate(done: int, queued: int, in_progress: int, elapsed: float, max_pages: int) -> dict:
    total = max(min(max_pages, done + queued + in_progress), done, 1)
    speed = done / elapsed if elapsed > 0 else 0.0
    return {"total": total, "percent": 100.0 * done / total, "speed": speed, "eta": (total - done) / speed if speed > 0 else None}


def line(done: int, e: dict, width: int = 30) -> str:
    filled = int(width * done / e["total"])
    return f"[{'#' * filled}{'-' * (width - filled)}] {done}/{e['total']} {e['percent']:.0f}% {e['speed']:.1f}/s {duration(e['eta'])}"


class Reporter:
    """Redraws one line on a terminal, else writes plain lines, no more often than ``interval``."""

    def __init__(self, max_pages: int, interval: float = 0.5, out=sys.stderr):
        self.max_pages, self.interval, self.out, self.began, self.last = max_pages, interval, out, time.monotonic(), 0.0

    def update(self, done: int, queued: int = 0, in_progress: int = 0, final: bool = False) -> None:
        now = time.monotonic()
        if not final and now - self.last < self.interval:
            return
        self.last = now
        said = line(done, estimate(done, queued, in_progress, now - self.began, self.max_pages))
        live = self.out.isatty()
        self.out.write(("\r" if live else "") + said + ("\n" if final or not live else ""))
        self.out.flush()


class ProgressListener(StreamingQueryListener):
    """Feeds a Reporter from a streaming query's own progress."""

    def __init__(self, reporter: Reporter):
        self.reporter, self.rows = reporter, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.reporter.update(self.rows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.reporter.update(self.rows, final=True)
