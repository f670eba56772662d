"""Logging to the console and to a rotating file, as text or JSON lines."""

from __future__ import annotations

import json
import logging
import logging.handlers
from pathlib import Path


class JsonFormatter(logging.Formatter):
    def format(self, record):
        out = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def setup(level="INFO", console_level="WARNING", file=None, max_bytes=1_000_000, backup_count=3, format="text") -> logging.Logger:
    """The package's logger with fresh handlers; calling again replaces them."""
    log = logging.getLogger("harrow")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel("DEBUG")
    log.propagate = False
    console = logging.StreamHandler()
    console.setLevel(console_level.upper())
    console.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    log.addHandler(console)
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        out = logging.handlers.RotatingFileHandler(file, maxBytes=max_bytes, backupCount=backup_count, encoding="utf-8")
        out.setLevel(level.upper())
        out.setFormatter(JsonFormatter() if format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(out)
    return log
