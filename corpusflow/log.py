"""Log records of the driver as lines of JSON, from a level that the environment sets."""

from __future__ import annotations

import json
import logging
import os
import sys
from datetime import UTC, datetime

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class Lines(logging.Handler):
    """One line a record: warnings and errors to stderr, the rest to stdout. `meta` of a record, where it
    has one, is part of the line; what JSON doesn't know is written as text."""

    def emit(self, record: logging.LogRecord) -> None:
        level = next((name for name, n in reversed(LEVELS.items()) if record.levelno >= n), "debug")
        entry = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "level": level, "module": record.name.removeprefix("corpusflow."), "message": record.getMessage()}
        if getattr(record, "meta", None) is not None:
            entry["meta"] = record.meta
        print(json.dumps(entry, ensure_ascii=False, default=str), file=sys.stderr if record.levelno >= logging.WARNING else sys.stdout)


def logger(module: str, level: str | None = None) -> logging.Logger:
    """A logger of a module: logger("crawl").info("fetched", extra={"meta": {"url": url}}). The level is the
    given one, else that of CORPUSFLOW_LOG_LEVEL, else info; a level that there isn't is an error."""
    name = (level or os.environ.get("CORPUSFLOW_LOG_LEVEL") or "info").lower()
    if name not in LEVELS:
        raise ValueError(f"{name} is no level; there are {', '.join(LEVELS)}")
    out = logging.getLogger(f"corpusflow.{module}")
    out.setLevel(LEVELS[name])
    out.propagate = False
    if not any(isinstance(h, Lines) for h in out.handlers):
        out.addHandler(Lines())
    return out
