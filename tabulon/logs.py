"""Logging: two levels above critical, repeated warnings once, secrets redacted, JSON lines for collectors."""

from __future__ import annotations

import hashlib
import json
import logging
import re

AUDIT, ALERT, THRESHOLD = 80, 90, 25
_SECRET = re.compile(r"(?i)(pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key|pwd)")
_PAIR = re.compile(r"""(?i)(["']?\b[\w-]*(?:pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key|pwd)[\w-]*["']?\s*[:=]\s*["']?)([^"'\s,;}]+)""")
_URL = re.compile(r"(\w+://[^:/@\s]+:)([^@\s]+)(@)")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def redact(value: object) -> object:
    """Secret-like fields by digest and passwords in addresses away, in dicts and texts."""
    if isinstance(value, dict):
        return {k: f"<{digest(str(v))}>" if _SECRET.search(str(k)) else redact(v) for k, v in value.items()}
    if isinstance(value, str):
        return _URL.sub(r"\1***\3", _PAIR.sub(lambda m: f"{m[1]}<{digest(m[2])}>", value))
    return value


class _Once(logging.Filter):
    """Lets a warning pass once."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: set[str] = set()

    def filter(self, record: logging.LogRecord) -> bool:
        if record.levelno != logging.WARNING:
            return True
        text = record.getMessage()
        fresh = text not in self.seen
        if len(self.seen) < 10_000:
            self.seen.add(text)
        return fresh


class Formatter(logging.Formatter):
    def __init__(self, as_json: bool = False):
        super().__init__("%(name)s | %(levelname)s | %(asctime)s | %(message)s")
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        if self.as_json:
            return json.dumps({"severity": record.levelname, "logger": record.name, "message": redact(record.getMessage())})
        return str(redact(super().format(record)))


def get_logger(name: str = "tabulon", as_json: bool = False) -> logging.Logger:
    """The library's logger with the levels AUDIT and ALERT."""
    for level, label in ((AUDIT, "AUDIT"), (ALERT, "ALERT")):
        logging.addLevelName(level, label)
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(Formatter(as_json))
        handler.addFilter(_Once())
        logger.addHandler(handler)
        logger.setLevel(THRESHOLD)
    logger.audit = lambda m, *a: logger.log(AUDIT, m, *a)
    logger.alert = lambda m, *a: logger.log(ALERT, m, *a)
    return logger
