"""Logging on the driver with keys and tokens taken out of messages, arguments and tracebacks."""

from __future__ import annotations

import logging
import re

from shelfmark.schema import SECRETS

_PATTERNS = [(re.compile(p), by) for p, by in SECRETS]


def redacted(text: str) -> str:
    for pattern, by in _PATTERNS:
        text = pattern.sub(by, text)
    return text


class RedactingFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return redacted(super().format(record))


def start(path: str, level: int = logging.INFO) -> logging.Logger:
    """The library's logger, writing to ``path``."""
    log = logging.getLogger("shelfmark")
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(RedactingFormatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)
    return log
