"""Where the library's messages go. Nothing is set up on import; tasks log to their executors' own logs."""

from __future__ import annotations

import logging
import logging.handlers
from pathlib import Path

NAME, FORMAT = "loomwork", "%(asctime)s %(levelname)s %(name)s: %(message)s"
MOST_BYTES, OLD_FILES = 5_000_000, 3
_made: list[logging.Handler] = []


def configure(console: str | None = "INFO", file: str | Path | None = None, file_level: str = "DEBUG", form: str = FORMAT, again: bool = False) -> bool:
    """Sends messages to stderr, from the level `console` on, and to a file that is rotated at MOST_BYTES. Only the first call counts, unless `again`; says whether this one did."""
    if _made and not again:
        return False
    reset()
    log = logging.getLogger(NAME)
    if console is not None:
        _add(log, logging.StreamHandler(), console, form)
    if file is not None:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        _add(log, logging.handlers.RotatingFileHandler(file, maxBytes=MOST_BYTES, backupCount=OLD_FILES, encoding="utf-8"), file_level, form)
    log.setLevel(logging.DEBUG)
    log.propagate = False
    return True


def _add(log: logging.Logger, handler: logging.Handler, level: str, form: str) -> None:
    handler.setLevel(level)
    handler.setFormatter(logging.Formatter(form))
    log.addHandler(handler)
    _made.append(handler)


def configured() -> bool:
    return bool(_made)


def reset() -> None:
    """Takes away what configure() set up."""
    log = logging.getLogger(NAME)
    for handler in _made:
        log.removeHandler(handler)
        handler.close()
    _made.clear()
    log.propagate = True
