"""The engine's log file: the newest lines only. [SNK-12]"""

from __future__ import annotations

import logging
import os
import sys
import time
from collections import deque

# How many lines the file keeps, and the names of the levels from the gravest on.
KEPT_LINES = 100
LEVELS = ("error", "warn", "info", "debug")


class LastLines(logging.Handler):
    """Appends records to a file and cuts it to its last ``keep`` lines. Where the file's folder is missing, or the file can't be written,
    lines go to the standard output; logging never fails the run."""

    def __init__(self, path: str, keep: int = KEPT_LINES):
        super().__init__()
        self.path, self.keep = path, keep
        form = logging.Formatter("[%(asctime)s.%(msecs)03dZ] [%(name)s] [%(levelname)s] %(message)s", "%Y-%m-%dT%H:%M:%S")
        form.converter = time.gmtime
        self.setFormatter(form)

    def emit(self, record: logging.LogRecord) -> None:
        line = self.format(record)
        try:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
            with open(self.path, encoding="utf-8", errors="replace") as f:
                last = deque(f, maxlen=self.keep + 1)
            if len(last) > self.keep:
                temporary = f"{self.path}.tmp"
                with open(temporary, "w", encoding="utf-8") as f:
                    f.writelines(list(last)[1:])
                os.replace(temporary, self.path)
        except OSError:
            print(line, file=sys.stdout)


def log_to(folder: str, level: str = "error", name: str = "siltstone") -> logging.Logger:
    """The engine's logger, writing to ``log.txt`` in its data folder from the configured level on (``error`` for an unknown one)."""
    logger = logging.getLogger(name)
    for old in [h for h in logger.handlers if isinstance(h, LastLines)]:
        logger.removeHandler(old)
    logger.addHandler(LastLines(os.path.join(folder, "log.txt")))
    logging.addLevelName(logging.WARNING, "WARN")
    logger.setLevel(logging.getLevelNamesMapping()[level.upper()] if level in LEVELS else logging.ERROR)
    logger.propagate = False
    return logger
