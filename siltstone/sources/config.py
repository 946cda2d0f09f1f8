"""Project configuration and the registry of projects. [SRC-10, SRC-11, SRC-13, FN-15]"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Config:
    # The defaults of the configuration file.
    version: str = "0.0.0"
    embeddingProvider: str = "ollama"
    embeddingModel: str = "jina-8k"
    embeddingContextSize: int = 8192
    vectorSize: int = 768
    ollamaBaseUrl: str = "http://127.0.0.1:11434"
    ollamaNumCtx: int = 512
    indexConcurrency: int = 2
    indexBatchSize: int = 8
    logLevel: str = "error"
    excludePaths: list[str] = field(default_factory=lambda: ["fixtures/**", "**/fixtures/**", "vendor/**"])
    searchMinScore: float = 0.55
    skipImportChunksInVectors: bool = False

    @classmethod
    def read(cls, text: str | None) -> Config:
        """Fields of the right type and range replace defaults; all others, unknown ones and unreadable text are ignored."""
        out = cls()
        try:
            given = json.loads(text or "{}")
        except ValueError:
            return out
        if not isinstance(given, dict):
            return out
        for f in fields(cls):
            value = given.get(f.name)
            if _fits(f.name, value, getattr(out, f.name)):
                setattr(out, f.name, value)
        return out

    def write(self) -> str:
        return json.dumps(asdict(self), indent=2)


def _fits(name: str, value: object, default: object) -> bool:
    if isinstance(default, str):
        return isinstance(value, str) and value != ""
    if isinstance(default, bool):
        return isinstance(value, bool)
    if isinstance(default, list):
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    if name == "searchMinScore":
        return 0 <= value <= 1
    return isinstance(value, int) and value > 0


def read_options(given: dict[str, str | None], config: Config | None = None) -> dict[str, float | int | None]:
    """[FN-15] Options of the queries from their texts: min_score (0 to 1, else an error; the configured one if not given), max_depth
    (0 or more) and max_files (1 or more; none if not given), depth (brought into 1 to 5)."""

    def number(name: str, kind: type, fine) -> float | int | None:
        text = given.get(name)
        if not text:
            return None
        try:
            value = kind(text)
        except ValueError:
            value = None
        if value is None or not fine(value):
            raise ValueError(f"{name}: {text!r} is out of range")
        return value

    least = number("min_score", float, lambda v: 0 <= v <= 1)
    return {
        "min_score": (config or Config()).searchMinScore if least is None else least,
        "max_depth": number("max_depth", int, lambda v: v >= 0),
        "max_files": number("max_files", int, lambda v: v > 0),
        "depth": max(1, min(5, number("depth", int, lambda v: True) or 1)),
    }


def project_root(start: str, marker: str = ".siltstone/config.json") -> str | None:
    """The nearest folder at or above ``start`` with the marker, else with ``.git``."""
    folder = os.path.abspath(start)
    above = [folder]
    while os.path.dirname(folder) != folder:
        folder = os.path.dirname(folder)
        above.append(folder)
    return next((d for m in (marker, ".git") for d in above if os.path.exists(os.path.join(d, m))), None)


class Registry:
    """Known projects in a JSON file, one entry a path, the last added wins."""

    def __init__(self, path: str):
        self.path = path

    def list(self) -> list[dict]:
        try:
            with open(self.path) as f:
                got = json.load(f)
        except (OSError, ValueError):
            return []
        return [p for p in got if isinstance(p, dict) and isinstance(p.get("path"), str)] if isinstance(got, list) else []

    def _save(self, projects: list[dict]) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        temporary = f"{self.path}.tmp"
        with open(temporary, "w") as f:
            json.dump(projects, f, indent=2)
        os.replace(temporary, self.path)

    def add(self, path: str, **more: object) -> None:
        full = os.path.realpath(path)
        self._save([*[p for p in self.list() if p["path"] != full], {"path": full, **more}])

    def remove(self, path: str) -> None:
        self._save([p for p in self.list() if p["path"] != os.path.realpath(path)])

    def clean(self) -> list[str]:
        """Drop entries whose folder is gone; returns them."""
        gone = [p["path"] for p in self.list() if not os.path.isdir(p["path"])]
        self._save([p for p in self.list() if p["path"] not in gone])
        return gone
