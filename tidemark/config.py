"""Settings of an engine as JSON: a given file, else ``tidemark.json`` in the working folder, else defaults."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import asdict, dataclass, field


@dataclass
class Crawler:
    max_depth: int = 3
    requests_per_second: int = 200
    user_agent: str = "tidemark"


@dataclass
class Storage:
    max_gb: float = 35.0
    warn_gb: float = 30.0


@dataclass
class Config:
    data_dir: str = "data"
    dimensions: int = 384
    stemmer: str = "snowball"
    crawler: Crawler = field(default_factory=Crawler)
    storage: Storage = field(default_factory=Storage)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def load(path: str | None = None) -> Config:
    """A file that can't be read or parsed only warns; unknown keys are ignored."""
    path = path or "tidemark.json"
    if not os.path.exists(path):
        return Config()
    try:
        with open(path, encoding="utf-8") as source:
            raw = json.load(source)
        parts = {"crawler": Crawler, "storage": Storage}
        known = {k: parts[k](**{x: y for x, y in v.items() if x in parts[k].__dataclass_fields__}) if k in parts else v for k, v in raw.items() if k in Config.__dataclass_fields__}
        return Config(**known)
    except (OSError, ValueError, TypeError, AttributeError) as error:
        warnings.warn(f"{path}: {error}; the defaults hold", stacklevel=2)
        return Config()


def storage_state(used_bytes: int, storage: Storage) -> str:
    """``stop`` at the limit, ``warn`` from the threshold on, else ``ok``."""
    gb = used_bytes / 1024**3
    return "stop" if gb >= storage.max_gb else "warn" if gb >= storage.warn_gb else "ok"
