"""Settings of an index: a read-only TOML file, read by dotted keys."""

from __future__ import annotations

import tomllib
from pathlib import Path


class IndexSettings:
    def __init__(self, folder: str | Path):
        path = Path(folder) / "settings.toml"
        self.values = tomllib.loads(path.read_text()) if path.is_file() else {}

    def get(self, key: str, default=None):
        at = self.values
        for name in key.split("."):
            if not isinstance(at, dict) or name not in at:
                return default
            at = at[name]
        return at
