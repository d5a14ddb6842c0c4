"""The library: folders to index, with or without what lies below them. Driver-side, a handful of rows."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field


@dataclass
class Library:
    folders: dict[str, bool] = field(default_factory=dict)

    def covers_dir(self, folder: str, path: str) -> bool:
        return path == folder or (self.folders.get(folder, False) and path.startswith(folder.rstrip("/") + "/"))

    def add(self, path: str, include_subfolders: bool = True) -> tuple[str, int]:
        """('added' | 'already-included' | 'merged', folders merged)."""
        path = path.rstrip("/") or "/"
        if any(self.covers_dir(f, path) and (deep or not include_subfolders) for f, deep in self.folders.items()):
            return "already-included", 0
        inner = [f for f in self.folders if include_subfolders and f != path and f.startswith(path.rstrip("/") + "/")]
        for f in inner:
            del self.folders[f]
        self.folders[path] = include_subfolders
        self.folders = dict(sorted(self.folders.items()))
        return ("merged", len(inner)) if inner else ("added", 0)

    def remove(self, path: str) -> None:
        self.folders.pop(path.rstrip("/") or "/", None)

    def save(self, path: str) -> None:
        with open(f"{path}.tmp", "w") as f:
            json.dump({"folders": [{"path": p, "include_subfolders": d} for p, d in self.folders.items()]}, f)
        os.replace(f"{path}.tmp", path)

    @classmethod
    def load(cls, path: str) -> Library:
        """A missing or broken file gives an empty library; folders may be plain strings."""
        try:
            with open(path) as f:
                found = json.load(f).get("folders", [])
            pairs = [(x, True) if isinstance(x, str) else (x["path"], x.get("include_subfolders", True)) for x in found]
        except (OSError, ValueError, KeyError, AttributeError, TypeError):
            pairs = []
        return cls(dict(sorted(pairs)))
