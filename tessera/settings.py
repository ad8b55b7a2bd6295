"""Keys of remote services: from the caller, the environment or a .env file. Never a column of a table."""

from __future__ import annotations

import os
from pathlib import Path


def load_env(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file, quotes taken off; comments and lines without a name are left out."""
    file = Path(path)
    found = {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else []:
        name, sep, value = line.strip().partition("=")
        if sep and name.strip() and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found


def resolve_key(name: str, supplied: str | None = None, env_file: str | Path | None = None, placeholders=("", "changeme", "...")) -> str:
    """The first key that is no placeholder: supplied, then environment, then file. KeyError if there is none."""
    filed = load_env(env_file).get(name) if env_file else None
    for key in (supplied, os.environ.get(name), filed):
        if key and key.strip().lower() not in placeholders:
            return key.strip()
    raise KeyError(name)
