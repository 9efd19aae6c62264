"""Starter files of a translation project."""

from __future__ import annotations

import json
from pathlib import Path

from .. import registry as R


def scaffold(folder: str, country: str) -> list[str]:
    """Write an empty bundle for each locale of a country, a starter for English and a configuration; what is there stays.

    Gives the names of the files written.
    """
    found = R.COUNTRIES[country.upper()]
    root, written = Path(folder), []
    root.mkdir(parents=True, exist_ok=True)
    files = {f"{code}.json": {} for code in found.locales} | {"en.json": {"app": {"title": "Hello"}}, "config.json": {"country": found.code, "defaultLocale": found.default_locale, "locales": list(found.locales)}}
    for name, body in files.items():
        path = root / name
        if not path.exists():
            path.write_text(json.dumps(body, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
            written.append(name)
    return written
