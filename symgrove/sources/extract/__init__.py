"""Source text to symbols and raw edges, one function for all languages."""

from __future__ import annotations

from symgrove import schema
from symgrove.sources.extract import braces, python
from symgrove.sources.extract.common import Found
from symgrove.sources.extract.routes import add_routes


def extract(path: str, text: str, language: str | None = None) -> Found:
    language = language or schema.EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return Found(path, "")
    found = python.extract(path, text) if language == "python" else braces.extract(path, text, language)
    add_routes(found, text)
    return found
