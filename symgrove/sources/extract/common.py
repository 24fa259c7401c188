"""What the extractors of all languages share: rows, ids, comments."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from symgrove import schema


def node_id(path: str, name: str, kind: str, line: int, signature: str | None = None) -> str:
    """16 hexadecimal digits; the signature tells overloads apart."""
    parts = [path, name, kind, str(line)]
    if signature is not None and kind in schema.CALLABLE:
        parts.append(signature)
    return hashlib.sha256("\x01".join(parts).encode()).hexdigest()[:16]


@dataclass
class Found:
    """The symbols and raw edges of one file."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def node(self, name: str, kind: str, start: int, end: int, signature: str | None = None, doc: str | None = None, visibility: str = "Public", parent: str | None = None, overloads: bool = False) -> str:
        made = node_id(self.path, name, kind, start, signature if overloads else None)
        self.nodes.append(dict(zip(schema.columns(schema.NODES), (made, name, kind, self.path, start, end, signature, doc, visibility, self.language, parent), strict=True)))
        return made

    def edge(self, source: str, kind: str, target: str, line: int, module: str | None = None) -> None:
        self.edges.append({"source_id": source, "kind": kind, "target_name": target, "target_module": module, "source_line": line})


def qualified(target: str, enclosing: str | None) -> str:
    """``this.m`` and ``self.m`` inside a type are the type's; deeper chains stay."""
    m = re.fullmatch(r"(?:this|self|\$this)(?:\.|->)([^.]+)", target)
    return f"{enclosing}.{m[1]}" if m and enclosing else target


def clean_comment(lines: list[str]) -> str | None:
    """The text of comment lines without their markers; None if nothing is left."""
    out = []
    for x in lines:
        x = re.sub(r"^(///|//!|//|/\*\*?|#|\*(?!/))\s?", "", x.strip())
        out.append(re.sub(r"\s*\*+/$", "", x).strip())
    return "\n".join(out).strip() or None


def doc_above(lines: list[str], line: int) -> str | None:
    """The comment that ends right above ``line``; a blank line between breaks it."""
    at = line - 1
    while at >= 0 and re.match(r"\s*(@\w|#\[|\[\w)", lines[at]):  # decorators and attributes belong to the symbol
        at -= 1
    found: list[str] = []
    if at >= 0 and lines[at].rstrip().endswith("*/"):
        while at >= 0:
            found.append(lines[at])
            if "/*" in lines[at]:
                break
            at -= 1
    else:
        while at >= 0 and re.match(r"\s*(//|#(?!\[))", lines[at]):
            found.append(lines[at])
            at -= 1
    return clean_comment(found[::-1]) if found else None
