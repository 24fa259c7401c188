"""Symbols of Python files through the standard library's parser."""

from __future__ import annotations

import ast
import re

from symgrove.sources.extract.common import Found, qualified


def _dotted(e: ast.expr) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        base = _dotted(e.value)
        return f"{base}.{e.attr}" if base else None
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "super":
        return f"super({', '.join(map(ast.unparse, e.args))})"
    return None


def _visibility(name: str) -> str:
    return "Private" if name.startswith("_") and not name.startswith("__") else "Public"


def _calls(out: Found, body: list[ast.stmt], source: str, owner: str | None) -> None:
    for stmt in body:
        for e in ast.walk(stmt):
            if isinstance(e, ast.Call) and (target := _dotted(e.func)):
                out.edge(source, "CALLS", qualified(target, owner), e.lineno - 1)


#: Statements of the second version of the language that the third can't parse.
_OLD = re.compile(r"^(\s*)(?:print|exec)\s+[^\s=(.\[].*$|^(\s*)print\s*>>.*$", re.M)
_OLD_EXCEPT = re.compile(r"^(\s*except\s+[^\s,:()]+)\s*,\s*\w+\s*:", re.M)


def parsed(text: str) -> ast.Module:
    """The syntax tree of what parses: a statement that doesn't becomes ``pass``.

    Every round blanks one more line, so there are at most two rounds a line.
    """
    try:
        return ast.parse(text)
    except SyntaxError:
        pass
    text = _OLD_EXCEPT.sub(r"\1:", _OLD.sub(lambda m: (m[1] or m[2] or "") + "pass", text.replace("\0", " ")))
    lines = text.split("\n")
    while True:
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max(e.lineno or 1, 1), len(lines)) - 1
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at < 0:  # nothing is left before the place
                at = next((i for i, x in enumerate(lines) if x.strip()), -1)
                if at < 0:
                    return ast.Module([], [])
            blank = lines[at].strip() == "pass" or isinstance(e, IndentationError)
            lines[at] = "" if blank else lines[at][: len(lines[at]) - len(lines[at].lstrip())] + "pass"


def extract(path: str, text: str) -> Found:
    """Symbols of the parts of the file that parse; there is a File node in any case."""
    out = Found(path, "python")
    tree = parsed(text)
    file = out.node(path.rsplit("/", 1)[-1], "File", 0, text.count("\n"))

    def visit(body: list[ast.stmt], owner: str | None, parent: str) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                made = out.node(s.name, "Class", s.lineno - 1, s.end_lineno - 1, f"class {s.name}" + (f"({', '.join(map(ast.unparse, s.bases))})" if s.bases else ""), ast.get_docstring(s), _visibility(s.name), parent)
                for b in s.bases:
                    out.edge(made, "EXTENDS", ast.unparse(b), s.lineno - 1)
                visit(s.body, s.name, made)
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "Function" if owner is None else "Constructor" if s.name == "__init__" else "Method"
                name = f"{owner}.{s.name}" if owner else s.name
                made = out.node(name, kind, s.lineno - 1, s.end_lineno - 1, f"def {s.name}({ast.unparse(s.args)})", ast.get_docstring(s), _visibility(s.name), parent)
                _calls(out, s.body, made, owner)
            elif isinstance(s, ast.Import | ast.ImportFrom):
                module = "." * s.level + (s.module or "") if isinstance(s, ast.ImportFrom) else None
                for a in s.names:
                    out.node(a.name, "Import", s.lineno - 1, s.end_lineno - 1, ast.unparse(s), None, "Private", file)
                    out.edge(file, "IMPORTS", a.name, s.lineno - 1, module)
            else:
                for inner in ("body", "orelse", "finalbody"):
                    visit([x for x in getattr(s, inner, []) if isinstance(x, ast.stmt)], owner, parent)

    visit(tree.body, None, file)
    return out
