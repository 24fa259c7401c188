"""Symbols of languages with braces through declaration patterns.

Comments and strings are blanked out first, positions staying as they are, so
that patterns and brace counts see code only.  A declaration's range ends at
the brace that closes its body.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from symgrove.sources.extract.common import Found, doc_above, qualified

_NOISE = {
    "default": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rust": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "javascript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`",
    "php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "swift": r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"",
}
_KEYWORDS = set("if for while switch catch return new function fn func match else do try throw typeof await yield in of not and or super sizeof using lock foreach elseif guard defer where when assert print echo isset empty array list".split())
_CALL = re.compile(r"(?<![\w$.>:])(new\s+)?(\$?[A-Za-z_][\w$]*!?(?:\s*(?:\?\.|\.|::|->)\s*[A-Za-z_][\w$]*)*)\s*(?:<[\w, .\[\]]*>)?\s*\(")


@dataclass
class Decl:
    kind: str
    name: str
    at: int
    end: int
    head: str
    owner: Decl | None = None
    id: str = ""
    extra: str = ""


def blanked(text: str, language: str) -> str:
    pattern = _NOISE.get("javascript" if language == "typescript" else language, _NOISE["default"])
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(code: str, at: int) -> int:
    """The place of the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1


def _body(code: str, at: int) -> tuple[int, int]:
    """(end of the head, end of the declaration) of what starts at ``at``."""
    depth = 0
    for m in re.compile(r"[(){};\n]").finditer(code, at):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{" and depth <= 0:
            return m.start(), closing(code, m.start())
        elif c == ";" and depth <= 0 or c == "}" and depth <= 0:
            return m.start(), m.start()
        elif c == "\n" and depth <= 0 and not re.match(r"\s*(\{|where\b|throws\b|extends\b|implements\b|:|,|->)", code[m.end() : m.end() + 200]) and not code[at : m.start()].rstrip().endswith((",", ":", "=", "->", "(")):
            return m.start(), m.start()
    return len(code), len(code) - 1


_W = r"[A-Za-z_$][\w$]*"
_CS = r"(?:(?:public|private|protected|internal|static|abstract|sealed|virtual|override|async|partial|readonly|final|synchronized|default|native|extern|unsafe|const)\s+)*"
_TYPE = r"[A-Za-z_][\w.]*(?:<[^;{}()=]*>)?(?:\[\])*\??"
#: (kind, pattern with group ``n``); where two fit at one place the first wins.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>(?=\s))?\s+(?:(?P<trait>[\w:]+(?:<[^{]*?>)?)\s+for\s+)?(?P<n>[\w:]+)"),
        *[(k, rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?{w}\s+(?P<n>\w+)") for k, w in (("Struct", "struct"), ("Enum", "enum"), ("Trait", r"(?:unsafe\s+)?trait"), ("Module", "mod"), ("TypeAlias", "type"), ("Constant", r"const(?!\s+fn)"), ("Static", r"static(?:\s+mut)?"))],
        ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S*\s*)?fn\s+(?P<n>\w+)"),
        ("Import", r"^[ \t]*(?:pub\s+)?use\s+(?P<n>[^;]+)"),
    ],
    "javascript": [
        ("Class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_W})"),
        ("Interface", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<n>{_W})"),
        ("Enum", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>{_W})"),
        ("TypeAlias", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>{_W})\s*(?:<[^=]*>)?\s*="),
        ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>{_W})"),
        ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_W})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_W})\s*(?::[^=>{{]+)?=>"),
        ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_W})\s*=\s*(?:async\s+)?function\b"),
        ("Constant", rf"^[ \t]*(?:export\s+)?const\s+(?P<n>{_W})\s*(?::[^=]+)?=(?P<value>[^;\n]*)"),
        ("Import", r"^[ \t]*import\b(?P<n>[^;\n]*)"),
        ("member", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<n>#?{_W})\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{;]+)?\s*\{{"),
        ("member", rf"(?<=\{{)\s*(?:(?:static|async|get|set)\s+)*(?P<n>{_W})\([^)]*\)\s*(?::[^{{;]+)?\{{"),
        ("Property", rf"^[ \t]+(?:(?:public|private|protected|static|readonly|declare)\s+)*(?P<n>#?{_W})\s*[?!]?\s*(?::[^=;(){{}}\n]+)?(?:=[^;\n]*)?;"),
    ],
    "csharp": [
        ("Namespace", r"^[ \t]*namespace\s+(?P<n>[\w.]+)"),
        *[(k, rf"{_CS}{w}\s+(?P<n>\w+)") for k, w in (("Record", r"record(?:\s+(?:class|struct))?"), ("Class", "class"), ("Struct", "struct"), ("Interface", "interface"), ("Enum", "enum"))],
        ("ctor", r"(?:public|private|protected|internal|static)\s+(?P<n>\w+)\s*\((?=[^;{]*\)\s*(?::[^{]*)?\{)"),
        ("member", rf"{_CS}{_TYPE}\s+(?P<n>\w+)\s*(?:<[^>]*>)?\s*\((?=[^;{{}}]*\)\s*(?:where[^{{]*)?(?:\{{|=>|;))"),
        ("Property", rf"(?:public|private|protected|internal)\s+(?:static\s+|virtual\s+|override\s+)*{_TYPE}\s+(?P<n>\w+)\s*(?:\{{\s*(?:get|set|init)|=>)"),
        ("Import", r"^[ \t]*using\s+(?P<n>[\w.]+)\s*;"),
    ],
    "java": [
        ("Package", r"^[ \t]*package\s+(?P<n>[\w.]+)"),
        ("Import", r"^[ \t]*import\s+(?:static\s+)?(?P<n>[\w.*]+)"),
        *[(k, rf"{_CS}{w}\s+(?P<n>\w+)") for k, w in (("Interface", "@?interface"), ("Class", "class"), ("Enum", "enum"), ("Record", r"record(?=\s+\w+\s*(?:<[^>]*>)?\s*\()"))],
        ("ctor", r"(?:(?:public|private|protected)\s+)?(?P<n>[A-Z]\w*)\s*\((?=[^;{}]*\)\s*(?:throws[^{]*)?\{)"),
        ("member", rf"{_CS}(?:<[^>]*>\s*)?{_TYPE}\s+(?P<n>\w+)\s*\((?=[^;{{}}]*\)\s*(?:throws[^{{;]*)?(?:\{{|;))"),
        ("Field", rf"(?:(?:public|private|protected|static|final|volatile|transient)\s+)+{_TYPE}\s+(?P<n>\w+)\s*(?:=[^;]*)?;"),
    ],
    "go": [
        ("Module", r"^package\s+(?P<n>\w+)"),
        ("recv", r"^func\s*\(\s*(?P<var>\w*)\s*\*?\s*(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)"),
        ("function", r"^func\s+(?P<n>\w+)"),
        ("Struct", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("Interface", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("TypeAlias", r"^type\s+(?P<n>\w+)\s+(?!struct|interface)"),
        ("Constant", r"^const\s+(?P<n>\w+)"),
    ],
    "swift": [
        *[(k, rf"(?:(?:public|private|internal|fileprivate|open|final|indirect)\s+)*\b{w}\s+(?P<n>\w+)") for k, w in (("Class", r"(?:class(?!\s+(?:func|var|let))|actor|extension)"), ("Struct", "struct"), ("Interface", "protocol"), ("Enum", "enum"))],
        ("ctor", r"(?:(?:public|private|internal|fileprivate|open|required|convenience|override)\s+)*\b(?P<n>init)[?!]?\s*(?=[(<])"),
        ("function", r"(?:(?:public|private|internal|fileprivate|open|static|class|final|override|mutating|async)\s+)*\bfunc\s+(?P<n>\w+)"),
        ("Property", r"^[ \t]*(?:(?:public|private|internal|fileprivate|open|static|class|final|lazy|weak)\s+)*(?:var|let)\s+(?P<n>\w+)"),
        ("Import", r"^[ \t]*import\s+(?P<n>[\w.]+)"),
    ],
    "php": [
        ("Namespace", r"^[ \t]*namespace\s+(?P<n>[\w\\]+)"),
        *[(k, rf"(?:(?:abstract|final|readonly)\s+)*\b{w}\s+(?P<n>\w+)") for k, w in (("Class", r"(?<![:$>])class"), ("Interface", "interface"), ("Trait", "trait"), ("Enum", "enum"))],
        ("function", r"(?:(?:public|private|protected|static|abstract|final)\s+)*\bfunction\s+&?\s*(?P<n>\w+)"),
        ("Property", r"(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<n>\w+)"),
        ("Constant", r"(?:(?:public|private|protected|final)\s+)*\bconst\s+(?:\w+\s+)?(?P<n>[A-Z_]\w*)\s*="),
        ("Import", r"^[ \t]*use\s+(?P<n>[\w\\]+)(?:\s+as\s+\w+)?\s*;"),
    ],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in ps] for lang, ps in PATTERNS.items()}
_TYPES = {"Class", "Struct", "Interface", "Enum", "Record", "Trait", "impl"}
_ACCESS = re.compile(r"\b(public|open|private|fileprivate|protected|internal)\b")


def _visibility(language: str, name: str, head: str, kind: str) -> str:
    if language == "rust":
        return "Public" if re.match(r"\s*pub\b", head) else "Private"
    if language in ("javascript", "typescript"):
        return "Public"
    if language == "go":
        return "Public" if name[:1].isupper() else "Private"
    m = _ACCESS.search(head)
    if m:
        return {"open": "Public", "fileprivate": "Private"}.get(m[1], m[1].capitalize())
    return {"csharp": "Private", "java": "Internal", "swift": "Internal", "php": "Public"}[language]


def _declarations(code: str, language: str) -> list[Decl]:
    found: dict[int, Decl] = {}
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(code):
            name = m["n"].strip()
            at = m.start("n")
            if at in found or (kind in ("member", "ctor", "Property", "Field") and name in _KEYWORDS) or (kind == "member" and re.match(r"\s*(?:return|new|else|throw|await)\b", m[0])):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            head_end, end = _body(code, m.end() - 1 if code[m.end() - 1] == "{" else m.end())
            extra = m.groupdict().get("trait") or m.groupdict().get("recv") or m.groupdict().get("value") or ""
            found[at] = Decl(kind, name, start, max(end, m.end() - 1), code[start : max(head_end, m.end("n"))], extra=(extra + "\0" + (m.groupdict().get("var") or "")))
    out = sorted(found.values(), key=lambda d: (d.at, -d.end))
    stack: list[Decl] = []
    for d in out:
        while stack and d.at > stack[-1].end:
            stack.pop()
        d.owner = stack[-1] if stack else None
        if d.end > d.at and d.kind not in ("Import", "Property", "Field", "Constant"):
            stack.append(d)
    return out


def _bases(head: str, language: str) -> list[tuple[str, str]]:
    """(edge kind, type) of a type's heritage."""
    names = lambda s: [re.sub(r"<.*|\(.*", "", x).strip() for x in re.sub(r"<[^<>]*>", "", s).split(",") if x.strip()]
    if language in ("javascript", "typescript", "java", "php"):
        ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|\{|$)", head, re.S)
        imp = re.search(r"\bimplements\s+(.*?)(?=\bextends\b|\bpermits\b|\{|$)", head, re.S)
        return [("EXTENDS", x) for x in (names(ext[1]) if ext else [])] + [("IMPLEMENTS", x) for x in (names(imp[1]) if imp else [])]
    m = re.search(r":\s*(.*?)(?=\bwhere\b|\{|$)", re.sub(r"\([^()]*\)", "", head), re.S)
    if not m:
        return []
    if language == "csharp":
        return [("IMPLEMENTS" if re.match(r"I[A-Z]", x.rsplit(".", 1)[-1]) else "EXTENDS", x) for x in names(m[1])]
    return [("EXTENDS", x) for x in names(m[1])] if language == "swift" else []


def extract(path: str, text: str, language: str) -> Found:
    out = Found(path, language)
    code = blanked(text, language)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect.bisect_right(starts, at) - 1
    lines = text.split("\n")
    file = out.node(path.rsplit("/", 1)[-1], "File", 0, text.count("\n"))
    sep = "::" if language == "rust" else "."
    functions: list[Decl] = []
    decls = _declarations(code, language)
    for d in decls:
        inside = d.owner
        while inside is not None and inside.kind not in _TYPES | {"Module", "Namespace", "function", "member", "recv", "ctor"}:
            inside = inside.owner
        in_type = inside if inside is not None and inside.kind in _TYPES else None
        if inside is not None and inside.kind in ("function", "member", "recv", "ctor"):
            continue  # local to a body
        kind, name, owner = d.kind, d.name, in_type.name if in_type else None
        if kind in ("member", "ctor", "Property", "Field") and in_type is None and not (language == "swift" and kind == "Property"):
            continue
        if kind == "impl":
            d.name = re.sub(r"<.*", "", name)
            trait = d.extra.split("\0")[0]
            if trait:
                struct = next((x.id for x in decls if x.kind in ("Struct", "Enum") and x.name == d.name and x.id), None)
                out.edge(struct or file, "IMPLEMENTS", re.sub(r"<.*", "", trait), line(d.at))
            d.id = file
            continue
        if kind == "Import":
            _import(out, d, file, language, line(d.at), text)
            continue
        if kind in ("function", "member", "ctor", "recv"):
            if kind == "recv":
                owner = d.extra.split("\0")[0]
            made = f"{owner}{sep}{name}" if owner else name
            label = "Method" if owner else "Function"
            ctor = {"javascript": "constructor", "typescript": "constructor", "php": "__construct"}.get(language)
            if owner and (kind == "ctor" or name == ctor):
                if kind == "ctor" and language in ("csharp", "java"):
                    if name != owner:
                        continue
                    made = f"{owner}..ctor"
                label = "Constructor"
        elif kind in ("Property", "Field"):
            made = f"{owner}.{name}" if language in ("javascript", "typescript", "swift", "php") and owner else name
            label = "Constant" if language == "swift" and owner is None else kind
        else:
            made, label = (f"{owner}.{name}" if kind == "Constant" and owner else name), kind
        first, last = line(d.at), line(d.end)
        head = " ".join(text[d.at : d.at + len(d.head)].split())
        parent = (inside.id or file) if inside is not None else file
        d.id = out.node(made, label, first, last, head or None, doc_above(lines, first), _visibility(language, name, d.head, label), parent, overloads=language in ("swift", "php"))
        if label in ("Method", "Function", "Constructor"):
            d.owner = in_type
            functions.append(d)
            if kind == "recv":
                d.extra = owner + "\0" + d.extra.split("\0")[1]
        if kind in _TYPES:
            for edge, target in _bases(d.head, language):
                out.edge(d.id, edge, target, first)
            _fields(out, d, code, text, language, line)
        if language == "rust" and label in ("Function", "Struct"):
            out.edge(parent, "CONTAINS", d.id, first)
        if label == "Constant" and language in ("javascript", "typescript"):
            m = re.search(r"new\s+([\w.]+)", d.head)
            if m:
                out.edge(d.id, "REFERENCES", m[1], first)
    for d in functions:
        _calls(out, d, code, language, line)
    if language == "go":
        _go_blocks(out, file, text, code, line)
    return out


def _fields(out: Found, d: Decl, code: str, text: str, language: str, line) -> None:
    brace = code.find("{", d.at, d.end)
    if brace < 0:
        return
    body = code[brace + 1 : d.end]
    at = lambda m: line(brace + 1 + m.start(m.lastindex or 0))
    if language == "rust" and d.kind == "Struct":
        for m in re.finditer(r"(?:^|[,{])\s*(pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,]+)", body):
            out.node(f"{d.name}::{m[2]}", "Field", at(m), at(m), None, None, "Public" if m[1] else "Private", d.id)
            out.edge(d.id, "REFERENCES", m[3].strip(), at(m))
    elif language == "go" and d.kind == "Struct":
        for m in re.finditer(r"^[ \t]*(\w+)[ \t]+([*\[\]\w.]+)", body, re.M):
            out.node(f"{d.name}.{m[1]}", "Field", at(m), at(m), None, None, "Public" if m[1][0].isupper() else "Private", d.id)
            target = m[2].lstrip("*[]")
            if target[:1].isupper() or "." in target:
                out.edge(d.id, "REFERENCES", target, at(m))
    elif language == "go" and d.kind == "Interface":
        for m in re.finditer(r"^[ \t]*(\w+)\s*\(", body, re.M):
            out.node(f"{d.name}.{m[1]}", "Method", at(m), at(m), None, None, "Public" if m[1][0].isupper() else "Private", d.id)
    elif language == "java" and d.kind == "Enum":
        for m in re.finditer(r"(?:^|,)\s*([A-Z_]\w*)\s*(?:\([^)]*\))?(?=\s*(?:,|;|$))", body.split(";")[0]):
            out.node(m[1], "EnumVariant", at(m), at(m), None, None, "Public", d.id)


def _import(out: Found, d: Decl, file: str, language: str, at: int, text: str) -> None:
    raw = text[d.at : d.end + 1]
    if language in ("javascript", "typescript"):
        m = re.search(r"""['"]([^'"]+)['"]""", text[d.at : text.find("\n", d.at) if text.find("\n", d.at) > 0 else len(text)])
        module = m[1] if m else None
        names = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\bfrom\b.*", "", d.name)) or [module or d.name]
        if module and module.startswith("."):
            module = f"{out.path.rsplit('/', 1)[0]}/{module}"
        for n in names:
            if n not in ("type", "as"):
                out.node(n, "Import", at, at, raw.strip(), None, "Private", file)
                out.edge(file, "IMPORTS", n, at, module)
        return
    name = " ".join(d.name.split())
    if language == "csharp":
        out.edge(file, "IMPORTS", out.node(name, "Import", at, at, raw.strip(), None, "Private", file), at)
        return
    if language not in ("swift", "php"):
        out.node(name, "Import", at, at, raw.strip(), None, "Private", file)
    out.edge(file, "IMPORTS", name, at)


def _go_blocks(out: Found, file: str, text: str, code: str, line) -> None:
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|[\w.]*\s*\"([^\"]+)\")", text, re.M):
        for x in re.finditer(r"\"([^\"]+)\"", m[0]):
            at = line(m.start() + x.start())
            out.node(x[1], "Import", at, at, None, None, "Private", file)
            out.edge(file, "IMPORTS", x[1], at)
    for m in re.finditer(r"^const\s*\(([^)]*)\)", code, re.M):
        for x in re.finditer(r"^[ \t]*([A-Za-z]\w*)", m[1], re.M):
            at = line(m.start(1) + x.start(1))
            out.node(x[1], "Constant", at, at, None, None, "Public" if x[1][0].isupper() else "Private", file)


def _calls(out: Found, d: Decl, code: str, language: str, line) -> None:
    brace = code.find("{", d.at, d.end)
    arrow = code.find("=>", d.at, d.end + 1)
    begin = brace if brace >= 0 else arrow
    if begin < 0:
        return
    owner = d.owner.name if d.owner else None
    recv, _, var = d.extra.partition("\0")
    for m in _CALL.finditer(code, begin, d.end + 1):
        target = re.sub(r"\s+", "", m[2]).replace("?.", ".")
        if target in _KEYWORDS or target.endswith("!"):
            continue
        if language == "php":
            if m[1]:
                target = f"{target}.__construct"
            elif owner and target.startswith(("$this->", "self::", "static::")):
                target = f"{owner}.{re.split(r'->|::', target, maxsplit=1)[1]}"
            else:
                target = target.replace("->", ".").lstrip("$")
        elif m[1]:
            if language in ("java", "csharp"):
                out.edge(d.id, "REFERENCES", target, line(m.start(2)))
            continue
        elif language == "go" and var and target.startswith(f"{var}."):
            target = f"{recv}.{target[len(var) + 1 :]}"
        elif language != "rust":
            target = qualified(target, owner)
        out.edge(d.id, "CALLS", target, line(m.start(2)))
