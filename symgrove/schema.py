"""The property graph's tables and closed vocabularies."""

from __future__ import annotations

NODES = "id string, name string, kind string, file_path string, line_start int, line_end int, signature string, doc_comment string, visibility string, language string, parent_id string"
EDGES = "source_id string, target_id string, kind string, source_line int, confidence double"
RAW_EDGES = "raw_id bigint, source_id string, kind string, target_name string, target_module string, source_line int"
FILE_HASHES = "file_path string, hash string"
SCHEMA_VERSION = 4

SYMBOL_KINDS = (
    "File Module Package Function Method Constructor Class Struct Enum Union Interface Trait TypeAlias Constant "
    "Static Import Field EnumVariant Property Namespace Record Route Process"
).split()
EDGE_KINDS = "CONTAINS CALLS IMPORTS EXTENDS IMPLEMENTS REFERENCES OVERRIDES HANDLES_ROUTE STEP_IN_PROCESS ENTRY_POINT_OF FETCHES".split()
VISIBILITIES = ["Public", "Private", "Protected", "Internal"]
LANGUAGES = {
    "rust": ["rs"], "python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "csharp": ["cs"],
    "java": ["java"], "go": ["go"], "swift": ["swift"], "php": ["php", "phtml"],
}
EXTENSIONS = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts}

CALLABLE = ["Function", "Method", "Constructor"]
CONTAINERS = ["Class", "Interface", "Trait", "Struct", "Enum", "Record"]
TRAVERSED = ["CALLS", "FETCHES", "HANDLES_ROUTE"]
HIDDEN = ["File", "Import"]

#: Confidence tiers: certain; same file; one hit anywhere; several hits.
CERTAIN, SAME_FILE, UNIQUE, AMBIGUOUS = 1.0, 0.95, 0.9, 0.5


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
