"""A small project in several languages, for queries that parse, resolve and trace, and what its graph is."""

from __future__ import annotations

FILES = {
    "shop/app.py": (
        "python",
        '''"""Entry of the shop."""
from shop.base import Store
import missing_module


class Corner(Store):
    def open(self):
        super().open()
        self.close()

    def close(self):
        print("closed")


def main():
    Corner().open()
    helper(1)
    nowhere()


def helper(n):
    return n
''',
    ),
    "shop/base.py": ("python", "class Store:\n    def open(self):\n        pass\n\n    def close(self):\n        pass\n"),
    "shop/old.py": ("python", "def before():\n    print 'second version'\n\ndef helper(n):\n    return before()\n"),
    "web/api.js": ("javascript", "import { fmt } from './lib/format';\nconst LIMITS = { max: 3 };\nfunction list() { return fmt(LIMITS.get(1)); }\napp.get('/items', function handler() { list(); });\nfunction load() { console.log(1); return fetch('/items'); }\nfunction send() { return fetch('/items', { method: 'POST' }); }\n"),
    "web/lib/format.ts": ("typescript", "export interface Shape {\n  side: number;\n}\nexport function fmt(x: number): string {\n  return String(x);\n}\nexport class Box implements Shape {\n  area() {\n    return 1;\n  }\n  grow() {\n    this.area();\n  }\n}\n"),
    "web/app/items/page.tsx": ("typescript", "export default function Page() { return load(); }\n"),
    "core/geo.rs": ("rust", "pub struct Point {\n    pub x: i32,\n}\npub trait Moves {\n    fn go(&self);\n}\nimpl Point {\n    pub fn new() -> Point {\n        make()\n    }\n}\nimpl Moves for Point {\n    fn go(&self) {\n        Point::new();\n    }\n}\nfn make() {}\n"),
    "srv/main.go": ("go", 'package main\n\nimport "fmt"\n\ntype Store struct { Name string }\n\nfunc (s *Store) Save() { fmt.Println(s.Name) }\n\nfunc main() { s := Store{}; s.Save(); serve() }\n\nfunc serve() { http.HandleFunc("/go", serve) }\n'),
    "jv/Animal.java": ("java", "interface Greets {\n    void hi();\n}\nclass Animal {\n    void eat() {\n    }\n}\nclass Dog extends Animal implements Greets {\n    public void hi() { eat(); }\n    @GetMapping(\"/dogs\")\n    public void dogs() { hi(); }\n}\n"),
}

#: (file_path, kind, name, line_start, line_end, visibility, language), recorded from a run and read through against the texts above.
NODES = [
    ("core/geo.rs", "File", "geo.rs", 0, 17, "Public", "rust"),
    ("core/geo.rs", "Struct", "Point", 0, 2, "Public", "rust"),
    ("core/geo.rs", "Field", "Point::x", 1, 1, "Public", "rust"),
    ("core/geo.rs", "Trait", "Moves", 3, 5, "Public", "rust"),
    ("core/geo.rs", "Method", "Moves::go", 4, 4, "Private", "rust"),
    ("core/geo.rs", "Method", "Point::new", 7, 9, "Public", "rust"),
    ("core/geo.rs", "Method", "Point::go", 12, 14, "Private", "rust"),
    ("core/geo.rs", "Function", "make", 16, 16, "Private", "rust"),
    ("jv/Animal.java", "File", "Animal.java", 0, 12, "Public", "java"),
    ("jv/Animal.java", "Interface", "Greets", 0, 2, "Internal", "java"),
    ("jv/Animal.java", "Method", "Greets.hi", 1, 1, "Internal", "java"),
    ("jv/Animal.java", "Class", "Animal", 3, 6, "Internal", "java"),
    ("jv/Animal.java", "Method", "Animal.eat", 4, 5, "Internal", "java"),
    ("jv/Animal.java", "Class", "Dog", 7, 11, "Internal", "java"),
    ("jv/Animal.java", "Method", "Dog.hi", 8, 8, "Public", "java"),
    ("jv/Animal.java", "Route", "GET /dogs", 9, 9, "Public", "java"),
    ("jv/Animal.java", "Method", "Dog.dogs", 10, 10, "Public", "java"),
    ("jv/Animal.java", "Process", "Process: GET /dogs", 10, 10, "Public", "java"),
    ("shop/app.py", "File", "app.py", 0, 22, "Public", "python"),
    ("shop/app.py", "Import", "Store", 1, 1, "Private", "python"),
    ("shop/app.py", "Import", "missing_module", 2, 2, "Private", "python"),
    ("shop/app.py", "Class", "Corner", 5, 11, "Public", "python"),
    ("shop/app.py", "Method", "Corner.open", 6, 8, "Public", "python"),
    ("shop/app.py", "Method", "Corner.close", 10, 11, "Public", "python"),
    ("shop/app.py", "Function", "main", 14, 17, "Public", "python"),
    ("shop/app.py", "Process", "Process: main", 14, 17, "Public", "python"),
    ("shop/app.py", "Function", "helper", 20, 21, "Public", "python"),
    ("shop/base.py", "Class", "Store", 0, 5, "Public", "python"),
    ("shop/base.py", "File", "base.py", 0, 6, "Public", "python"),
    ("shop/base.py", "Method", "Store.open", 1, 2, "Public", "python"),
    ("shop/base.py", "Method", "Store.close", 4, 5, "Public", "python"),
    ("shop/old.py", "File", "old.py", 0, 5, "Public", "python"),
    ("shop/old.py", "Function", "before", 0, 1, "Public", "python"),
    ("shop/old.py", "Function", "helper", 3, 4, "Public", "python"),
    ("srv/main.go", "File", "main.go", 0, 11, "Public", "go"),
    ("srv/main.go", "Module", "main", 0, 0, "Private", "go"),
    ("srv/main.go", "Import", "fmt", 2, 2, "Private", "go"),
    ("srv/main.go", "Field", "Store.Name", 4, 4, "Public", "go"),
    ("srv/main.go", "Struct", "Store", 4, 4, "Public", "go"),
    ("srv/main.go", "Method", "Store.Save", 6, 6, "Public", "go"),
    ("srv/main.go", "Function", "main", 8, 8, "Private", "go"),
    ("srv/main.go", "Process", "Process: main", 8, 8, "Public", "go"),
    ("srv/main.go", "Function", "serve", 10, 10, "Private", "go"),
    ("srv/main.go", "Process", "Process: ANY /go", 10, 10, "Public", "go"),
    ("srv/main.go", "Route", "ANY /go", 10, 10, "Public", "go"),
    ("web/api.js", "File", "api.js", 0, 6, "Public", "javascript"),
    ("web/api.js", "Import", "fmt", 0, 0, "Private", "javascript"),
    ("web/api.js", "Constant", "LIMITS", 1, 1, "Public", "javascript"),
    ("web/api.js", "Function", "list", 2, 2, "Public", "javascript"),
    ("web/api.js", "Route", "GET /items", 3, 3, "Public", "javascript"),
    ("web/api.js", "Function", "load", 4, 4, "Public", "javascript"),
    ("web/api.js", "Process", "Process: GET /items", 4, 4, "Public", "javascript"),
    ("web/api.js", "Function", "send", 5, 5, "Public", "javascript"),
    ("web/app/items/page.tsx", "File", "page.tsx", 0, 1, "Public", "typescript"),
    ("web/app/items/page.tsx", "Function", "Page", 0, 0, "Public", "typescript"),
    ("web/app/items/page.tsx", "Process", "Process: GET /items", 0, 0, "Public", "typescript"),
    ("web/app/items/page.tsx", "Route", "GET /items", 0, 0, "Public", "typescript"),
    ("web/lib/format.ts", "File", "format.ts", 0, 14, "Public", "typescript"),
    ("web/lib/format.ts", "Interface", "Shape", 0, 2, "Public", "typescript"),
    ("web/lib/format.ts", "Property", "Shape.side", 1, 1, "Public", "typescript"),
    ("web/lib/format.ts", "Function", "fmt", 3, 5, "Public", "typescript"),
    ("web/lib/format.ts", "Class", "Box", 6, 13, "Public", "typescript"),
    ("web/lib/format.ts", "Method", "Box.area", 7, 9, "Public", "typescript"),
    ("web/lib/format.ts", "Method", "Box.grow", 10, 12, "Public", "typescript"),
]

#: (file_path of the source, source, kind, target, source_line, confidence), once each.
EDGES = [
    ("core/geo.rs", "Point::new", "CALLS", "make", 8, 0.95),
    ("core/geo.rs", "Point::go", "CALLS", "Point::new", 13, 0.95),
    ("core/geo.rs", "geo.rs", "CONTAINS", "Point", 0, 1.0),
    ("core/geo.rs", "geo.rs", "CONTAINS", "make", 16, 1.0),
    ("core/geo.rs", "Point", "IMPLEMENTS", "Moves", 11, 0.95),
    ("jv/Animal.java", "Dog.hi", "CALLS", "Animal.eat", 8, 0.95),
    ("jv/Animal.java", "Dog.dogs", "CALLS", "Dog.hi", 10, 0.95),
    ("jv/Animal.java", "Dog.dogs", "CALLS", "Greets.hi", 10, 0.95),
    ("jv/Animal.java", "Dog.dogs", "ENTRY_POINT_OF", "Process: GET /dogs", 0, 1.0),
    ("jv/Animal.java", "Dog", "EXTENDS", "Animal", 7, 0.95),
    ("jv/Animal.java", "Dog.dogs", "HANDLES_ROUTE", "GET /dogs", 9, 1.0),
    ("jv/Animal.java", "Dog", "IMPLEMENTS", "Greets", 7, 0.95),
    ("jv/Animal.java", "Dog.dogs", "STEP_IN_PROCESS", "Process: GET /dogs", 1, 1.0),
    ("jv/Animal.java", "Dog.hi", "STEP_IN_PROCESS", "Process: GET /dogs", 2, 0.95),
    ("jv/Animal.java", "Greets.hi", "STEP_IN_PROCESS", "Process: GET /dogs", 3, 0.95),
    ("jv/Animal.java", "Animal.eat", "STEP_IN_PROCESS", "Process: GET /dogs", 4, 0.95),
    ("shop/app.py", "Corner.open", "CALLS", "Store.open", 7, 1.0),
    ("shop/app.py", "Corner.open", "CALLS", "Corner.close", 8, 0.95),
    ("shop/app.py", "main", "CALLS", "Corner", 15, 0.95),
    ("shop/app.py", "main", "CALLS", "helper", 16, 0.5),
    ("shop/app.py", "main", "CALLS", "helper", 16, 0.95),
    ("shop/app.py", "main", "ENTRY_POINT_OF", "Process: main", 0, 1.0),
    ("shop/app.py", "Corner", "EXTENDS", "Store", 5, 0.5),
    ("shop/app.py", "Corner", "EXTENDS", "Store", 5, 0.95),
    ("shop/app.py", "app.py", "IMPORTS", "Store", 1, 0.5),
    ("shop/app.py", "app.py", "IMPORTS", "missing_module", 2, 0.9),
    ("shop/app.py", "main", "STEP_IN_PROCESS", "Process: main", 1, 1.0),
    ("shop/app.py", "Corner", "STEP_IN_PROCESS", "Process: main", 2, 0.95),
    ("shop/app.py", "helper", "STEP_IN_PROCESS", "Process: main", 3, 0.95),
    ("shop/old.py", "helper", "CALLS", "before", 4, 0.95),
    ("shop/old.py", "helper", "STEP_IN_PROCESS", "Process: main", 4, 0.5),
    ("shop/old.py", "before", "STEP_IN_PROCESS", "Process: main", 5, 0.95),
    ("srv/main.go", "main", "CALLS", "Store.Save", 8, 0.95),
    ("srv/main.go", "main", "CALLS", "serve", 8, 0.95),
    ("srv/main.go", "main", "ENTRY_POINT_OF", "Process: main", 0, 1.0),
    ("srv/main.go", "serve", "ENTRY_POINT_OF", "Process: ANY /go", 0, 1.0),
    ("srv/main.go", "serve", "HANDLES_ROUTE", "ANY /go", 10, 1.0),
    ("srv/main.go", "main.go", "IMPORTS", "fmt", 2, 0.5),
    ("srv/main.go", "main", "STEP_IN_PROCESS", "Process: main", 1, 1.0),
    ("srv/main.go", "serve", "STEP_IN_PROCESS", "Process: ANY /go", 1, 1.0),
    ("srv/main.go", "Store.Save", "STEP_IN_PROCESS", "Process: main", 2, 0.95),
    ("srv/main.go", "serve", "STEP_IN_PROCESS", "Process: main", 3, 0.95),
    ("web/api.js", "list", "CALLS", "fmt", 2, 0.5),
    ("web/api.js", "list", "CALLS", "fmt", 2, 0.95),
    ("web/api.js", "load", "CALLS", "Page", 4, 1.0),
    ("web/api.js", "load", "CALLS", "load", 4, 1.0),
    ("web/api.js", "send", "CALLS", "Page", 5, 0.5),
    ("web/api.js", "send", "CALLS", "load", 5, 0.5),
    ("web/api.js", "load", "ENTRY_POINT_OF", "Process: GET /items", 0, 1.0),
    ("web/api.js", "load", "FETCHES", "GET /items", 4, 1.0),
    ("web/api.js", "send", "FETCHES", "GET /items", 5, 0.5),
    ("web/api.js", "load", "HANDLES_ROUTE", "GET /items", 3, 1.0),
    ("web/api.js", "api.js", "IMPORTS", "format.ts", 0, 1.0),
    ("web/api.js", "load", "STEP_IN_PROCESS", "Process: GET /items", 1, 1.0),
    ("web/api.js", "load", "STEP_IN_PROCESS", "Process: GET /items", 2, 0.9),
    ("web/app/items/page.tsx", "Page", "CALLS", "load", 0, 0.9),
    ("web/app/items/page.tsx", "Page", "ENTRY_POINT_OF", "Process: GET /items", 0, 1.0),
    ("web/app/items/page.tsx", "Page", "HANDLES_ROUTE", "GET /items", 0, 1.0),
    ("web/app/items/page.tsx", "Page", "STEP_IN_PROCESS", "Process: GET /items", 1, 1.0),
    ("web/app/items/page.tsx", "Page", "STEP_IN_PROCESS", "Process: GET /items", 2, 1.0),
    ("web/lib/format.ts", "Box.grow", "CALLS", "Box.area", 11, 0.95),
    ("web/lib/format.ts", "Box", "IMPLEMENTS", "Shape", 6, 0.95),
]


def values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL."""
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"
