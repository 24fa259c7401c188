"""Small sources and the symbols they hold, by language."""

import pytest

from symgrove.sources.extract import extract
from symgrove.sources.extract.common import qualified


def symbols(found):
    return {(n["kind"], n["name"]) for n in found.nodes}


def visibility(found, name):
    return next(n["visibility"] for n in found.nodes if n["name"] == name)


def edges(found):
    return {(e["kind"], e["target_name"]) for e in found.edges}


CASES = [
    ("a.py", "def add(a, b):\n    return a + b\n", {("Function", "add")}, set()),
    ("a.py", "class Foo:\n    def __init__(self):\n        pass\n", {("Class", "Foo"), ("Constructor", "Foo.__init__")}, set()),
    ("a.py", "class Dog(Animal):\n    pass\n", {("Class", "Dog")}, {("EXTENDS", "Animal")}),
    ("a.py", "class Foo:\n    def bar(self):\n        self.baz()\n    def baz(self):\n        pass\n", {("Method", "Foo.bar")}, {("CALLS", "Foo.baz")}),
    ("a.py", "import os\nfrom x.y import z\n", {("Import", "os"), ("Import", "z")}, {("IMPORTS", "os"), ("IMPORTS", "z")}),
    ("a.js", "function add(a, b) { return a + b; }", {("Function", "add")}, set()),
    ("a.js", "class Foo { bar() {} }", {("Class", "Foo"), ("Method", "Foo.bar")}, set()),
    ("a.js", "const greet = (name) => { hello(name); };", {("Function", "greet")}, {("CALLS", "hello")}),
    ("a.js", "class Foo {\n  bar() { this.baz(); }\n  baz() {}\n}", {("Method", "Foo.bar"), ("Method", "Foo.baz")}, {("CALLS", "Foo.baz")}),
    ("a.ts", "interface User { id: number; }\nenum Color { Red }\ntype Id = string;", {("Interface", "User"), ("Enum", "Color"), ("TypeAlias", "Id")}, set()),
    ("a.ts", "export class A extends B implements C, D {\n  constructor() {}\n}\nimport { x } from './y';", {("Class", "A"), ("Constructor", "A.constructor"), ("Import", "x")}, {("EXTENDS", "B"), ("IMPLEMENTS", "C"), ("IMPLEMENTS", "D"), ("IMPORTS", "x")}),
    ("a.ts", "const store = new Store();", {("Constant", "store")}, {("REFERENCES", "Store")}),
    ("a.rs", "pub fn add(a: i32) -> i32 { helper(a) }", {("Function", "add")}, {("CALLS", "helper")}),
    ("a.rs", "pub struct Point { pub x: Num }\nimpl Point {\n    pub fn new() -> Self { Point { x: 1 } }\n}", {("Struct", "Point"), ("Field", "Point::x"), ("Method", "Point::new")}, {("REFERENCES", "Num")}),
    ("a.rs", "struct Dog;\nimpl Greet for Dog {\n    fn hi(&self) {}\n}\nenum E { A }\ntrait T { fn x(&self); }\nmod m {}\nuse std::fmt;", {("Struct", "Dog"), ("Method", "Dog::hi"), ("Enum", "E"), ("Trait", "T"), ("Module", "m"), ("Import", "std::fmt")}, {("IMPLEMENTS", "Greet")}),
    ("a.go", "package main\n\nconst Max = 3\n\nfunc (s *Store) Save() {\n\ts.flush()\n\tfmt.Println(1)\n}\n\nfunc main() {}\n", {("Module", "main"), ("Constant", "Max"), ("Method", "Store.Save"), ("Function", "main")}, {("CALLS", "Store.flush"), ("CALLS", "fmt.Println")}),
    ("a.go", "package p\n\nimport (\n\t\"fmt\"\n\t\"os\"\n)\n\ntype A struct {\n\tUser User\n\tcount int\n}\n\ntype I interface {\n\tDo()\n}\n\ntype N = int\n", {("Struct", "A"), ("Field", "A.User"), ("Field", "A.count"), ("Interface", "I"), ("Method", "I.Do"), ("TypeAlias", "N")}, {("REFERENCES", "User"), ("IMPORTS", "fmt"), ("IMPORTS", "os")}),
    ("A.java", "package a.b;\nimport java.util.List;\nenum Color { RED, GREEN }\nrecord Point(int x, int y) {}\n", {("Package", "a.b"), ("Import", "java.util.List"), ("Enum", "Color"), ("EnumVariant", "RED"), ("Record", "Point")}, {("IMPORTS", "java.util.List")}),
    ("A.java", "public class Dog extends Animal implements Greet {\n  private int n;\n  public Dog() { super(); }\n  public void hi() { obj.run(); new Cat(); }\n}", {("Class", "Dog"), ("Constructor", "Dog..ctor"), ("Method", "Dog.hi"), ("Field", "n")}, {("EXTENDS", "Animal"), ("IMPLEMENTS", "Greet"), ("CALLS", "obj.run"), ("REFERENCES", "Cat")}),
    ("a.cs", "namespace N {\n  public struct Point { }\n  public record User(string Name);\n  class Dog : Animal, IGreet {\n    public Dog() { }\n    public int Age { get; set; }\n    public void Hi() { this.Run(); }\n  }\n}", {("Namespace", "N"), ("Struct", "Point"), ("Record", "User"), ("Class", "Dog"), ("Constructor", "Dog..ctor"), ("Property", "Age"), ("Method", "Dog.Hi")}, {("EXTENDS", "Animal"), ("IMPLEMENTS", "IGreet"), ("CALLS", "Dog.Run")}),
    ("a.swift", "class Dog: Animal {\n  init() {}\n  func a() { self.b() }\n}\nstruct S {}\nprotocol P {}\nimport Foundation\n", {("Class", "Dog"), ("Constructor", "Dog.init"), ("Method", "Dog.a"), ("Struct", "S"), ("Interface", "P")}, {("EXTENDS", "Animal"), ("CALLS", "Dog.b"), ("IMPORTS", "Foundation")}),
    ("a.php", "<?php\nnamespace App;\nuse X\\Y;\nclass Dog extends Animal implements Greet {\n  private $n;\n  public function __construct() {}\n  public function a() { $this->b(); $c = new Cat(); $c->run(); }\n}\nfunction top() { helper(); }\n", {("Namespace", "App"), ("Class", "Dog"), ("Property", "Dog.n"), ("Constructor", "Dog.__construct"), ("Method", "Dog.a"), ("Function", "top")}, {("EXTENDS", "Animal"), ("IMPLEMENTS", "Greet"), ("CALLS", "Dog.b"), ("CALLS", "Cat.__construct"), ("CALLS", "c.run"), ("CALLS", "helper"), ("IMPORTS", "X\\Y")}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_symbols_and_edges(case):
    path, text, want, links = CASES[case]
    found = extract(path, text)
    assert want <= symbols(found), symbols(found)
    assert links <= edges(found), edges(found)
    assert ("File", path) in symbols(found)


def test_visibility():
    assert visibility(extract("a.py", "def _helper(): pass\n"), "_helper") == "Private"
    assert visibility(extract("a.rs", "fn x() {}"), "x") == "Private"
    go = extract("a.go", "package p\nfunc Exported() {}\nfunc unexported() {}\n")
    assert visibility(go, "Exported") == "Public" and visibility(go, "unexported") == "Private"
    assert visibility(extract("A.java", "class A { void x() { } }"), "A.x") == "Internal"
    assert visibility(extract("a.cs", "class A { void X() { } }"), "A.X") == "Private"
    assert visibility(extract("a.swift", "private func x() {}"), "x") == "Private"


def test_comments():
    doc = lambda path, text, name: next(n["doc_comment"] for n in extract(path, text).nodes if n["name"] == name)
    assert doc("a.py", 'def f():\n    """Says hi."""\n', "f") == "Says hi."
    assert doc("a.rs", "/// Adds.\n/// Fast.\nfn add() {}", "add") == "Adds.\nFast."
    assert doc("a.rs", "/// Stale\n\nfn add() {}", "add") is None
    assert doc("a.ts", "/**\n * Greets.\n */\nfunction hi() {}", "hi") == "Greets."
    assert doc("a.cs", "/// <summary>X</summary>\nclass A { }", "A") == "<summary>X</summary>"


def test_lines_count_from_zero():
    found = extract("a.go", "package p\n\nfunc Foo() {\n}\n")
    assert next((n["line_start"], n["line_end"]) for n in found.nodes if n["name"] == "Foo") == (2, 3)


def test_text_in_strings_and_comments_is_no_code():
    found = extract("a.js", "// function no() {}\nconst s = 'function no2() {}';\nfunction yes() { return `call()`; }")
    assert ("Function", "no") not in symbols(found) and ("Function", "no2") not in symbols(found)
    assert ("CALLS", "call") not in edges(found)


def test_qualified():
    assert qualified("this.m", "A") == "A.m" and qualified("self.a.b", "A") == "self.a.b" and qualified("x.m", "A") == "x.m"


def test_broken_and_unknown_files():
    assert [n["kind"] for n in extract("a.py", "def (").nodes] == ["File"] and extract("a.txt", "x").nodes == []
    for lang in ("js", "rs", "go", "java", "cs", "swift", "php"):
        assert extract(f"a.{lang}", "").nodes[0]["kind"] == "File"
        extract(f"a.{lang}", "class X { { { fn func function ((((")


ROUTES = [
    ("a.js", "app.get('/users', function list() {});", "GET /users"),
    ("a.ts", "class C {\n  @Post('x')\n  add() {}\n}", "POST x"),
    ("a.tsx", '<Route path="/home" element={<Home/>} />', "GET /home"),
    ("a.py", "@app.route('/x')\ndef f():\n    pass\n", "ANY /x"),
    ("a.py", "@router.put('/y')\ndef f():\n    pass\n", "PUT /y"),
    ("A.java", 'class A {\n  @GetMapping("/a")\n  public void a() { }\n}', "GET /a"),
    ("A.java", '@RequestMapping("/b") class A { }', "ANY /b"),
    ("a.cs", 'class A {\n  [HttpDelete("/d")]\n  public void D() { }\n}', "DELETE /d"),
    ("a.rs", 'fn r() { Router::new().route("/r", get(h)); }', "GET /r"),
    ("a.rs", '#[post("/p")]\nfn p() {}', "POST /p"),
    ("a.go", 'package p\nfunc m() {\n\tr.Get("/g", h)\n\thttp.HandleFunc("/h", h)\n}\n', "GET /g"),
    ("a.php", "<?php\nRoute::any('/z', 'C@z');\n", "ANY /z"),
]


@pytest.mark.parametrize("path, text, name", ROUTES)
def test_routes(path, text, name):
    assert ("Route", name) in symbols(extract(path, text))


def test_route_handlers_and_fetches():
    found = extract("a.py", "@router.put('/y')\ndef f():\n    pass\n")
    route = next(n["id"] for n in found.nodes if n["kind"] == "Route")
    handler = next(n["id"] for n in found.nodes if n["name"] == "f")
    assert [(e["source_id"], e["target_name"]) for e in found.edges if e["kind"] == "HANDLES_ROUTE"] == [(handler, route)]
    js = extract("a.js", "function go() {\n  fetch('/a', { method: 'post' });\n  axios.delete('/b');\n  useSWR('/c');\n}")
    assert {("FETCHES", "POST /a"), ("FETCHES", "DELETE /b"), ("FETCHES", "GET /c")} <= edges(js)


def test_python_that_does_not_parse_keeps_the_rest():
    found = extract("p/a.py", "import os\nclass A:\n    def f(self):\n        print 'x'\n        self.g()\n    def g(self):\n        pass\n")
    assert [(n["kind"], n["name"]) for n in found.nodes] == [("File", "a.py"), ("Import", "os"), ("Class", "A"), ("Method", "A.f"), ("Method", "A.g")]
    assert ("CALLS", "A.g") in {(e["kind"], e["target_name"]) for e in found.edges}
    names = lambda text: [n["name"] for n in extract("x.py", text).nodes]
    assert names("def f(:\n  pass\ndef ok():\n    return 1\n") == ["x.py", "ok"]
    assert names("x = (1,\ndef ok():\n    pass\n") == ["x.py", "ok"]
    assert names("try:\n    pass\nexcept E, e:\n    pass\ndef ok(): pass\n") == ["x.py", "ok"]
    assert names("\0") == names("   a b\n\tc d\n") == names("((((\n\n") == ["x.py"]


def test_routes_and_fetches_of_the_frameworks():
    routes = lambda path, text: [(n["name"], n["line_start"]) for n in extract(path, text).nodes if n["kind"] == "Route"]
    js = """app.get('/users', h);
router . post("/x", y);
@Get('a')
<Route exact path="/home" element={<X/>} />
const r = [{ path: '/cfg', element: X }, { path: '/no' }];
function load() { return fetch('/users', { headers: a(b(c)), method: 'POST' }); }
axios.get("/z"); useSWR('/s'); map.get('/no'); fetch('/plain')
"""
    assert routes("a.js", js) == [("GET /users", 0), ("POST /x", 1), ("GET a", 2), ("GET /home", 3), ("GET /cfg", 4)]
    assert sorted(e["target_name"] for e in extract("a.js", js).edges if e["kind"] == "FETCHES") == ["GET /plain", "GET /s", "GET /z", "POST /users"]
    assert routes("a.php", "<?php\n$app->get('/p', f); Route::any('/q', g);\n#[Route('/r', methods: ['PUT'])]\n#[Route('/t')]\nfunction h() {}\n") == [("GET /p", 1), ("ANY /q", 1), ("PUT /r", 2), ("GET /t", 3)]
    assert routes("a.rs", 'let a = Router::new().route("/x", get(h)).route("/y", post(g));\n#[get("/z")]\nfn z() {}\n') == [("GET /x", 0), ("POST /y", 0), ("GET /z", 1)]
    assert routes("a.go", 'r.GET("/g", h)\nhttp.HandleFunc("/f", h)\nm.get("/no")\n') == [("GET /g", 0), ("ANY /f", 1)]
    assert routes("a.java", '@GetMapping("/j")\n@RequestMapping(value = "/k")\n@Named("/no")\nclass A {}\n') == [("GET /j", 0), ("ANY /k", 1)]
    assert routes("a.cs", '[HttpGet("/c")]\n[Route("/d")]\nclass A {}\n') == [("GET /c", 0), ("ANY /d", 1)]
    assert routes("a.py", "@app.route('/w')\n@router.get('/v')\n@name('/no')\ndef f():\n    pass\n") == [("ANY /w", 0), ("GET /v", 1)]
