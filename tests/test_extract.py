"""Readers and framework tags, on small sources."""

import pytest

from codestrata.extract.facts import FileFacts, captures


def names(source, lang, *tags):
    return [c.name for c in captures(source, lang) if c.tag in tags]


def lines_of_errors(source, lang):
    return [c.node[0] for c in captures(source, lang) if c.tag == "error"]


def symbols(path, lang, source):
    return {r["id"]: r for r in FileFacts(0, path, lang, source).rows["symbols"]}


@pytest.mark.parametrize(
    ("lang", "source", "line"),
    [
        ("python", "def first():\n    a()\n\ndef broken(:\n    b()\n\nclass Last(Base):\n    def m(self):\n        c()\n", 3),
        ("python", "def first():\n    a()\nclass Empty:\ndef Last():\n    b()\n    c()\n", 2),
        ("python", "def first(): a()\ntry:\n    b()\ndef Last(): c()\n", 1),
        ("python", 'def first(): a()\ns = """\ndef Last():\n    b()\n    c()\n', 1),
        ("typescript", "function first() { a(); }\n}\nclass Last { m() { b(); c(); } }", 1),
        ("javascript", "function first() { a(); }\nb((;\nfunction Last() { c(); }", 1),
        ("java", "class first { void x() { a(); } }\n)\nclass Last { void m() { b(); c(); } }", 1),
    ],
)
def test_facts_around_an_error_are_kept(lang, source, line):
    assert lines_of_errors(source, lang)[:1] == [line]
    kinds = ("definition.class", "definition.function")
    assert {"first", "Last"} <= set(names(source, lang, *kinds))
    assert {"a", "c"} <= set(names(source, lang, "call"))


def test_hopeless_python():
    assert lines_of_errors("((((", "python") == [0]
    assert lines_of_errors("x = 1\0", "python")
    assert captures("", "python") == []


def test_regular_expressions_and_templates():
    source = "function a(x) { return /[{(]/.test(x) / 2 / f(x); }\nconst t = `a ${g(`${h(1)}}`)} {`;\nfunction b() { i(); }"
    for lang in ("javascript", "typescript"):
        assert lines_of_errors(source, lang) == []
        assert names(source, lang, "definition.function") == ["a", "b"]
        assert set(names(source, lang, "call")) >= {"f", "g", "h", "i"}


def test_python_endpoints_and_models():
    source = (
        "@app.get('/a')\ndef one(): pass\n"
        "@router.api_route('/b', methods=['PUT', 'GET'])\ndef two(): pass\n"
        "@bp.route('/c')\ndef three(): pass\n"
        "@bp.route('/d', methods=[\"DELETE\"])\n@login\ndef four(): pass\n"
        "@get('/e')\ndef five(): pass\n"
        "@app.get(PATH)\ndef six(): pass\n"
        "class Named(db.Model):\n    __tablename__ = 'rows'\n"
        "class Plain(Base): pass\nclass Alone:\n    __tablename__ = \"alone\"\nclass Other(Thing): pass\nclass MailService: pass\n"
    )
    found = symbols("x.py", "python", source)
    api = {k.split("::")[-1]: (r["api_method"], r["api_path"]) for k, r in found.items() if r["kind"] == "function"}
    assert api == {"one": ("GET", "/a"), "two": ("PUT", "/b"), "three": ("GET", "/c"), "four": ("DELETE", "/d"), "five": (None, None), "six": (None, None)}
    assert {k.split("::")[-1]: r["table_name"] for k, r in found.items() if r["kind"] == "class"} == {"Named": "rows", "Plain": "plain", "Alone": "alone", "Other": None, "MailService": None}
    assert found["x.py::MailService"]["is_service"] and not found["x.py::Other"]["is_service"]
    assert symbols("app/services/x.py", "python", "class A: pass\n")["app/services/x.py::A"]["is_service"]


def test_controllers_and_entities():
    source = (
        "@Controller('/cats/')\nexport class Cats {\n  @Get()\n  all() { return 1; }\n  @post('/:id/')\n  one(id: string) { return 2; }\n  plain() { return 3; }\n}\n"
        "@Controller()\nclass Root { @Delete() none() { return 1; } }\n"
        "@Entity('people') class Person {}\n@Entity({ name: 'homes' }) class Home {}\n@Table() class Car {}\n@Injectable() class Tool {}\nclass UserService {}\nclass Other {}\n"
    )
    found = symbols("src/x.ts", "typescript", source)
    api = {k.split("::")[-1]: (r["api_method"], r["api_path"]) for k, r in found.items() if r["kind"] == "method"}
    assert api == {"all": ("GET", "/cats"), "one": ("POST", "/cats/:id"), "plain": (None, None), "none": ("DELETE", "/")}
    classes = {k.split("::")[-1]: (r["table_name"], r["is_service"]) for k, r in found.items() if r["kind"] == "class"}
    assert classes == {"Cats": (None, False), "Root": (None, False), "Person": ("people", False), "Home": ("homes", False), "Car": ("car", False), "Tool": (None, True), "UserService": (None, True), "Other": (None, False)}
    assert symbols("src/models/y.js", "javascript", "class Row {}\n")["src/models/y.js::Row"]["table_name"] == "row"
    assert symbols("src/model/Y.java", "java", "class Row {}\n")["src/model/Y.java::Row"]["table_name"] == "row"


def test_routes():
    source = "const app = express();\nfunction list(q, r) { r.send(1); }\nclass C { show(q, r) { return 1; } }\nconst c = new C();\napp.get('/l', list);\nrouter.use('/s', c.show);\nother.get('/n', nothing);\n"
    found = symbols("r.js", "javascript", source)
    assert (found["r.js::list"]["api_method"], found["r.js::list"]["api_path"]) == ("GET", "/l")
    assert (found["r.js::C::show"]["api_method"], found["r.js::C::show"]["api_path"]) == ("USE", "/s")


def test_visibility_aliases_and_types():
    found = symbols("v.ts", "typescript", "export type Id = string | number;\ntype Own = Id;\nexport class A {\n  private a = 1;\n  protected b(): void { this.x(); }\n  #c = 2;\n  d: Id;\n}\n")
    assert {k: (r["kind"], r["exported"], r["visibility"]) for k, r in found.items() if r["kind"] != "file"} == {
        "v.ts::Id": ("type_alias", True, "public"), "v.ts::Own": ("type_alias", False, "public"), "v.ts::A": ("class", True, "public"),
        "v.ts::A::a": ("variable", True, "private"), "v.ts::A::b": ("method", True, "protected"), "v.ts::A::#c": ("variable", True, "private"), "v.ts::A::d": ("variable", True, "public"),
    }
    python = symbols("v.py", "python", "def _a(): pass\ndef __b__(): pass\nclass C:\n    _d = 1\n")
    assert {k.split("::")[-1]: (r["exported"], r["visibility"]) for k, r in python.items() if r["kind"] != "file"} == {"_a": (False, "private"), "__b__": (True, "public"), "C": (True, "public"), "_d": (False, "private")}
    java = symbols("V.java", "java", "public class V { private int a; protected void b() { c(); } public void d() { } }")
    assert {k.split("::")[-1]: (r["exported"], r["visibility"]) for k, r in java.items() if r["kind"] != "file"} == {"V": (True, "public"), "a": (True, "private"), "b": (True, "protected"), "d": (True, "public")}
    assert names("function f(a: User, b: ns.Role): Result { return a as Other; }", "typescript", "type_use") == ["User", "ns.Role", "Result"]
